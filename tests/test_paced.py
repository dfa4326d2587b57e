"""One quota over all tasks, by a clock of the test's own; a cache that keeps what was stored when a run breaks off."""

import os

import pytest

from tillmark.operators import paced
from tillmark.operators.providers import QuotaSpent, Retryable

ITEMS = "store string, raw_description string, siblings array<string>"


class Clock:
    """Time that passes by sleeping only; workers read it from a file."""

    def __init__(self, path):
        self.path, self.slept = str(path), []
        self.set(1000.0)

    def set(self, now):
        self.now = now
        with open(self.path, "w") as f:
            f.write(str(now))

    def sleep(self, seconds):
        self.slept.append(seconds)
        self.set(self.now + seconds)


def provider(folder, clock, act):
    """Notes each call with its time and process, then does ``act(call number, text, store)``."""
    path = clock.path

    def call(text, store=None, others=None):
        now = open(path).read()
        fd = os.open(f"{folder}/calls", os.O_WRONLY | os.O_CREAT | os.O_APPEND)
        os.write(fd, f"{now}\t{os.getpid()}\t{text}\n".encode())
        os.close(fd)
        return act(sum(1 for _ in open(f"{folder}/calls")), text, store)

    return call


def calls(folder):
    return [x.rstrip("\n").split("\t") for x in open(f"{folder}/calls")]


def items(spark, n):
    return spark.createDataFrame([("s", f"text {k}", ["a"]) for k in range(n)] * 2, ITEMS).repartition(4)


def test_at_most_five_calls_a_minute(spark, tmp_path):
    clock, cache = Clock(tmp_path / "clock"), paced.parse_cache(spark, f"file://{tmp_path}/cache", 4)
    twice = lambda n, text, store: {"product": "x"} if store or text.endswith("1") else {"product": None}
    got = paced.parse_paced(items(spark, 7), cache, provider(tmp_path, clock, twice), calls=5, clock=lambda: clock.now, sleep=clock.sleep)
    assert got == paced.Progress(7, 7, False)
    at = sorted(float(x[0]) for x in calls(tmp_path))
    assert len(at) == 13 and all(b - a >= 60 for a, b in zip(at, at[5:], strict=False))
    rows = {r["raw_description"]: r["parsed"] for r in cache.snapshot().table("parses").collect()}
    assert rows["text 1"]["attempts"] == 1 and rows["text 2"]["attempts"] == 2 and rows["text 2"]["product"] == "x" and len(rows) == 7
    assert paced.parse_paced(items(spark, 7), cache, provider(tmp_path, clock, twice), clock=lambda: clock.now, sleep=clock.sleep) == paced.Progress(0, 0, False)
    assert len(calls(tmp_path)) == 13


def test_what_was_stored_is_not_asked_for_again(spark, tmp_path):
    clock, cache = Clock(tmp_path / "clock"), paced.parse_cache(spark, f"file://{tmp_path}/cache", 4)

    def breaks(n, text, store):
        if n >= 6:
            raise RuntimeError("the machine is gone")
        return {"product": text}

    with pytest.raises(Exception, match="the machine is gone"):
        paced.parse_paced(items(spark, 9), cache, provider(tmp_path, clock, breaks), calls=4, clock=lambda: clock.now, sleep=clock.sleep)
    kept = {r["raw_description"] for r in cache.snapshot().table("parses").collect()}
    before = [x[2] for x in calls(tmp_path)]
    assert len(kept) == 4
    fine = lambda n, text, store: {"product": text}
    assert paced.parse_paced(items(spark, 9), cache, provider(tmp_path, clock, fine), calls=4, clock=lambda: clock.now, sleep=clock.sleep) == paced.Progress(5, 5, False)
    after = [x[2] for x in calls(tmp_path)][len(before) :]
    assert not kept & set(after) and len(after) == 5 and cache.snapshot().table("parses").count() == 9


def test_a_busy_provider_holds_back_all_and_a_spent_day_ends_the_run(spark, tmp_path):
    clock, cache = Clock(tmp_path / "clock"), paced.parse_cache(spark, f"file://{tmp_path}/cache", 4)

    def busy(n, text, store):
        if n == 2:
            raise Retryable("busy", after=70)
        if n == 7:
            raise QuotaSpent("per day")
        return {"product": text}

    got = paced.parse_paced(items(spark, 6), cache, provider(tmp_path, clock, busy), calls=4, period=10, clock=lambda: clock.now, sleep=clock.sleep)
    # after the rest the string that was put off comes again, when the quota is spent
    assert got == paced.Progress(6, 5, True) and clock.slept == [71, 10, 10]
    assert cache.snapshot().table("parses").count() == got.stored
    with pytest.raises(ValueError, match="too few"):
        paced.parse_paced(items(spark, 1), cache, busy, calls=1)
