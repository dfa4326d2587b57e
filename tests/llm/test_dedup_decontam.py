"""Repeated strings and benchmark passages against plain versions, and what cleaning leaves."""

import tempfile

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm import cases
from tillmark.llm import decontamination as dc
from tillmark.llm import fm_index as fm
from tillmark.llm import induced_sort as ind
from tillmark.llm import suffix_dedup as sd


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(1, 4), max_size=25), min_size=1, max_size=8), st.integers(1, 40), st.integers(1, 30), st.sampled_from([1, 3, 4096]), st.booleans())
def test_induced_order_and_prefixes(texts, block, buffer, span, twice):
    texts = texts * (1 + twice)
    flat = [0] + [x for t in texts for x in [*t, 0]]
    s = np.array(flat, np.uint16)
    if not (s > 0).any():
        return
    with tempfile.TemporaryDirectory() as folder, pytest.MonkeyPatch.context() as m:
        m.setattr(ind, "RANGE", span)  # symbols that share a queue
        order, lcp = ind.suffix_order(s, folder, block, buffer)
    tail = lambda i: flat[i : flat.index(0, i)]
    expected = sorted((i for i, x in enumerate(flat) if x), key=lambda i: (tail(i), flat.index(0, i)))
    assert order.tolist() == expected
    common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    assert lcp.tolist() == [0] + [common(tail(a), tail(b)) for a, b in zip(expected, expected[1:], strict=False)]


def test_sorting_on_disk(tmp_path, monkeypatch):
    rng = np.random.default_rng(1)
    key = rng.integers(0, 50, 5000)
    assert (key[ind.disk_order(key, str(tmp_path), 300)] == np.sort(key)).all()
    monkeypatch.setattr(ind, "new_map", lambda folder, name, n, dtype: np.memmap(f"{folder}/{name}", dtype, "w+", shape=(max(1, n),))[:n])
    s = np.append(0, rng.integers(0, 5, 3000)).astype(np.uint16)
    s[-1] = 0
    a = ind.suffix_order(s, str(tmp_path), 100, 64)
    b = ind.suffix_order(s, str(tmp_path), 1 << 18, 1 << 22)
    assert (a[0] == b[0]).all() and (a[1] == b[1]).all()


def test_names_are_sorted_by_the_same_routine(tmp_path, monkeypatch):
    rng = np.random.default_rng(2)
    calls, whole = [], ind.suffix_order

    def counted(s, folder, *rest):
        calls.append((len(s), rest[2] if len(rest) > 2 else 257))
        return whole(s, folder, *rest)

    monkeypatch.setattr(ind, "suffix_order", counted)
    passage = rng.integers(1, 250, 1500)
    s = np.concatenate([[0], *([*passage[k:], 0] for k in range(0, 1200, 25))]).astype(np.uint16)
    order, lcp = counted(s, str(tmp_path), 64, 50)
    sizes = [n for n, _ in calls]
    assert len(calls) > 3 and all(2 * b <= a + 2 for a, b in zip(sizes, sizes[1:], strict=False)) and max(a for _, a in calls[1:]) > 257
    flat = s.tolist()
    tail = lambda i: flat[i : flat.index(0, i)]
    assert [tail(i) for i in order] == sorted(tail(i) for i, x in enumerate(flat) if x) and lcp.max() == 255


def test_a_bucket_far_above_its_memory(monkeypatch):
    """Pieces of sixty times the bytes that are told apart at once, every array in a file, small blocks and queues: as a plain count."""
    monkeypatch.setattr(ind, "RANGE", 64)
    on_disk = lambda folder, name, n, dtype: np.memmap(f"{folder}/{name}", dtype, "w+", shape=(max(1, n),))[:n]
    monkeypatch.setattr(ind, "new_map", on_disk)
    monkeypatch.setattr(sd, "new_map", on_disk)
    monkeypatch.setattr(sd, "suffix_order", lambda s, folder: ind.suffix_order(s, folder, 1 << 12, 1 << 10))
    monkeypatch.setattr(sd, "_rows", lambda batches: batches)
    rng = np.random.default_rng(3)
    shared = [rng.integers(97, 101, 70).astype(np.uint8).tobytes() for _ in range(40)]
    sent = []
    for shard in range(12):
        own = [rng.integers(97, 101, 70).astype(np.uint8).tobytes() for _ in range(100)]
        mixed = [a[: 10 + shard] + b for a, b in zip(own[:20], rng.permutation(np.array(shared, object))[:20], strict=True)]
        sent.append(list(dict.fromkeys(own + mixed)))
    rows = iter([{"bucket": 0, "shard_id": k, "pieces": sd._payload(list(range(len(x))), x, [7] * len(x), [k] * len(x))} for k, x in enumerate(sent)])
    assert sum(len(p) for x in sent for p in x) > 60 * 1024
    got = list(sd._sort_bucket(50, 1024)(rows))
    least = {}
    for k, x in enumerate(sent):
        for p in x:
            for i in range(len(p) - 49):
                least.setdefault(p[i : i + 50], k)
    for k, (x, batch) in enumerate(zip(sent, got, strict=True)):
        assert batch.column("shard_id")[0].as_py() == k
        assert np.frombuffer(sd.zstandard.decompress(batch.column("least")[0].as_py()), np.int64).tolist() == [least[p[i : i + 50]] for p in x for i in range(len(p) - 49)]


def plain_repeats(rows, length=50):
    first = {}
    out = []
    for i, t in sorted(((sd.FIRST_ID if d is None else d, (t or "").encode()) for d, t, *_ in rows)):
        for p in range(len(t) - length + 1):
            first.setdefault(t[p : p + length], i)
    for d, t, *_ in rows:
        i, b = sd.FIRST_ID if d is None else d, (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((str(d), len(b), sum(gone), sum(gone[p] and not (p and gone[p - 1]) for p in range(len(b))), cases.sha(kept)))
    return sorted(out)


@pytest.mark.parametrize("shard, bucket", [(sd.SHARD_BYTES, sd.BUCKET_BYTES), (3000, 2000)])
def test_repeats(spark, shard, bucket):
    small = [r if r[1] is not cases.LONG else (r[0], cases.LONG[:6000], *r[2:]) for r in cases.odd_rows()]
    for rows in (cases.corpus(80), small):
        got = sd.remove_repeats(cases.with_clashes(cases.documents(spark, rows)), shard_bytes=shard, bucket_bytes=bucket).collect()
        assert sorted((str(r[0]), *list(r)[1:]) for r in got) == plain_repeats(rows)
    assert sd.remove_repeats(cases.documents(spark, [])).collect() == []


def test_repeats_cut_from_texts(spark):
    df = cases.with_clashes(cases.documents(spark))
    out = sd.remove_repeats(df, clean=True)
    assert out.columns == df.columns
    got = out.collect()
    assert len(got) == len(cases.odd_rows()) and sum(r["text"] is None for r in got) == sum(t is None for _, t, *_ in cases.odd_rows())
    by = {r["doc_id"]: r for r in got}
    assert by[7]["text"] == "" and by[7]["n_chars"] == 0 and by[9]["text"] == "x " and by[4]["text"] == "a b"


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), max_size=20), min_size=1, max_size=6), st.lists(st.integers(1, 3), min_size=1, max_size=5), st.integers(1, 6))
def test_backward_search_and_locate(texts, pattern, sample):
    s = np.array([x for t in texts for x in [*t, 0]], np.int64)
    index = fm.FMIndex(s, 3, sample)
    lo, hi = index.search(np.array([pattern], np.int64))
    found = sorted(index.locate(np.arange(lo[0], hi[0])).tolist())
    n = len(pattern)
    assert found == [i for i in range(len(s) - n + 1) if s[i : i + n].tolist() == pattern]


def plain_hits(rows, items, width=10):
    windows = {}
    for i, t in items:
        w = cases.words(t)
        for k in range(max(1, len(w) - width + 1) if w and i is not None else 0):
            windows.setdefault(tuple(w[k : k + width]), set()).add(str(i))
    out = []
    for d, t, *_ in rows:
        w, hit, found = cases.words(t), set(), set()
        for k in range(len(w)):
            for m in {len(x) for x in windows}:
                if k + m <= len(w) and (x := tuple(w[k : k + m])) in windows:
                    found |= windows[x]
                    hit |= set(range(k, k + m))
        out.append((str(d), len(w), len(hit), ",".join(sorted(found))))
    return sorted(out)


ITEMS = [(1, cases.PASSAGE), (2, "UPPER, lower-123"), (10, "the quick brown fox jumps over the lazy dog and never"), (3, None), (4, ""), (5, "é" * 60), (None, "a b"), (2, "a")]


@pytest.mark.parametrize("block", [dc.BLOCK_BYTES, 1])
def test_hits(spark, block):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    for rows in (cases.odd_rows(), cases.corpus(40)):
        got = dc.contamination(cases.with_clashes(cases.documents(spark, rows)), bench, block_bytes=block).collect()
        assert sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], ",".join(r["items"])) for r in got) == plain_hits(rows, ITEMS)
    assert dc.contamination(cases.documents(spark, []), bench).collect() == []
    none = dc.contamination(cases.documents(spark), bench.filter("false")).collect()
    assert len(none) == len(cases.odd_rows()) and not any(r["n_hit"] for r in none)


def test_fifty_blocks_in_one_pass(spark):
    rows = cases.corpus(40)
    items = [(k, " ".join(t.split()[k % 5 : k % 5 + 8 + k % 7])) for k, t, *_ in rows[:30]] + [(100 + k, f"not there {k} " * 6) for k in range(30)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert len(dc.blocks_of(bench, 10, 1).shared) == 60
    out = dc.contamination(cases.documents(spark, rows), bench, block_bytes=1)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], ",".join(r["items"])) for r in out.collect()) == plain_hits(rows, items)


@pytest.mark.parametrize("block", [dc.BLOCK_BYTES, 1])
def test_passages_cut(spark, block):
    bench = spark.createDataFrame([(1, cases.PASSAGE), (2, "UPPER, lower-123")], "item_id long, text string")
    df = cases.with_clashes(cases.documents(spark))
    out = dc.contamination(df, bench, block_bytes=block, clean=True)
    assert out.columns == df.columns
    by = {r["doc_id"]: r for r in out.collect()}
    assert by[8]["text"] == " again" and by[8]["n_chars"] == 6 and by[12]["text"] == "" and by[5]["text"] == cases.LONG and by[0]["text"] is None


@pytest.mark.parametrize("length", [0, 19, 256, 1000])
def test_lengths_that_cannot_be_carried_are_refused(spark, length):
    from tillmark.llm import suffix_dedup

    with pytest.raises(ValueError, match="length is"):
        suffix_dedup.remove_repeats(cases.documents(spark), length=length)
