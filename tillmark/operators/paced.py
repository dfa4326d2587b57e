"""Parses that a provider with a quota gives, stored as they come.

All tasks share one quota: the strings without a stored parse are dealt to turns of as many calls as a period allows,
and the driver starts a turn when the period after the last one's end is over. A turn's answers are committed to the
store before the next one begins, so that a run that breaks off, for whatever reason, has asked in vain for one turn
at most. A provider that is busy holds back the turn after it for all tasks, as long as it asks; what it did not answer
comes again after the rest. A day's quota that is spent ends the run, and what is stored stays.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillmark.functions.scalars import coerce_parsed, is_fresh
from tillmark.operators.providers import ATTEMPTS, FIRST_WAIT, LONGEST_WAIT, QuotaSpent, Retryable, ask
from tillmark.operators.ranks import place_in_groups
from tillmark.sources.schemas import PARSED
from tillmark.sources.shared import written
from tillmark.sources.store import Store

KEYS = ("store", "raw_description")
CACHE = T.StructType([T.StructField("store", T.StringType()), T.StructField("raw_description", T.StringType()), T.StructField("parsed", PARSED)])
#: A string may take two calls: alone, then with its context.
CALLS_EACH = 2


def parse_cache(spark: SparkSession, root: str, buckets: int = 64) -> Store:
    """The store of parses below ``root``."""
    return Store(spark, root, buckets, {"parses": CACHE}, {"parses": KEYS})


@dataclass
class Progress:
    """Strings that were without a parse, how many have got one, and whether the day's quota ended the run."""

    missing: int
    stored: int
    spent: bool


def missing(items: DataFrame, cache: Store) -> DataFrame:
    """``store, raw_description, siblings`` of the strings of ``items`` without a fresh parse, each once."""
    named = items.withColumn("store", F.coalesce("store", F.lit("UNKNOWN")))
    fresh = cache.snapshot().table("parses").filter(is_fresh(F.col("parsed"))).select(*KEYS)
    return named.filter(F.col("raw_description").isNotNull()).groupBy(*KEYS).agg(F.first("siblings", ignorenulls=True).alias("siblings")).join(fresh, list(KEYS), "left_anti")


def parse_paced(
    items: DataFrame, cache: Store, provider: Callable[..., dict], calls: int = 5, period: float = 60.0, attempts: int = ATTEMPTS, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep
) -> Progress:
    """Asks for what ``items(store, raw_description, siblings)`` have no stored parse of; at most ``calls`` calls in any ``period`` of seconds over all tasks.

    What a busy provider did not answer is asked again, ``attempts`` times in all.
    """
    size = max(1, calls // CALLS_EACH)
    if calls < CALLS_EACH:
        raise ValueError(f"{calls} calls a period are too few: a string may take {CALLS_EACH}")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for store, text, others in zip(f["store"], f["raw_description"], f["siblings"], strict=True):
                try:
                    out.append((ask(provider, text, store, others), None, False))
                except Retryable as e:
                    out.append((None, FIRST_WAIT if e.after is None else min(e.after + 1, LONGEST_WAIT), False))
                except QuotaSpent:
                    out.append((None, None, True))
            yield pd.DataFrame({"store": f["store"], "raw_description": f["raw_description"], "parsed": [x[0] for x in out], "wait": pd.Series([x[1] for x in out], dtype=float), "spent": [x[2] for x in out]})

    total, stored, free_at = None, 0, clock()
    for _ in range(attempts):
        queue = written(place_in_groups(missing(items, cache).withColumn("_all", F.lit(0)), ["_all"], [F.col(c) for c in KEYS], "place"), "queue")
        n = queue.count()
        total = n if total is None else total
        for first in range(1, n + 1, size):
            if (hold := free_at - clock()) > 0:
                sleep(hold)
            # the queue is sorted by place, so a turn reads the few row groups that it stands in
            turn = queue.filter(F.col("place").between(first, first + size - 1)).select(*KEYS, "siblings").repartition(size)
            said = written(turn.mapInPandas(run, f"store string, raw_description string, parsed {PARSED.simpleString()}, wait double, spent boolean"), "answers")
            done, wait, spent = said.agg(F.count("parsed"), F.max("wait"), F.max("spent")).head()
            if done:
                tx = cache.begin()
                tx.put("parses", said.filter(F.col("parsed").isNotNull()).select(*KEYS, coerce_parsed(F.col("parsed")).alias("parsed")))
                tx.commit()
                tx.close()
                stored += done
            if spent:
                return Progress(total, stored, True)
            free_at = clock() + max(period, wait or 0.0)
        if stored == total:
            break
    return Progress(total or 0, stored, False)
