"""Seams for model providers: a provider is a function on plain records, called in batches on the executors."""

from __future__ import annotations

import functools
import time
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillmark.functions.scalars import coerce_parsed, is_fresh
from tillmark.sources.schemas import PARSED, RECEIPT

ATTEMPTS, FIRST_WAIT, LONGEST_WAIT = 3, 2.0, 75.0


class Retryable(Exception):
    """A failure worth another call; ``after`` seconds if the provider said so."""

    def __init__(self, message: str, after: float | None = None) -> None:
        super().__init__(message)
        self.after = after


class QuotaSpent(Exception):
    """The day's quota is used up: no further call helps."""


def with_retry(call: Callable[..., Any], *args, attempts: int = ATTEMPTS, sleep: Callable[[float], None] = time.sleep) -> Any:
    """``call(*args)``; transport failures are tried again after 2 and 4 seconds, or as the provider asks (a second more, 75 at most)."""
    for k in range(attempts):
        try:
            return call(*args)
        except Retryable as e:
            if k == attempts - 1:
                raise
            sleep(min(e.after + 1, LONGEST_WAIT) if e.after is not None else FIRST_WAIT * 2**k)
    raise AssertionError("no attempt was made")


def extract(images: DataFrame, provider: Callable[[bytes], dict]) -> DataFrame:
    """``path, receipt`` for ``images(path, content)``."""
    fields = [f.name for f in RECEIPT]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [with_retry(provider, c) for c in f["content"]]
            yield pd.DataFrame({"path": f["path"], "receipt": [{k: g.get(k) for k in fields} for g in got]})

    return images.select("path", "content").mapInPandas(run, f"path string, receipt {RECEIPT.simpleString()}")


def ask(call: Callable[..., dict], text: str, store: str | None, others: Any) -> dict:
    """The answer of ``call`` to a string in the fields of a parse: asked once more with its store and siblings if it is not identified alone."""
    named = lambda p: bool((p.get("product") or "").strip()) and not p.get("needs_review")
    p, n = dict(call(text)), 1
    others = [] if others is None else list(others)
    if not named(p) and (store or others):
        again, n = dict(call(text, store, others)), 2
        p = again if named(again) else p
    return {f.name: p.get(f.name) for f in PARSED} | {"raw_description": text, "attempts": n}


def parse(items: DataFrame, provider: Callable[..., dict]) -> DataFrame:
    """``store, raw_description, parsed`` for ``items(store, raw_description, siblings)``.

    A string that is not identified alone is tried once more with its store and its siblings, if it has any; the
    second answer counts only if it identifies.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = [ask(functools.partial(with_retry, provider), d, store, others) for d, store, others in zip(f["raw_description"], f["store"], f["siblings"], strict=True)]
            yield pd.DataFrame({"store": f["store"], "raw_description": f["raw_description"], "parsed": out})

    got = items.select("store", "raw_description", "siblings").mapInPandas(run, f"store string, raw_description string, parsed {PARSED.simpleString()}")
    return got.withColumn("parsed", coerce_parsed(F.col("parsed")))


def parse_through_cache(items: DataFrame, cache: DataFrame, provider: Callable[..., dict]) -> tuple[DataFrame, DataFrame]:
    """Parses of all items and the cache with the new ones: only strings without a fresh parse are asked for, each once."""
    fresh = cache.filter(is_fresh(F.col("parsed")))
    keys = ["store", "raw_description"]
    asked = items.groupBy(*keys).agg(F.first("siblings").alias("siblings")).join(fresh, keys, "left_anti")
    new = parse(asked, provider)
    whole = fresh.unionByName(new)
    return items.select(*keys).distinct().join(whole, keys), whole


def embed(df: DataFrame, text: str, provider: Callable[[list[str]], Any]) -> DataFrame:
    """``df`` with unit-length ``embedding`` of a text column."""

    @F.pandas_udf("array<float>")
    def vectors(s: pd.Series) -> pd.Series:
        v = np.asarray(with_retry(provider, s.tolist()), np.float64)
        norm = np.linalg.norm(v, axis=1, keepdims=True)
        return pd.Series(list((v / np.where(norm > 0, norm, 1)).astype(np.float32)))

    return df.withColumn("embedding", vectors(F.coalesce(text, F.lit(""))))


def adjudicator(provider: Callable[[dict, dict], str], columns: tuple[str, ...] = ("brand", "product", "variant")) -> Callable[[DataFrame], DataFrame]:
    """A function for ``matching.resolve`` that asks for a verdict on unsure pairs; anything but same or different stays unsure."""

    def run(pairs: DataFrame) -> DataFrame:
        names = [*columns, *(f"c_{c}" for c in columns)]

        @F.pandas_udf("string")
        def ask(f: pd.DataFrame) -> pd.Series:
            said = [with_retry(provider, {c: r[c] for c in columns}, {c: r[f"c_{c}"] for c in columns}) for r in f.to_dict("records")]
            return pd.Series([x if x in ("same", "different") else "unsure" for x in said], dtype=object)

        return pairs.withColumn("verdict", ask(F.struct(*names)))

    return run
