"""Token counts of whole texts by a map-side lookup in two tiers; no pre-token is ever shuffled.

BPE merges within pre-tokens only, so a text's count is the sum over its pre-tokens. The first tier is a compact hash
table of the lengths of the commonest pre-tokens, broadcast to all executors: ``FREQUENT`` entries at most, whatever
the size of the corpus. What it lacks is encoded by the library, and kept in a cache of the worker that holds
about ``CACHED`` entries at most.

The commonest pre-tokens are counted over all documents: each task keeps a summary of ``FREQUENT`` counters (when
there are more, the next largest count is taken off all of them), and the summaries, one row for each task, are
merged ``FAN_IN`` at a time until one is left. The summary decides how fast counting is, never what it gives.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillmark.llm import pretokens
from tillmark.llm.common import arrow_map, map_arrow, raw_texts, written

FREQUENT, CACHED, FAN_IN = 32_768, 200_000, 32
#: Longer pre-tokens are encoded each time and not kept.
LONG = 256
#: Longer texts are counted piece by piece.
PIECE = 1 << 20


_CUT = re.compile(r"[0-9A-Za-z](?=[ \n])")


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """``text`` in pieces of about ``size``, cut only between a letter or digit of ASCII and a space or line end, where a pre-token ends in any text."""
    at = 0
    while len(text) - at > size and (spot := _CUT.search(text, at + size - 1)):
        yield text[at : spot.end()]
        at = spot.end()
    yield text[at:]


#: The letters that a vocabulary of this kind writes bytes as: a printable byte as itself, the others in turn as the code points from 256 on.
_PRINTED = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_LETTERS = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTED)}


class _Cache(dict):
    """Lengths of pre-tokens (bytes) by the library's merges, kept as they are asked for."""

    def __init__(self, model) -> None:  # noqa: ANN001
        self.tokenize = model.tokenize

    def __missing__(self, s: bytes) -> int:
        n = len(self.tokenize(s.decode("latin-1").translate(_LETTERS)))
        if len(s) <= LONG:
            self[s] = n
        return n


class _Counter:
    """Counts tokens in a worker: the broadcast table first, then the cache, then the library."""

    def __init__(self, spec: dict) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_buffer(spec["tokenizer"])
        self.added, self.classes, self.table = spec["added"], np.frombuffer(spec["classes"], np.uint8), spec["table"]
        self.cache = _Cache(self.library.model)

    def odd(self, text: str) -> bool:
        """Whether only the library can split ``text``: it holds an added token or a code point of no certain class."""
        if any(a in text for a in self.added):
            return True
        return not text.isascii() and bool((self.classes[np.frombuffer(text.encode("utf-32-le"), np.uint32)] == pretokens.UNKNOWN).any())

    def by_library(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.library.encode_batch(texts, add_special_tokens=False)]

    def lengths(self, data: bytes, start: np.ndarray) -> np.ndarray:
        """Tokens of each pre-token."""
        low, high, size = pretokens.short_keys(data, start)
        short = size <= pretokens.SHORT
        out = np.zeros(len(start), np.int64)
        out[short] = self.table.get(low[short], high[short])
        miss = np.flatnonzero(out == 0)
        if len(miss):
            end = np.append(start[1:], len(data))
            out[miss] = [self.cache[data[a:b]] for a, b in zip(start[miss].tolist(), end[miss].tolist(), strict=True)]
            if len(self.cache) > CACHED:  # by no more than a batch has
                self.cache.clear()
        return out

    def count(self, texts: list[str]) -> list[int]:
        total = [0] * len(texts)
        owner, plain = [], []
        for k, text in enumerate(texts):
            for piece in pieces(text):
                if self.odd(piece):
                    total[k] += self.by_library([piece])[0]
                else:
                    owner.append(k)
                    plain.append(piece)
        data, start, n = pretokens.split(plain, self.classes)
        upto = np.concatenate(([0], np.cumsum(self.lengths(data, start))))
        last = np.cumsum(n)
        for k, x in zip(owner, (upto[last] - upto[last - n]).tolist(), strict=True):
            total[k] += x
        return total


_counters: dict[str, _Counter] = {}


def _counter(key: str, spec: dict) -> _Counter:
    """The worker's counter; a worker that serves another tokenizer or table drops the old one."""
    if key not in _counters:
        _counters.clear()
        _counters[key] = _Counter(spec)
    return _counters[key]


class _Summary:
    """Counts of the commonest keys in bounded memory: a count is too low by the keys' total over ``most`` at most."""

    def __init__(self, most: int) -> None:
        self.most, self.held, self.n = most, [], 0

    def add(self, low: np.ndarray, high: np.ndarray, count: np.ndarray) -> None:
        self.held.append((low, high, count))
        self.n += len(low)
        if self.n > 8 * self.most:
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        low, high, count = (np.concatenate(x) for x in zip(*self.held, strict=True)) if self.held else (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
        _, first, inverse = np.unique(pretokens.mix(low, high), return_index=True, return_inverse=True)
        total = np.bincount(inverse, weights=count, minlength=len(first)).astype(np.int64)
        low, high = low[first], high[first]
        if len(total) > self.most:
            total = total - np.partition(total, -self.most - 1)[-self.most - 1]
            low, high, total = low[total > 0], high[total > 0], total[total > 0]
        self.held, self.n = [(low, high, total)], len(low)
        return low, high, total

    def row(self) -> pa.RecordBatch:
        low, high, count = self.settle()
        return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (low, high, count)], names=["low", "high", "n"])


_SUMMARY = "low binary, high binary, n binary"


def frequent(docs: DataFrame, text: str = "text", most: int = FREQUENT) -> list[tuple[bytes, int]]:
    """The commonest pre-tokens of up to 15 bytes over all of ``docs`` with lower bounds of their counts, commonest first: ``most`` at most."""
    spark = docs.sparkSession
    classes = spark.sparkContext.broadcast(pretokens.class_table().tobytes())

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, kept = np.frombuffer(classes.value, np.uint8), _Summary(most)
        for batch in batches:
            data, start, _ = pretokens.split([p for t in raw_texts(batch, "text") for p in pieces(t.decode(errors="replace"))], kinds)
            low, high, size = pretokens.short_keys(data, start)
            low, high = low[size <= pretokens.SHORT], high[size <= pretokens.SHORT]
            _, first, n = np.unique(pretokens.mix(low, high), return_index=True, return_counts=True)
            kept.add(low[first], high[first], n)
        yield kept.row()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = _Summary(most)
        for batch in batches:
            for low, high, n in zip(*(batch.column(c).to_pylist() for c in ("low", "high", "n")), strict=True):
                kept.add(np.frombuffer(low, np.uint64), np.frombuffer(high, np.uint64), np.frombuffer(n, np.int64))
        yield kept.row()

    found, _ = written(arrow_map(docs.select(F.col(text).alias("text")), summarise, _SUMMARY), "token-summaries")
    left = found.count()
    while left > 1:
        # Summaries are dealt by their number within their task, not by a key of the corpus.
        n = -(-left // FAN_IN)
        found, _ = written(arrow_map(found.repartition(n), merge, _SUMMARY), "token-summaries")
        left = min(n, found.count())
    row = found.head()
    low, high, n = (np.frombuffer(x, t) for x, t in zip(row, (np.uint64, np.uint64, np.int64), strict=True)) if row else ([], [], [])
    order = np.lexsort((high, low, -np.asarray(n, np.int64)))
    return [(pretokens.key_bytes(int(low[k]), int(high[k])), int(n[k])) for k in order]


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text", limit: int = 1024, most: int = FREQUENT) -> DataFrame:
    """``id_col, n_bytes, n_tokens, over_limit`` for each row of ``docs``, as the library counts by the file ``tokenizer``.

    The file must be a byte-level BPE with its usual pattern, without normaliser; else this raises ``ValueError``. The
    driver reads it and sends its contents along (a vocabulary's size), so executors need no such file. Added tokens
    within texts count as the library's default has it: once each. A null text is empty and has no tokens; null and
    repeated ids are kept, each row counts by itself; an empty table gives no rows; other columns are left out,
    whatever their names. Very long texts are counted in pieces. Texts with an added token, or with a code point that
    this Python's Unicode does not know, are given to the library as they are.
    """
    spark = docs.sparkSession
    raw = Path(tokenizer).read_bytes()
    said = json.loads(raw)
    usual = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    if said.get("normalizer") or said["model"].get("type") != "BPE" or {k: (said.get("pre_tokenizer") or {}).get(k) for k in usual} != usual:
        raise ValueError(f"{tokenizer} is not a byte-level BPE with the usual pattern")
    if any(x.get("lstrip") or x.get("rstrip") or any(c.isspace() for c in x["content"]) for x in said.get("added_tokens", [])):
        raise ValueError(f"{tokenizer} has added tokens that take white space")
    from tokenizers import Tokenizer

    library = Tokenizer.from_buffer(raw)
    common = [w for w, _ in frequent(docs, text, most)]
    lengths = [len(e.ids) for e in library.encode_batch([w.decode(errors="replace") for w in common], add_special_tokens=False)]
    low, high, _ = pretokens.short_keys(b"".join(common), np.cumsum([0, *map(len, common)])[:-1])
    spec = {"tokenizer": raw, "added": [x["content"] for x in said.get("added_tokens", [])], "classes": pretokens.class_table().tobytes(), "table": pretokens.Table(low, high, np.array(lengths, np.uint8))}
    sent, key = spark.sparkContext.broadcast(spec), os.urandom(8).hex()

    def run(batch: pa.RecordBatch) -> dict:
        texts = [t.decode(errors="replace") for t in raw_texts(batch, "text")]
        return {"id": batch.column("id"), "n_bytes": batch.column("n_bytes"), "n_tokens": _counter(key, sent.value).count(texts)}

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = map_arrow(rows, run, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
