"""Benchmark decontamination by an FM-index of each training shard.

A shard is one batch of whole documents. A word that the benchmark cannot have (by
a filter of fixed size) matches nothing and ends a run, and a run shorter than the
shortest test phrase cannot hold one and is left out. Over the runs stands one
FM-index, whose symbols are the shard's own words: test phrases are found by
backward search with wavelet-tree ranks, their places by sampled suffix positions,
and the found words are checked byte for byte before their spans are merged. The documents
are not shuffled and go by once. The executors make blocks of ``block_bytes`` of the
benchmark; each shard is searched for one block after the other, and a worker
holds one block at a time.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillmark.llm.common import arrow_map, drop_path, written
from tillmark.llm.fm_index import FMIndex

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BLOCK_BYTES = 2 << 20
#: Bits of the filter of words that the benchmark has, whatever its size: more words in a filter only leave more in the index.
FILTER_BITS = 24
#: Documents are concatenated up to so many bytes for one shard.
SHARD_BYTES = 4 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_VALUE = np.array([int.from_bytes(hashlib.blake2b(bytes([b]), digest_size=8).digest(), "little") for b in range(256)], np.uint64)
_CHUNK = 1 << 20
_POWERS: list[np.ndarray] = []


def _powers() -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for x in (_BASE, inverse):
            a = np.full(_CHUNK + 1, x, np.uint64)
            a[0] = 1
            _POWERS.append(np.multiply.accumulate(a))
    return _POWERS[0], _POWERS[1]


def words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end and a 64-bit hash of each word of lower-cased bytes."""
    inside = _IS_WORD[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    begin, end = edge[::2], edge[1::2]
    up, down = _powers()
    hashes = np.empty(len(begin), np.uint64)
    at = 0
    while at < len(begin):  # chunks of whole words
        base = begin[at]
        to = max(at + 1, int(np.searchsorted(end, base + _CHUNK, side="right")))
        b, e = begin[at:to] - base, end[at:to] - base
        if e[-1] > _CHUNK:  # one word longer than a chunk
            hashes[at] = np.frombuffer(hashlib.blake2b(data[base : base + e[-1]].tobytes(), digest_size=8).digest(), np.uint64)[0]
        else:
            sums = np.zeros(e[-1] + 1, np.uint64)
            np.cumsum(_VALUE[data[base : base + e[-1]]] * up[: e[-1]], out=sums[1:])
            hashes[at:to] = (sums[e] - sums[b]) * down[b]
        at = to
    hashes ^= hashes >> np.uint64(32)
    return begin, end, hashes * np.uint64(0xD6E8FEB86659FD93)


class Phrases:
    """The windows of one block of benchmark items."""

    def __init__(self, items: list[tuple[object, str | None]], width: int) -> None:
        texts = [(i, WORD.findall((t or "").encode().translate(bytes(_LOWER)))) for i, t in items]
        self.words = sorted({w for _, ws in texts for w in ws})
        of = {w: k for k, w in enumerate(self.words)}
        self.hashes = words_of(np.frombuffer(b" ".join(self.words), np.uint8))[2] if self.words else np.empty(0, np.uint64)
        windows: dict[tuple[int, ...], set[int]] = {}
        self.ids: list[str] = sorted({str(i) for i, _ in texts if i is not None})
        place = {i: k for k, i in enumerate(self.ids)}
        for i, ws in texts:
            if i is None:
                continue
            s = [of[w] for w in ws]
            for k in range(max(1, len(s) - width + 1) if s else 0):
                windows.setdefault(tuple(s[k : k + width]), set()).add(place[str(i)])
        self.by_length = {}
        for m in sorted({len(w) for w in windows}):
            of_m = [w for w in windows if len(w) == m]
            owners = [sorted(windows[w]) for w in of_m]
            begins = np.concatenate(([0], np.cumsum([len(o) for o in owners])))
            self.by_length[m] = (np.array(of_m, np.int32), begins, np.array([x for o in owners for x in o], np.int32))
        self.shortest = min(self.by_length, default=0)


class Blocks:
    """The blocks of a benchmark as the executors get them: each a broadcast of its own, and a filter of the words of all."""

    def __init__(self, shared: list[Broadcast], may_have: np.ndarray, shortest: int) -> None:
        self.shared, self.may_have, self.shortest = shared, may_have, shortest
        self.held: tuple[int, Phrases] | None = None

    def __iter__(self) -> Iterator[Phrases]:
        for k, b in enumerate(self.shared):
            if self.held is None or self.held[0] != k:
                self.held = None  # before the next is read
                self.held = k, pickle.loads(b.value)
                b.__dict__.pop("_value", None)  # the worker would keep what it has read
            yield self.held[1]

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """Whether the benchmark may have a word of each hash."""
        at = (hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
        return (self.may_have[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def blocks_of(benchmark: DataFrame, width: int, block_bytes: int) -> Blocks:
    """The benchmark in blocks that the executors make; they pass through the driver one at a time, as bytes."""
    spark = benchmark.sparkSession
    items = benchmark.select("item_id", "text")
    total = items.agg(F.sum(F.octet_length("text"))).head()[0] or 0

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def block() -> pa.RecordBatch:
            p = Phrases(held, width)
            return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(p)], pa.binary()), pa.array([np.unique(p.hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int32)], pa.list_(pa.int32())), pa.array([p.shortest], pa.int32())], names=["block", "bits", "shortest"])

        for batch in batches:
            for i, x in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                held.append((i, x))
                size += len(x or "")
                if size >= block_bytes:
                    yield block()
                    held, size = [], 0
        if held:
            yield block()

    made, at = written(arrow_map(items.repartition(max(1, -(-total // (8 * block_bytes)))), pack, "block binary, bits array<int>, shortest int"), "benchmark")
    shared, may_have, shortest = [], np.zeros(1 << FILTER_BITS - 3, np.uint8), 0
    for r in made.toLocalIterator():
        shared.append(spark.sparkContext.broadcast(bytes(r["block"])))
        bits = np.array(r["bits"], np.int64)
        np.bitwise_or.at(may_have, bits >> 3, np.uint8(1) << (bits & 7).astype(np.uint8))
        shortest = min(shortest or r["shortest"], r["shortest"] or shortest)
    drop_path(spark, at)
    return Blocks(shared, may_have, shortest)


def scan_shard(texts: list[bytes], blocks: Blocks) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[list[str]]]:
    """Begin and end bytes of all words (of the joined texts), which are hit, words before each text (and all), items of each text."""
    n = len(texts)
    joined = b"\x00".join(texts)
    data = _LOWER[np.frombuffer(joined, np.uint8)] if joined else np.empty(0, np.uint8)
    begin, end, hashes = words_of(data)
    starts = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts]))).astype(np.int64)
    first = np.searchsorted(begin, starts)
    hit = np.zeros(len(begin), bool)
    items: list[set[str]] = [set() for _ in range(n)]
    # runs of words that the benchmark may have, within a text: a text's first word begins a run
    breaks = ~blocks.known(hashes) if blocks.shortest else np.ones(len(begin), bool)
    new_text = np.zeros(len(begin) + 1, bool)
    new_text[first] = True
    run_begin = np.flatnonzero(~breaks & (np.concatenate(([True], breaks[:-1])) | new_text[:-1]))
    run_end = np.flatnonzero(~breaks & (np.concatenate((breaks[1:], [True])) | new_text[1:])) + 1
    long_ = run_end - run_begin >= blocks.shortest
    run_begin, run_end = run_begin[long_], run_end[long_]
    if not len(run_begin):
        return begin, end, hit, first, [[] for _ in texts]
    lengths = run_end - run_begin + 1  # with the closing 0
    stops = np.cumsum(lengths)
    word_at = np.arange(stops[-1]) - np.repeat(stops - lengths - run_begin, lengths)
    closing = np.zeros(len(word_at), bool)
    closing[stops - 1] = True
    own, number = np.unique(hashes[word_at[~closing]], return_inverse=True)  # the shard's words
    s = np.zeros(len(word_at), np.int64)
    s[~closing] = number + 1
    index = FMIndex(s, len(own))
    deltas = np.zeros(len(begin) + 1, np.int64)
    for phrases in blocks:
        k = np.minimum(np.searchsorted(own, phrases.hashes), len(own) - 1)
        symbol = np.where(own[k] == phrases.hashes, k + 1, 0)
        for m, (patterns, owner_at, owners) in phrases.by_length.items():
            here = symbol[patterns]
            some = np.flatnonzero((here > 0).all(1))  # the others have a word that the shard has not
            lo, hi = index.search(here[some])
            found = np.flatnonzero(hi > lo)
            if not len(found):
                continue
            counts = hi[found] - lo[found]
            rows = np.repeat(lo[found] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())
            which = np.repeat(some[found], counts)
            at = word_at[index.locate(rows)]
            # words by their bytes, as hashes may collide
            same = np.ones(len(at), bool)
            seen: dict[tuple[int, bytes], bool] = {}
            for j, (w, a, b) in enumerate(zip(which.tolist(), begin[at].tolist(), end[at + m - 1].tolist(), strict=True)):
                raw = data[a:b].tobytes()
                if (ok := seen.get((w, raw))) is None:
                    ok = seen[w, raw] = WORD.findall(raw) == [phrases.words[c] for c in patterns[w]]
                same[j] = ok
            at, which = at[same], which[same]
            np.add.at(deltas, at, 1)
            np.add.at(deltas, at + m, -1)
            doc = np.searchsorted(first, at, side="right") - 1
            n_own = owner_at[which + 1] - owner_at[which]
            flat = np.repeat(owner_at[which] - np.concatenate(([0], np.cumsum(n_own)[:-1])), n_own) + np.arange(n_own.sum()) if len(which) else np.empty(0, np.int64)
            for x in np.unique(np.repeat(doc, n_own) * len(phrases.ids) + owners[flat]).tolist():
                items[x // len(phrases.ids)].add(phrases.ids[x % len(phrases.ids)])
    return begin, end, np.cumsum(deltas[:-1]) > 0, first, [sorted(x) for x in items]


def _shards(batch: pa.RecordBatch, bound: int) -> Iterator[pa.RecordBatch]:
    sizes = np.array([len(x.as_buffer() or b"") if x.is_valid else 0 for x in batch.column("text").cast(pa.binary())] + [0], np.int64)
    at = 0
    while at < batch.num_rows:
        to = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:-1]), bound, side="right")))
        yield batch.slice(at, to - at)
        at = to


def contamination(df: DataFrame, benchmark: DataFrame, width: int = 10, block_bytes: int = BLOCK_BYTES, clean: bool = False) -> DataFrame:
    """Words, hit words and items of each row, or with ``clean`` the texts without the hit passages.

    ``df`` has ``doc_id`` and ``text``. Without ``clean`` the columns are ``doc_id, n_words, n_hit,
    items`` (array of strings, sorted as strings) and ``spans`` (array of the first and end
    byte of each maximal hit passage); with it ``df``'s own columns, where ``text`` has lost each
    passage from its first hit word to its last (and ``n_chars``, if there is one, is
    counted again). A null text has no words and stays null; null ids are kept, repeated rows
    each count, empty tables give no rows; other columns are left alone, whatever their names. A text
    longer than a shard is a shard of its own. Items with a null id or no words have no windows; items
    with fewer than ``width`` words are one window; items with equal ids are one, items with equal windows are each found.
    """
    made = blocks_of(benchmark, width, block_bytes)
    parts, shortest = made.shared, made.shortest
    may_have = df.sparkSession.sparkContext.broadcast(made.may_have)  # of fixed size
    columns = df.columns if clean else ["doc_id"]
    base = df if clean else df.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = Blocks(parts, may_have.value, shortest)
        for whole in batches:
            for batch in _shards(whole, SHARD_BYTES):
                texts = [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]
                begin, end, hit, first, items = scan_shard(texts, blocks)
                n_words = np.diff(first)
                total = np.concatenate(([0], np.cumsum(hit)))
                n_hit = total[first[1:]] - total[first[:-1]]
                spans: list[list[list[int]]] = [[] for _ in texts]
                at0 = 0
                for j, t in enumerate(texts):
                    if n_hit[j]:
                        h = hit[first[j] : first[j + 1]]
                        edge = np.flatnonzero(np.diff(np.concatenate(([False], h, [False])).view(np.int8))) + first[j]
                        spans[j] = [[int(begin[a] - at0), int(end[b - 1] - at0)] for a, b in zip(edge[::2], edge[1::2], strict=True)]
                    at0 += len(t) + 1
                cols = {c: batch.column(c) for c in columns}
                if clean and any(spans):
                    null = batch.column("text").is_null().to_pylist()
                    cut = [None if z else b"".join(t[a:b] for a, b in zip([0, *(y for _, y in sp)], [*(x for x, _ in sp), len(t)], strict=True)).decode() for t, sp, z in zip(texts, spans, null, strict=True)]
                    cols["text"] = pa.array(cut, pa.string())
                    if "n_chars" in cols:
                        cols["n_chars"] = pa.array([len(c) if sp else n for c, sp, n in zip(cut, spans, batch.column("n_chars").to_pylist(), strict=True)], batch.column("n_chars").type)
                if not clean:
                    cols |= {"n_words": pa.array(n_words, pa.int64()), "n_hit": pa.array(n_hit, pa.int64()), "items": pa.array(items, pa.list_(pa.string())), "spans": pa.array(spans, pa.list_(pa.list_(pa.int64())))}
                yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema if f.name in columns)
    return arrow_map(base, run, own if clean else f"{own}, n_words long, n_hit long, items array<string>, spans array<array<long>>")
