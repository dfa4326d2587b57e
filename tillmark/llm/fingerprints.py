"""Weighted SimHash fingerprints and permuted block tables.

A text's terms are its pairs of neighbouring words (the first with a mark of
the beginning); each votes on 64 signed bits with weight 1 + log2 of its count,
rounded down. Five blocks of bits in ten permuted tables find every pair of
fingerprints within three bits: they agree on two blocks at least, and a pair is
taken in the first table in which it does.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillmark.llm.common import arrow_map

RADIUS = 3
BOUNDS = (0, 13, 26, 39, 52, 64)
TABLES = list(combinations(range(5), 2))
#: Texts are hashed together up to so many bytes.
CHUNK_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUE = np.array([int.from_bytes(hashlib.blake2b(bytes([b]), digest_size=8, salt=b"term").digest(), "little") for b in range(256)], np.uint64)
_BASE = np.uint64(0xD1342543DE82EF95)
_UP: list[np.ndarray] = []


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _UP or len(_UP[0]) <= n:
        _UP.clear()
        for x in (_BASE, np.uint64(pow(int(_BASE), -1, 1 << 64))):
            a = np.full(n + 1, x, np.uint64)
            a[0] = 1
            _UP.append(np.multiply.accumulate(a))
    return _UP[0], _UP[1]


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each lower-cased word, and the index of the first word of each text (and of the end)."""
    joined = b"\n".join(texts)
    data = _LOWER[np.frombuffer(joined, np.uint8)] if joined else np.empty(0, np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate(([False], ~_SPACE[data], [False])).view(np.int8)))
    begin, end = edge[::2], edge[1::2]
    up, down = _powers(max(len(data), CHUNK_BYTES))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * up[: len(data)], out=sums[1:])
    first = np.searchsorted(begin, np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts]))))
    return _mixed((sums[end] - sums[begin]) * down[begin]), first


def distinct_terms(term: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms of each text (40 bits), how often each stands there, and where each text's begin."""
    doc = np.repeat(np.arange(len(first) - 1, dtype=np.uint64), np.diff(first))
    # texts of a chunk in the upper 24 bits, 40 bits tell a text's terms apart
    key = np.sort((doc << np.uint64(40)) | (term >> np.uint64(24)))
    at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
    count = np.diff(np.append(at, len(key)))
    key = key[at]
    runs = np.searchsorted(key, np.arange(len(first), dtype=np.uint64) << np.uint64(40))
    return key & np.uint64((1 << 40) - 1), count, runs


def vote(terms: np.ndarray, weight: np.ndarray | None, runs: np.ndarray, seed: int = 1) -> np.ndarray:
    """Bits with more than half the weight of each run of terms; an empty run has none."""
    out = np.zeros(len(runs) - 1, np.uint64)
    h = _mixed(terms + np.uint64(seed))
    some = np.flatnonzero(np.diff(runs))
    step, k = 100_000, 0
    while k < len(some):  # whole texts, about so many terms at once
        to = max(k + 1, int(np.searchsorted(runs[some], runs[some[k]] + step)))
        lo, hi = runs[some[k]], runs[some[to - 1] + 1]
        bits = np.unpackbits(h[lo:hi].view(np.uint8), bitorder="little").reshape(-1, 64)
        starts = runs[some[k:to]] - lo
        got = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        total = np.diff(np.append(starts, hi - lo))
        if weight is not None:
            w = weight[lo:hi]
            extra = np.flatnonzero(w > 1)
            if len(extra):
                own = np.searchsorted(starts, extra, side="right") - 1
                np.add.at(got, own, bits[extra] * (w[extra] - 1)[:, None])
            total = np.add.reduceat(w, starts)
        out[some[k:to]] = np.packbits(2 * got > total[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
        k = to
    return out


def _votes(texts: list[bytes]) -> np.ndarray:
    word, first = words(texts)
    before = np.concatenate(([np.uint64(0)], word[:-1])) if len(word) else word
    before[first[:-1][first[:-1] < first[1:]]] = np.uint64(0x5BD1E995)
    terms, count, runs = distinct_terms(_mixed(before * np.uint64(3) + word), first)
    return vote(terms, (1 + np.floor(np.log2(np.maximum(1, count)))).astype(np.int32), runs)


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """Fingerprint of each text as an unsigned 64-bit number; a text without words has 0."""
    out, at = np.zeros(len(texts), np.uint64), 0
    ends = np.cumsum([len(t) + 1 for t in texts]) if texts else np.empty(0, np.int64)
    while at < len(texts):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + CHUNK_BYTES, side="right")))
        out[at:to] = _votes(texts[at:to])
        at = to
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal bits."""
    return 1 - np.bitwise_count(a ^ b) / 64


def with_next(df: DataFrame, part_rows: int = 4096, max_parts: int = 10_000) -> DataFrame:
    """``part, look, doc_id, text`` dealt so that each row's successor by ``doc_id`` stands in its part.

    Parts are ranges of ids of about ``part_rows`` rows. Of each part the rows with the
    first id are also sent to the part before (``look`` 1), those of the first part to
    the last. Only ids are read to find the parts; the driver gets one row for each part.
    """
    base = df.select("doc_id", "text")
    n = base.count()
    parts = max(1, min(max_parts, n // part_rows))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    cuts = sorted(set(base.select(key.alias("k")).approxQuantile("k", [i / parts for i in range(1, parts)], max(1e-4, 0.2 / parts)))) if n and parts > 1 else []
    part = F.expr(f"size(filter(array({', '.join(f'{int(c)}L' for c in cuts)}), c -> c <= coalesce(cast(doc_id as long), -9223372036854775808L)))") if cuts else F.lit(0)
    base = base.withColumn("part", part.cast("int"))
    first = sorted((r["part"], r["k"]) for r in base.groupBy("part").agg(F.min(key).alias("k")).collect())
    back = {k: first[i - 1][0] for i, (_, k) in enumerate(first)}
    target = F.lit(None).cast("int")
    if back:
        look = df.sparkSession.createDataFrame([(k, p) for k, p in back.items()], "k long, before int")  # a row for each part
        both = base.withColumn("k", key).join(F.broadcast(look), "k", "left")
    else:
        both = base.withColumn("before", target)
    sent = both.select("doc_id", "text", F.expr("explode(if(before is null, array(struct(part, 0 as look)), array(struct(part, 0 as look), struct(before as part, 1 as look))))").alias("to"))
    return sent.select("to.part", "to.look", "doc_id", "text").repartition(max(1, len(first)), "part").sortWithinPartitions("part", "look", "doc_id", "text")


OUT = "n_chars long, edited_sha256 string, fp long, edited_fp long, near_edited double, near_next double"


def _edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: tuple | None = None  # the last row so far that is not a look ahead
    for batch in batches:
        texts = ["" if t is None else t for t in batch.column("text").to_pylist()]
        parts, looks = batch.column("part").to_pylist(), batch.column("look").to_pylist()
        ids = batch.column("doc_id").to_pylist()
        fps = fingerprints([t.encode() for t in texts])
        rows = []  # id, text, fingerprint, next text, next fingerprint
        for i in range(len(texts)):
            if held and held[0] == parts[i]:
                rows.append((held[1], held[2], held[3], texts[i], fps[i]))
            held = (parts[i], ids[i], texts[i], fps[i]) if not looks[i] else None
        if rows:
            edited, n = [], []
            for _, t, _, nxt, _ in rows:
                k = len(t) // 4
                edited.append((t[: len(t) - k] + nxt[:k]).encode())
                n.append(len(t))
            fp, nfp = np.array([r[2] for r in rows], np.uint64), np.array([r[4] for r in rows], np.uint64)
            efp = fingerprints(edited)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], batch.column("doc_id").type), pa.array(n, pa.int64()), pa.array([hashlib.sha256(e).hexdigest() for e in edited]), pa.array(fp.view(np.int64)), pa.array(efp.view(np.int64)), pa.array(likeness(fp, efp)), pa.array(likeness(fp, nfp))],
                names=["doc_id", "n_chars", "edited_sha256", "fp", "edited_fp", "near_edited", "near_next"],
            )


def edited_likeness(df: DataFrame) -> DataFrame:
    """Each row's fingerprint, that of its edited text, and how like they and the next row's are.

    The last quarter of the code points (rounded down) gives way to as many from
    the beginning of the next row by ``doc_id`` (ties by text; after the last the first;
    null ids stand first). Null texts count as empty; one row is its own next.
    """
    id_type = dict(df.dtypes)["doc_id"]
    return arrow_map(with_next(df), _edit, f"doc_id {id_type}, {OUT}")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys, fps = [], []
    for b in batches:
        keys.append(b.column("key").to_numpy(zero_copy_only=False))
        fps.append(b.column("fp").to_numpy(zero_copy_only=False))
    if not keys:
        return
    key, fp = np.concatenate(keys), np.concatenate(fps).view(np.uint64)
    order = np.argsort(key, kind="stable")
    key, fp = key[order], fp[order]
    table = key >> 58
    masks = np.array([((1 << (BOUNDS[k + 1] - BOUNDS[k])) - 1) << BOUNDS[k] for k in range(5)], np.uint64)
    near = np.zeros(len(fp), np.int64)
    live, d = np.arange(len(fp)), 0
    while len(live):
        d += 1
        live = live[live + d < len(fp)]
        live = live[key[live] == key[live + d]]
        for at in range(0, len(live), 1 << 20):
            i = live[at : at + (1 << 20)]
            x = fp[i] ^ fp[i + d]
            i, x = i[ok := np.bitwise_count(x) <= RADIUS], x[ok]
            agree = [(x & m) == 0 for m in masks]
            here = np.full(len(i), -1)
            for t in range(len(TABLES) - 1, -1, -1):  # the first table in which the pair agrees
                here[agree[TABLES[t][0]] & agree[TABLES[t][1]]] = t
            i = i[here == table[i]]
            np.add.at(near, i, 1)
            np.add.at(near, i + d, 1)
    some = near > 0
    yield pa.RecordBatch.from_arrays([pa.array(fp[some].view(np.int64)), pa.array(near[some])], names=["fp", "n_near"])


def near_counts(fps: DataFrame) -> DataFrame:
    """``fp, n_near`` for each of the distinct ``fps(fp)`` that has others within three bits: how many."""
    part = lambda k: f"(shiftrightunsigned(fp, {BOUNDS[k]}) & {(1 << (BOUNDS[k + 1] - BOUNDS[k])) - 1}L)"
    tables = ", ".join(f"({t}L << 58) | ({part(a)} << 13) | {part(b)}" for t, (a, b) in enumerate(TABLES))
    keyed = fps.selectExpr("fp", f"explode(array({tables})) as key")
    return arrow_map(keyed.repartition("key"), _count, "fp long, n_near long").groupBy("fp").agg(F.sum("n_near").alias("n_near"))
