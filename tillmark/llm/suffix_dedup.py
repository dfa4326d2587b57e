"""Removal of repeated byte strings by external induced suffix sorting.

A byte goes if a string of ``length`` bytes over it also starts in a document with
a smaller id. Documents are packed into rows of some megabytes (shards, compressed)
that later passes read and join as they are. Then:

1. Every window of ``length`` bytes names an anchor, the least hash of the 20-byte
   strings in it, so equal windows name equal anchors. Anchors are counted over
   all shards, which list each of their texts once; those of one document only
   are done with.
2. Each shard sends the text around the other anchors, once for each distinct
   piece, with the smallest id that has it, to the bucket of the anchor.
3. A bucket's pieces go to a file as they come and form one string, but for those whose
   anchor no other piece has: they share no window with any. Its suffixes are sorted with their
   common prefixes by external induced sorting (``induced_sort``), and runs that
   share ``length`` bytes learn the smallest id among them.
4. What the bucket found returns to the shards, which cut.

Copies of a whole text beyond the first are told by a digest and take no part in
2 and 3: they are removed whole. A shard sends at most one piece of a kind, so no
bucket grows with the number of documents that share a passage.
"""

from __future__ import annotations

import hashlib
import os
import struct
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillmark.llm.common import arrow_map, free_shuffles, written
from tillmark.llm.induced_sort import CAP, new_map, suffix_order

LENGTH = 50
GRAM = 20
#: Bytes of text in a shard, and of all text for each bucket: there are as many buckets as that takes.
SHARD_BYTES, BUCKET_BYTES = 1 << 20, 16 << 20
#: Bytes of pieces of a bucket among which equal ones are told at once; later ones meet in the sort.
FOLD_BYTES = 16 << 20
FIRST_ID = -(1 << 63)

#: Bits of a hash that an anchor's number leaves out: with its flag it takes six bytes. Strangers with one number only make more pieces.
_SHIFT = np.uint64(17)

_CHUNK = 1 << 19
_VALUE = np.array([int.from_bytes(hashlib.blake2b(bytes([b]), digest_size=8, salt=b"anchor").digest(), "little") for b in range(256)], np.uint64)
_BASE = 0xD1342543DE82EF95
_UP = np.multiply.accumulate(np.array([1] + [_BASE] * (_CHUNK + 4096), np.uint64))
_DOWN = np.multiply.accumulate(np.array([1] + [pow(_BASE, -1, 1 << 64)] * (_CHUNK + 4096), np.uint64))


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` bytes from each position of a chunk."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * _UP[: len(data)], out=sums[1:])
    h = (sums[GRAM:] - sums[:-GRAM]) * _DOWN[: len(data) - GRAM + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def anchors(data: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor in texts laid end to end (``ends``): first window, number of windows, hash.

    A window's anchor is the leftmost gram in it with the least hash; windows lie within one text.
    """
    spread = length - GRAM + 1
    begins, counts, hashes = [], [], []
    starts = np.concatenate(([0], ends[:-1]))
    usable = np.zeros(len(data) + 1, np.int32)  # windows that fit into their text
    ok = ends - starts >= length
    np.add.at(usable, starts[ok], 1)
    np.add.at(usable, ends[ok] - length + 1, -1)
    usable = np.cumsum(usable[:-1]) > 0
    bits = np.uint64(20)
    low = (np.uint64(1) << bits) - np.uint64(1)
    for at in range(0, len(data) - length + 1, _CHUNK):
        part = data[at : at + _CHUNK + length - 1]
        h = _gram_hashes(part)
        key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        least, have = key, 1
        while have < spread:
            step = min(have, spread - have)
            least = np.minimum(least[:-step], least[step:])
            have += step
        where = (least & low).astype(np.int64)
        fits = usable[at : at + len(where)]
        new = np.empty(len(where), bool)
        new[0] = True
        np.not_equal(where[1:], where[:-1], out=new[1:])
        new[1:] |= ~fits[:-1]
        run = np.flatnonzero(new & fits)
        stop = np.append(new, True)
        stop[:-1] |= ~fits
        edge = np.flatnonzero(stop)
        n = edge[np.searchsorted(edge, run, side="right")] - run
        begins.append(run + at)
        counts.append(n)
        hashes.append(h[where[run]])
    if not begins:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.concatenate(begins), np.concatenate(counts), np.concatenate(hashes)


def _digest(text: bytes) -> bytes:
    return hashlib.blake2b(text, digest_size=16).digest()


class Shard:
    """One packed row: a record batch, its texts end to end, and which documents are first of their text."""

    def __init__(self, blob: bytes, later: list[dict] | None, fold: bool = False) -> None:
        self.batch = pa.ipc.open_stream(zstandard.decompress(blob)).read_next_batch()
        self.texts = [x or b"" for x in self.batch.column("text").cast(pa.binary()).to_pylist()]
        self.ids = np.array([FIRST_ID if x is None else x for x in self.batch.column("doc_id").to_pylist()], np.int64)
        first_of = {x["k"]: x["first"] for x in later or []}
        number: dict[bytes, int] = {}  # distinct texts as _pack lists them
        kinds = [number.setdefault(_digest(t), len(number)) for t in self.texts] if first_of or fold else [0] * len(self.texts)
        if fold:  # one of each text of this shard, whatever other shards have
            self.later = np.ones(len(kinds), bool)
            self.later[np.unique(kinds, return_index=True)[1]] = False
        else:
            self.later = np.array([first_of.get(k, i) < i for k, i in zip(kinds, self.ids.tolist(), strict=True)], bool)
        self.first = np.flatnonzero(~self.later)
        self.data = np.frombuffer(b"".join(self.texts[i] for i in self.first), np.uint8)
        self.ends = np.cumsum([len(self.texts[i]) for i in self.first]).astype(np.int64)

    def pieces(self, repeated: np.ndarray, length: int = LENGTH) -> tuple[list[bytes], list[int], list[int], np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pieces, their anchors and smallest ids, and of each run its piece, first window and number of windows."""
        begin, n, h = anchors(self.data, self.ends, length)
        if len(repeated) and len(h):
            k = np.minimum(np.searchsorted(repeated, h >> _SHIFT), len(repeated) - 1)
            keep = repeated[k] == h >> _SHIFT
        else:
            keep = np.zeros(len(h), bool)
        begin, n, h = begin[keep], n[keep], h[keep]
        doc = np.searchsorted(self.ends, begin, side="right")
        ids = self.ids[self.first[doc]] if len(doc) else np.empty(0, np.int64)
        raw, number, of = self.data.tobytes(), {}, np.empty(len(begin), np.int64)
        lowest, anchor = [], []
        for j, (a, w, i, b) in enumerate(zip(begin.tolist(), n.tolist(), ids.tolist(), (h >> _SHIFT).tolist(), strict=True)):
            piece = raw[a : a + w + length - 1]
            k = of[j] = number.setdefault(piece, len(number))
            if k == len(lowest):
                lowest.append(i)
                anchor.append(b)
            elif i < lowest[k]:
                lowest[k] = i
        return list(number), anchor, lowest, of, begin, n


def _pack(df: DataFrame, shard_bytes: int) -> DataFrame:
    """Rows ``shard_id, size, blob, docs(digest, low, high)`` of about ``shard_bytes`` of text each: smallest and largest id of each distinct text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, held, size = TaskContext.get().partitionId(), 0, [], 0

        def shard() -> pa.RecordBatch:
            nonlocal made, held, size
            batch = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as w:
                w.write_batch(batch)
            blob = zstandard.ZstdCompressor(level=3).compress(sink.getvalue())
            span: dict[bytes, tuple[int, int]] = {}
            for x, i in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("doc_id").to_pylist(), strict=True):
                d, i = _digest(x or b""), FIRST_ID if i is None else i
                low, high = span.get(d, (i, i))
                span[d] = min(low, i), max(high, i)
            docs = pa.array([[{"digest": d, "low": a, "high": b} for d, (a, b) in span.items()]], pa.list_(pa.struct([("digest", pa.binary()), ("low", pa.int64()), ("high", pa.int64())])))
            out = pa.RecordBatch.from_arrays([pa.array([(task << 32) + made], pa.int64()), pa.array([size], pa.int64()), pa.array([blob], pa.binary()), docs], names=["shard_id", "size", "blob", "docs"])
            made, held, size = made + 1, [], 0
            return out

        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()
            at = 0
            for i, n in enumerate(lengths):
                size += n + 8
                if size >= shard_bytes:
                    held.append(batch.slice(at, i + 1 - at))
                    at = i + 1
                    yield shard()
            if at < batch.num_rows:
                held.append(batch.slice(at))
        if held:
            yield shard()

    return arrow_map(df, run, "shard_id long, size long, blob binary, docs array<struct<digest: binary, low: long, high: long>>")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            yield {c: b.column(c)[i].as_py() for c in b.schema.names}


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    now, group = None, []
    for r in _rows(batches):
        if r["bucket"] != now and group:
            yield now, group
            group = []
        now = r["bucket"]
        group.append(r)
    if group:
        yield now, group


def _six(keys: np.ndarray) -> bytes:
    """Numbers below 2 ** 48 in six bytes each."""
    return keys.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _from_six(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view(np.uint64)[:, 0]


def _count_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From each bucket to each of its shards: the anchors that two documents or more have."""
    for _, group in _by_bucket(batches):
        parts = [_from_six(r["keys"]) for r in group]
        keys = np.sort(np.concatenate(parts))  # an anchor, and as last bit whether its shard has it twice
        h = keys >> np.uint64(1)
        new = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        n = np.diff(np.append(new, len(h)))
        repeated = h[new][(n > 1) | (np.bitwise_or.reduceat(keys, new) & np.uint64(1) == 1)]
        if not len(repeated):
            continue
        for r, part in zip(group, parts, strict=True):
            own = part >> np.uint64(1)
            own = own[repeated[np.minimum(np.searchsorted(repeated, own), len(repeated) - 1)] == own]
            if len(own):
                yield pa.RecordBatch.from_arrays([pa.array([r["shard_id"]], pa.int64()), pa.array([own.tobytes()], pa.binary())], names=["shard_id", "anchors"])


def _payload(ks: list[int], pieces: list[bytes], anchor: list[int], lowest: list[int]) -> bytes:
    n, ids, own = np.array([len(pieces[k]) for k in ks], np.int32), np.array([lowest[k] for k in ks], np.int64), np.array([anchor[k] & 0x7FFFFFFF for k in ks], np.int32)
    return zstandard.compress(struct.pack("<q", len(ks)) + n.tobytes() + ids.tobytes() + own.tobytes() + b"".join(pieces[k] for k in ks), 3)


def _by_bucket_of(anchor: list[int], buckets: int) -> dict[int, list[int]]:
    """Places of the pieces that go to each bucket; the same in every pass."""
    where: dict[int, list[int]] = {}
    for k, h in enumerate(anchor):
        where.setdefault(h % buckets, []).append(k)
    return where


class _Bucket:
    """The pieces of one bucket in files: their bytes, and for each its length, smallest id and anchor; and what each shard sent."""

    def __init__(self, folder: str, fold_bytes: int) -> None:
        self.folder, self.fold_bytes, self.n = folder, fold_bytes, 0
        self.rows: list[tuple[int, int, int]] = []  # shard, bucket, pieces
        self.number: dict[bytes, int] = {}
        self.held = 0
        self.files = {name: open(f"{folder}/{name}", "wb") for name in ("bytes", "lengths", "anchors", "sent", "ids")}

    def add(self, row: dict) -> None:
        raw = zstandard.decompress(row["pieces"])
        (m,) = struct.unpack_from("<q", raw)
        lengths, ids, anchors_ = np.frombuffer(raw, np.int32, m, 8), np.frombuffer(raw, np.int64, m, 8 + 4 * m), np.frombuffer(raw, np.int32, m, 8 + 12 * m)
        at, sent, new = 8 + 16 * m, [], []
        for k, w in enumerate(lengths.tolist()):
            piece = raw[at : at + w]
            at += w
            if (own := self.number.get(piece)) is None:
                own = self.number[piece] = self.n + len(new)
                new.append(k)
                self.held += w
                self.files["bytes"].write(piece)
            sent.append(own)
        self.files["lengths"].write(lengths[new].tobytes())
        self.files["anchors"].write(anchors_[new].tobytes())
        self.files["sent"].write(np.array(sent, np.int32).tobytes())
        self.files["ids"].write(ids.tobytes())
        self.n += len(new)
        self.rows.append((row["shard_id"], row["bucket"], m))
        if self.held > self.fold_bytes:
            self.number, self.held = {}, 0

    def finish(self, length: int) -> Iterator[pa.RecordBatch]:
        self.number = {}
        for f in self.files.values():
            f.close()
        read = lambda name, dtype: np.memmap(f"{self.folder}/{name}", dtype, "r") if os.path.getsize(f"{self.folder}/{name}") else np.empty(0, dtype)
        data, lengths, anchors_, sent, ids = (read(n, d) for n, d in (("bytes", np.uint8), ("lengths", np.int32), ("anchors", np.int32), ("sent", np.int32), ("ids", np.int64)))
        lowest = new_map(self.folder, "lowest", self.n, np.int64)
        lowest[:] = np.iinfo(np.int64).max
        for at in range(0, len(sent), 1 << 18):
            np.minimum.at(lowest, sent[at : at + (1 << 18)], ids[at : at + (1 << 18)])
        windows = lengths.astype(np.int64) - length + 1
        order = np.argsort(anchors_, kind="stable")
        own = anchors_[order]
        same = own[1:] == own[:-1]
        alone = np.ones(self.n, bool)
        alone[order[np.append(same, False) | np.append(False, same)]] = False
        del order, own, same
        shared = np.flatnonzero(~alone)
        if len(shared):
            begins = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)[:-1]))
            ranked = np.unique(lowest)  # ids by their place
            of, least = _least_of(data, begins[shared], lengths[shared].astype(np.int64), np.searchsorted(ranked, lowest[shared]).astype(np.int32), length, self.folder)
            string_at = np.zeros(self.n, np.int64)
            string_at[shared] = of
        done = 0
        for shard, bucket, m in self.rows:
            k = np.asarray(sent[done : done + m])
            done += m
            w = windows[k]
            found = np.repeat(lowest[k], w)  # for each window of each piece, as if it stood alone
            some = ~alone[k]
            if some.any():
                found[np.repeat(some, w)] = ranked[least[_spread(string_at[k[some]], w[some])]]
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([bucket], pa.int32()), pa.array([zstandard.compress(found.tobytes(), 1)], pa.binary())], names=["shard_id", "bucket", "least"])


def _spread(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Places of runs of ``n`` that begin at each of ``begin``, one after the other."""
    return np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _sort_bucket(length: int, fold_bytes: int = FOLD_BYTES):
    """Sorts each bucket as soon as its rows have passed; its folder is scratch of the task, made anew if the task runs again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _rows(batches)
        row = next(rows, None)
        while row is not None:
            now = row["bucket"]
            with tempfile.TemporaryDirectory(prefix="bucket-") as folder:
                bucket = _Bucket(folder, fold_bytes)
                while row is not None and row["bucket"] == now:
                    bucket.add(row)
                    row = next(rows, None)
                yield from bucket.finish(length)

    return run


def _least_of(data: np.ndarray, at: np.ndarray, sizes: np.ndarray, ids: np.ndarray, length: int, folder: str) -> tuple[np.ndarray, np.ndarray]:
    """Where each piece (``sizes`` bytes of ``data`` from ``at``) begins in one string, and for each place of that the smallest of the ``ids`` of pieces with the same ``length`` bytes, by suffix sorting."""
    begins = 1 + np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    total = int(sizes.sum()) + len(sizes) + 1
    s = new_map(folder, "string", total, np.uint16)
    owner = new_map(folder, "owner", total, np.int32)
    for lo in range(0, len(sizes), 1 << 14):
        n, b = sizes[lo : lo + (1 << 14)], begins[lo : lo + (1 << 14)]
        to = _spread(b, n)
        s[to] = data[_spread(at[lo : lo + (1 << 14)], n)].astype(np.uint16) + np.uint16(1)
        owner[to] = np.repeat(np.arange(lo, lo + len(n), dtype=np.int32), n)
    sorted_in = os.path.join(folder, "sorted")
    os.mkdir(sorted_in)
    order, lcp = suffix_order(s, sorted_in)
    least = new_map(folder, "least", total, np.int32)
    _smallest(order, lcp, owner, ids, least, length)
    return begins, least


def _smallest(order: np.ndarray, lcp: np.ndarray, owner: np.ndarray, ids: np.ndarray, out: np.ndarray, length: int, block: int = 1 << 18) -> None:
    """``out`` at each suffix: the smallest id among those that share ``length`` bytes with it; a run may pass several blocks."""
    n, at = len(order), 0
    while at < n:
        to = min(at + block, n)
        while to < n and lcp[to] >= length:  # to the end of the run
            step = lcp[to : to + block] < length
            to += int(step.argmax()) if step.any() else len(step)
        p = np.asarray(order[at:to])
        starts = np.flatnonzero(np.asarray(lcp[at:to]) < length)
        if not len(starts) or starts[0]:
            starts = np.append(0, starts)
        low = np.minimum.reduceat(ids[owner[p]], starts)
        out[p] = np.repeat(low, np.diff(np.append(starts, len(p))))
        at = to


def remove_repeats(df: DataFrame, length: int = LENGTH, clean: bool = False, shard_bytes: int = SHARD_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """What goes from each document of ``df(doc_id, text, ...)``, or with ``clean`` the documents without it.

    Without ``clean``: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``. With it: ``df``'s
    columns, where ``text`` has lost its removed bytes (and what is left of a character of
    which one byte went; a null text stays null) and ``n_chars``, if there is one, is counted
    again; texts of which nothing is left stay as empty ones. Null texts count as empty; a
    null id counts as smaller than any other; rows with equal ids are not smaller than each
    other; of equal texts the one with the smallest id stays whole; texts of any length are
    sorted in pieces; other columns are left alone, whatever their names; an empty table gives no
    rows. ``doc_id`` is an integer. ``length`` is 20 to 255, else this raises ``ValueError``.
    """
    if not GRAM <= length <= CAP:
        raise ValueError(f"length is {length}: common prefixes are carried from {GRAM} to {CAP} bytes")
    base = df if clean else df.select("doc_id", "text")
    shards, _ = written(_pack(base, shard_bytes), "shards")
    # a row for each shard that has a text, however often; back goes its place in the shard's list
    docs = shards.selectExpr("shard_id", "posexplode(docs) as (k, d)").selectExpr("shard_id", "k", "d.*")
    first = docs.groupBy("digest").agg(F.min("low").alias("first"))
    later = docs.join(first, "digest").filter("high > first").groupBy("shard_id").agg(F.collect_list(F.struct("k", "first")).alias("later"))
    later, _ = written(later, "later")
    size = shards.agg(F.sum("size")).head()[0] or 0
    buckets = int(max(1, size // bucket_bytes))
    packed = shards.select("shard_id", "blob").join(later, "shard_id", "left")

    def send_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            shard = Shard(r["blob"], None, fold=True)
            begin, _, h = anchors(shard.data, shard.ends, length)
            doc = np.searchsorted(shard.ends, begin, side="right")
            h >>= _SHIFT
            order = np.lexsort((doc, h))
            h, doc = h[order], doc[order]
            new = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.empty(0, np.int64)
            last = np.append(new[1:], len(h)) - 1 if len(h) else new
            keys = (h[new] << np.uint64(1)) | (doc[new] != doc[last]).astype(np.uint64)
            b = (h[new] % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(b, kind="stable")
            b, keys = b[order], keys[order]
            edge = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1]))) if len(b) else np.empty(0, np.int64)
            blobs = [_six(keys[x:y]) for x, y in zip(edge, np.append(edge, len(b))[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(b[edge], pa.int32()), pa.array([r["shard_id"]] * len(edge), pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "shard_id", "keys"])

    counted = arrow_map(shards.select("shard_id", "blob"), send_anchors, "bucket int, shard_id long, keys binary").repartition("bucket").sortWithinPartitions("bucket")
    repeated, _ = written(arrow_map(counted, _count_anchors, "shard_id long, anchors binary"), "anchors")
    free_shuffles(df.sparkSession)
    repeated = repeated.groupBy("shard_id").agg(F.collect_list("anchors").alias("anchors"))
    packed = packed.join(repeated, "shard_id", "left")

    def known(r: dict) -> np.ndarray:
        return np.sort(np.concatenate([np.empty(0, np.uint64), *(np.frombuffer(x, np.uint64) for x in r["anchors"] or [])]))

    def send_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            pieces, anchor, lowest, *_ = Shard(r["blob"], r["later"]).pieces(known(r), length)
            where = _by_bucket_of(anchor, buckets)
            blobs = [_payload(ks, pieces, anchor, lowest) for ks in where.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(where), pa.int32()), pa.array([r["shard_id"]] * len(where), pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "shard_id", "pieces"])

    sent = arrow_map(packed, send_pieces, "bucket int, shard_id long, pieces binary").repartition("bucket").sortWithinPartitions("bucket")
    found, _ = written(arrow_map(sent, _sort_bucket(length), "shard_id long, bucket int, least binary"), "least")
    free_shuffles(df.sparkSession)
    found = found.groupBy("shard_id").agg(F.collect_list(F.struct("bucket", "least")).alias("found"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            shard = Shard(r["blob"], r["later"])
            gone = np.zeros(len(shard.data) + length, np.int32)
            if r["found"]:
                pieces, anchor, _, of, begin, n = shard.pieces(known(r), length)
                where = _by_bucket_of(anchor, buckets)
                w = np.array([len(p) - length + 1 for p in pieces], np.int64)
                at = np.concatenate(([0], np.cumsum(w)))
                least = np.zeros(at[-1], np.int64)
                for x in r["found"]:
                    ks = np.array(where[x["bucket"]])
                    to = np.repeat(at[ks] - np.concatenate(([0], np.cumsum(w[ks])[:-1])), w[ks]) + np.arange(int(w[ks].sum()))
                    least[to] = np.frombuffer(zstandard.decompress(x["least"]), np.int64)
                within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                start = np.repeat(begin, n) + within
                own = shard.ids[shard.first[np.searchsorted(shard.ends, start, side="right")]]
                start = start[least[np.repeat(at[of], n) + within] < own]
                np.add.at(gone, start, 1)
                np.add.at(gone, start + length, -1)
            gone = np.cumsum(gone[: len(shard.data)]) > 0
            at, kept, n_removed, n_spans = 0, [], [], []
            for i, t in enumerate(shard.texts):
                if shard.later[i]:
                    whole = len(t) >= length
                    kept.append(b"" if whole else t)
                    n_removed.append(len(t) if whole else 0)
                    n_spans.append(int(whole))
                    continue
                g = gone[at : at + len(t)]
                total = int(g.sum())
                n_removed.append(total)
                n_spans.append(int(g[:1].sum()) + int((g[1:] & ~g[:-1]).sum()) if total else 0)
                kept.append(shard.data[at : at + len(t)][~g].tobytes() if total else t)
                at += len(t)
            if clean:
                cols = {c: shard.batch.column(c) for c in shard.batch.schema.names}
                null = cols["text"].is_null().to_pylist()
                text = [None if z else k.decode("utf-8", "ignore") for k, z in zip(kept, null, strict=True)]
                if "n_chars" in cols:
                    cols["n_chars"] = pa.array([len(t) if m else c for t, m, c in zip(text, n_removed, cols["n_chars"].to_pylist(), strict=True)], cols["n_chars"].type)
                cols["text"] = pa.array(text, pa.string())
                yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))
            else:
                yield pa.RecordBatch.from_arrays(
                    [shard.batch.column("doc_id"), pa.array([len(t) for t in shard.texts], pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept])],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
                )

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema)
    schema = own if clean else f"doc_id {dict(base.dtypes)['doc_id']}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return arrow_map(packed.join(found, "shard_id", "left"), cut, schema)
