"""Toxicity: restore obfuscated words by a noisy channel, then score the restored text.

The character model counts sequences of four characters over all documents. The classifier's features
are words and word beginnings of restored texts, chosen on a bounded sample of
labelled rows by how far the share of toxic texts among those that have them is from that
among all, on either side, and weighted by a logistic regression on the same sample. Scoring is one
pass over the documents without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillmark.llm import deobfuscation as noisy
from tillmark.llm.common import arrow_map
from tillmark.llm.decontamination import words_of

#: Labelled rows that the classifier is fitted on, features it keeps, score from which a text is rejected.
SAMPLE_ROWS, FEATURES, REJECT = 20_000, 4096, 0.3
#: Gain in log-likelihood from which on a word or beginning is a feature.
LEAST_GAIN = 3.0
#: Bytes of the word beginnings that are features.
PREFIXES = (4, 5, 6, 7, 8)
_CHUNK_BYTES = 2 << 20


def _lowered(batch: pa.RecordBatch) -> pa.Array:
    return pc.utf8_lower(pc.fill_null(batch.column("text").cast(pa.string()), ""))


def char_counts(df: DataFrame) -> np.ndarray:
    """How often each sequence of the character model's order stands in the texts of ``df(text)``, all of them; at most ``SYMBOLS ** ORDER`` numbers reach the driver."""
    n, order = noisy.SYMBOLS**noisy.ORDER, noisy.ORDER

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n, np.int64)
        for batch in batches:
            texts = _lowered(batch).to_pylist()
            at = 0
            while at < len(texts):  # a few MB of texts at once, set apart by boundaries
                to, size = at, 0
                while to < len(texts) and (size == 0 or size < _CHUNK_BYTES // 4):
                    size += len(texts[to])
                    to += 1
                gap = "\n" * (order - 1)
                s = noisy.symbols_of(gap + gap.join(texts[at:to]) + "\n")
                code = np.zeros(len(s) - order + 1, np.int64)
                for k in range(order):
                    code = code * noisy.SYMBOLS + s[k : len(s) - order + 1 + k]
                total += np.bincount(code, minlength=n)
                at = to
        for k in range(0, n, _ROW):  # rows of counts of neighbouring codes
            if total[k : k + _ROW].any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([total[k : k + _ROW]], pa.list_(pa.int64()))], names=["code", "n"])

    out = np.zeros(n, np.int64)
    parts = arrow_map(df.select("text"), count, "code long, n array<long>").selectExpr("code", "posexplode(n) as (k, n)").filter("n > 0")
    sums = parts.groupBy((F.col("code") + F.col("k")).alias("code")).agg(F.sum("n").alias("n"))
    for r in sums.groupBy(F.floor(F.col("code") / _ROW)).agg(F.collect_list("code").alias("code"), F.collect_list("n").alias("n")).toLocalIterator():
        out[r["code"]] = r["n"]
    return out


_ROW = 4096


def _restored(texts: pa.Array, model: noisy.CharModel) -> list[bytes]:
    said = texts.to_pylist()
    for i in noisy.suspects(said):
        said[i] = noisy.restore(said[i], model)
    return [x.encode() for x in said]


_TAGS = [np.uint64(0x9E3779B97F4A7C15 * (k + 1) & 0xFFFFFFFFFFFFFFFF) for k in range(len(PREFIXES) + 1)]


def features_of(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Text index and hash of each word, and of each beginning of a word, family by family, repeats included."""
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (size == 0 or size < _CHUNK_BYTES):
            size += len(texts[to]) + 1
            to += 1
        part = texts[at:to]
        data = np.frombuffer(b" ".join(part) + b" ", np.uint8)
        begin, end, h = words_of(data)
        starts = np.cumsum([0] + [len(t) + 1 for t in part])
        doc = np.searchsorted(starts, begin, side="right") - 1 + at
        yield doc, h ^ _TAGS[0]
        # beginnings: the bytes themselves, as numbers, as far as the word goes
        padded = np.concatenate((data, np.zeros(8, np.uint8)))
        first = np.zeros(len(begin), np.uint64)
        for j in range(8):
            first |= padded[begin + j].astype(np.uint64) << np.uint64(8 * j)
        length = end - begin
        for k, n in enumerate(PREFIXES):
            long_ = length > n
            value = first[long_] & np.uint64((1 << 8 * n) - 1)
            yield doc[long_], (value + _TAGS[k + 1]) * np.uint64(0xD6E8FEB86659FD93) ^ _TAGS[k + 1]
        at = to


@dataclass
class ToxicityModel:
    """Hashes of the features (sorted), their weights, and the bias."""

    hashes: np.ndarray
    weights: np.ndarray
    bias: float

    def __post_init__(self) -> None:
        self.seen = np.zeros(1 << 18, bool)
        self.seen[(self.hashes >> np.uint64(46)).astype(np.int64)] = True

    def hits(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs of text and feature."""
        found = [np.empty(0, np.int64)]
        if len(self.hashes):
            for doc, h in features_of(texts):
                maybe = np.flatnonzero(self.seen[(h >> np.uint64(46)).astype(np.int64)])
                h = h[maybe]
                k = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
                ok = self.hashes[k] == h
                found.append(np.unique(doc[maybe][ok] * len(self.hashes) + k[ok]))
        pairs = np.unique(np.concatenate(found))
        n = max(1, len(self.hashes))
        return pairs // n, pairs % n

    def scores(self, texts: list[bytes]) -> np.ndarray:
        doc, k = self.hits(texts)
        z = self.bias + np.bincount(doc, self.weights[k], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(rows: np.ndarray, cols: np.ndarray, y: np.ndarray, n_features: int, l2: float = 0.1, rounds: int = 600) -> tuple[np.ndarray, float]:
    """Logistic regression on binary features by accelerated gradient steps; ``rows``, ``cols`` are the ones."""
    w, b = np.zeros(n_features), float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    if not len(rows):
        return w, b
    per_row = np.bincount(rows, minlength=len(y))
    step_w = 1 / (0.25 * (per_row.max() + 1) * np.maximum(1, np.bincount(cols, minlength=n_features)) + l2)
    step_b = 1 / (0.25 * len(y) * 2)
    vw, vb, tw, tb, t = w, b, w, b, 1.0
    for _ in range(rounds):
        z = tb + np.bincount(rows, tw[cols], minlength=len(y))
        g = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - y
        nw, nb = tw - step_w * (np.bincount(cols, g[rows], minlength=n_features) + l2 * tw), tb - step_b * g.sum()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        tw, tb = nw + (t - 1) / t2 * (nw - vw), nb + (t - 1) / t2 * (nb - vb)
        vw, vb, t = nw, nb, t2
    return vw, float(vb)


def train(df: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, n_features: int = FEATURES) -> tuple[noisy.CharModel, ToxicityModel | None]:
    """The character model of all ``df(doc_id, text)`` and a classifier from ``labels(doc_id, toxic)``; None without labels.

    The sample is the ``sample_rows`` labelled rows with the smallest hashes of their ids.
    """
    chars = noisy.CharModel(char_counts(df))
    sc = df.sparkSession.sparkContext
    shared = sc.broadcast(chars)
    chosen = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # the smallest hashes: a bound that leaves few more than enough comes first, so that no task sorts them all
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32))
    bound = int(min(1.0, (1.2 * sample_rows + 200) / max(1, chosen.count())) * (1 << 32))
    chosen = chosen.filter(place < bound).orderBy(place, "doc_id").limit(sample_rows)
    sample = df.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")  # sample_rows rows of two numbers

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = np.array(batch.column("toxic").to_pylist(), np.int64)
            texts = _restored(_lowered(batch), shared.value)
            keys = [np.empty(0, np.uint64)]
            toxic = [np.empty(0, np.int64)]
            for doc, h in features_of(texts):
                order = np.lexsort((doc, h))
                doc, h = doc[order], h[order]
                new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1]))) if len(doc) else np.empty(0, bool)
                keys.append(h[new])
                toxic.append(y[doc[new]])
            h, of = np.unique(np.concatenate(keys), return_inverse=True)
            t = np.bincount(of, np.concatenate(toxic), minlength=len(h)).astype(np.int64)
            n = np.bincount(of, minlength=len(h)).astype(np.int64)
            some = t > 0
            yield pa.RecordBatch.from_arrays([pa.array(h[some].view(np.int64)), pa.array(t[some]), pa.array(n[some])], names=["h", "t", "n"])
            yield pa.RecordBatch.from_arrays([pa.array(h[~some].view(np.int64)), pa.array(t[~some]), pa.array(n[~some])], names=["h", "t", "n"])

    base = sample.agg(F.count("*"), F.sum("toxic")).head()
    if not base[0]:
        return chars, None
    rate = (base[1] or 0) / base[0]
    counts = arrow_map(sample, tally, "h long, t long, n long").groupBy("h").agg(F.sum("t").alias("t"), F.sum("n").alias("n"))
    # log-likelihood ratio of a share of toxic texts that is not the mean, whichever side it lies on
    part = lambda k, of: F.when(k > 0, k * F.log(k / F.col("n") / F.lit(max(of, 1e-9)))).otherwise(0.0)
    gain = part(F.col("t"), rate) + part(F.col("n") - F.col("t"), 1 - rate)
    best = counts.filter("n > 1").withColumn("gain", gain).filter(F.col("gain") > LEAST_GAIN).orderBy(F.desc("gain"), "h").limit(n_features)
    hashes = np.sort(np.array([r["h"] for r in best.select("h").collect()], np.int64).view(np.uint64))
    model = sc.broadcast(ToxicityModel(hashes, np.zeros(len(hashes)), 0.0))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, k = model.value.hits(_restored(_lowered(batch), shared.value))
            runs = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(runs, pa.int32()), pa.array(k, pa.int32())), batch.column("toxic").cast(pa.int32())], names=["k", "toxic"])

    got = arrow_map(sample, project, "k array<int>, toxic int").toArrow().combine_chunks()
    ks = got["k"].to_pylist()
    rows = np.repeat(np.arange(len(ks)), [len(x) for x in ks]).astype(np.int64)
    cols = np.array([c for x in ks for c in x], np.int64)
    weights, bias = fit(rows, cols, np.array(got["toxic"].to_pylist(), float), max(1, len(hashes)))
    return chars, ToxicityModel(hashes, weights[: len(hashes)], bias)


def reject(df: DataFrame, labels: DataFrame, threshold: float = REJECT) -> DataFrame:
    """``df`` without the rows that score ``threshold`` or more by a model trained on it and ``labels``; its columns stay.

    A text with nothing that tells for or against stays, even where most labelled rows are toxic: so do null and
    empty ones. Whole texts are read; repeated rows stay or go together, null ids are kept, columns may have any names, an empty table gives no rows.
    """
    chars, model = train(df.select("doc_id", "text"), labels)
    if model:
        threshold = max(threshold, float(model.scores([b""])[0]) + 1e-9)
    name = "score"
    while name in (c.lower() for c in df.columns):
        name += "_"
    return score(df, chars, model, True, name).filter(F.col(name) < threshold).drop(name)


def score(df: DataFrame, chars: noisy.CharModel, model: ToxicityModel | None, keep: bool = False, name: str = "score") -> DataFrame:
    """``doc_id, score`` for each row of ``df``, or with ``keep`` all its columns and the score last, as ``name``.

    A null text counts as empty and gets the score of a text without features; without
    labels every score is 0. Whole texts are read, however long. Null ids are kept, repeated rows each scored alike (equal
    texts have equal scores), an empty table gives no rows; with ``keep`` a column of ``df`` that is called ``name`` must not exist.
    """
    sc = df.sparkSession.sparkContext
    shared = sc.broadcast((chars, model))
    columns = df.columns if keep else ["doc_id"]
    base = df if keep else df.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_chars, own = shared.value
        for batch in batches:
            got = own.scores(_restored(_lowered(batch), own_chars)) if own else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(got, pa.float64())], names=[*columns, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema if f.name in columns)
    return arrow_map(base, run, f"{schema}, `{name}` double")


def held_out(doc_id: str = "doc_id"):
    """Rows kept from training: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % 4 == 2, F.lit(False))
