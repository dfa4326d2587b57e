"""The nearest vectors of a catalog, exactly, without comparing all pairs where the vectors lie in clusters.

Vectors are dealt to the cells of at most ``pivots`` sampled vectors, and a cell to rings by the angle to its pivot, of
about ``block_rows`` vectors each; what is larger is cut into parts. A part is one row from then on, its different
vectors a matrix: a block of the catalog, or a chunk of the queries. Angles obey the triangle inequality: a query at
angle ``t`` from a pivot is at least ``t - hi`` and ``lo - t`` from anything in a ring that spans ``lo`` to ``hi``. A
first pass compares each chunk with one block of its own cell, which gives for each query a similarity that its
``top_k``-th best has at least; then a chunk meets only the blocks that may hold something as near as that for one of
its queries, and nothing below the floor.

Groups of chunks meet lots of blocks: a task takes one of each, so that a block is sent once for each group that has
a chunk for it, and a chunk once for each lot. Up to ``LOTS`` times ``GROUPS`` tasks, groups and lots grow with the
tables and what is sent is in proportion to these; beyond that, at ``GROUP`` chunks and ``LOT`` blocks a task, there
are more of them. What a task holds is a group and a lot; the driver holds the pivots and a row for each ring and chunk.

Without clusters (random vectors of many dimensions are nearly at right angles to each other and to any pivot) the
bounds exclude little, and the work is that of all pairs of chunks and blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillmark.sources.shared import dropped, written

PIVOTS, BINS = 256, 64
#: Sampled vectors for each pivot, of which those farthest from each other are taken.
SAMPLED = 8
#: What rounding may add to a similarity, and how far from length one a vector may be for bounds to be used.
SLACK, OFF = 1e-6, 1e-3
#: Bytes of a block or chunk, and pairs whose similarities are summed at once.
BLOCK_BYTES, PAIRS = 4 << 20, 1 << 15
#: Blocks and chunks that one task holds at most, and how many lots and groups there are at least, if there are so many blocks and chunks.
LOT, GROUP = 32, 16
LOTS, GROUPS = 4, 12


@dataclass
class Nearest:
    """``found(query_id, product_id, similarity)``, ``top_k`` a query and lot of blocks at most; ``pairs(chunk, block, ...)`` that meet; how many ``blocks`` and ``chunks`` there are; ``tables`` that the two are read from."""

    found: DataFrame
    pairs: DataFrame
    blocks: int
    chunks: int
    tables: list[str] = field(default_factory=list)


def _spread(vectors: np.ndarray, n: int) -> np.ndarray:
    """``n`` of the vectors, each the farthest from those before it."""
    chosen = [0]
    best = vectors @ vectors[0]
    while len(chosen) < min(n, len(vectors)):
        chosen.append(int(np.argmin(best)))
        best = np.maximum(best, vectors @ vectors[chosen[-1]])
    return vectors[chosen]


def _angles(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.arccos(np.clip(vectors @ pivots.T / np.where(norms > 0, norms, 1), -1, 1))


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _place(rows: DataFrame, pivots, kind: str) -> DataFrame:  # noqa: ANN001
    """``id, vector, at, cell, bin, angle, off`` (how far the length is from one)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                v = _stack(part["vector"])
                angles = _angles(v, pivots.value)
                cell = np.argmin(angles, axis=1)
                angle = angles[np.arange(len(v)), cell]
                yield part.assign(cell=cell.astype(np.int32), bin=np.minimum((angle / np.pi * BINS).astype(np.int32), BINS - 1), angle=angle, off=np.abs(np.linalg.norm(v, axis=1) - 1))

    return rows.mapInPandas(run, f"id {kind}, vector array<float>, at long, cell int, bin int, angle double, off double")


@dataclass
class _Ring:
    """Bins of a cell, the angles they span, and the numbers of their parts."""

    cell: int
    bins: list[int]
    lo: float
    hi: float
    n: int
    parts: int = 0
    first: int = 0


def _cut(placed: DataFrame, part_rows: int) -> tuple[list[_Ring], int]:
    """Neighbouring bins of each cell joined to rings of about ``part_rows`` rows, and the number of parts of all."""
    rings: list[_Ring] = []
    for c, b, lo, hi, n in sorted(tuple(x) for x in placed.groupBy("cell", "bin").agg(F.min("angle"), F.max("angle"), F.count("*")).collect()):
        last = rings[-1] if rings else None
        if last and last.cell == c and last.n + n <= part_rows:
            last.bins.append(b)
            last.hi, last.n = hi, last.n + n
        else:
            rings.append(_Ring(c, [b], lo, hi, n))
    number = 0
    for r in rings:
        r.parts, r.first = -(-r.n // part_rows), number
        number += r.parts
    return rings, number


def _packed(placed: DataFrame, rings: list[_Ring], kind: str, name: str) -> DataFrame:
    """One row for each part: ``name``, its ids in order, and as bytes its different vectors, which of them each id has, and ``at``."""
    table = placed.sparkSession.createDataFrame([(r.cell, b, r.parts, r.first) for r in rings for b in r.bins], "cell int, bin int, parts int, first int")
    dealt = placed.join(F.broadcast(table), ["cell", "bin"]).withColumn(name, F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))

    def pack(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id", kind="stable")
        vectors = np.ascontiguousarray(np.stack(part["vector"].to_numpy()), np.float32)
        _, first, which = np.unique(vectors.view(np.dtype((np.void, vectors[0].nbytes))).ravel(), return_index=True, return_inverse=True)
        return pd.DataFrame({name: [key[0]], f"{name}_ids": [part["id"].tolist()], f"{name}_vectors": [vectors[first].tobytes()], f"{name}_of": [which.astype(np.int32).tobytes()], f"{name}_at": [part["at"].to_numpy(np.int64).tobytes()]})

    return dealt.select("id", "vector", "at", name).groupBy(name).applyInPandas(pack, f"{name} int, {name}_ids array<{kind}>, {name}_vectors binary, {name}_of binary, {name}_at binary")


@dataclass
class _Part:
    """Different vectors, and for each id which it has and its ``at``."""

    vectors: np.ndarray
    of: np.ndarray
    at: np.ndarray

    @staticmethod
    def read(vectors: bytes, of: bytes, at: bytes) -> _Part:
        which = np.frombuffer(of, np.int32)
        return _Part(np.frombuffer(vectors, np.float32).reshape(which.max() + 1, -1).astype(np.float64), which, np.frombuffer(at, np.int64))

    def lowest(self, least: np.ndarray, floor: float) -> np.ndarray:
        """For each vector the least that any of its ids must reach."""
        low = np.full(len(self.vectors), np.inf)
        np.minimum.at(low, self.of, np.maximum(np.nan_to_num(least, nan=floor), floor))
        return low


def best_of(a: _Part, some: np.ndarray, least: np.ndarray, b: _Part, top_k: int, floor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of ``a`` (if their vector is among ``some``) and ``b`` and their similarities: for each of ``a`` the ``top_k`` best of ``b`` that come before it, as near as ``least`` (if that is a number) and the floor; equal ones in order."""
    out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    bound = np.maximum(np.nan_to_num(least, nan=floor), floor)
    low = a.lowest(least, floor)
    by_vector = np.argsort(a.of, kind="stable")
    for u in range(0, len(some), 256):
        these = some[u : u + 256]
        products = a.vectors[these] @ b.vectors.T
        near_enough = products >= low[these, None] - SLACK
        row_of = np.full(len(a.vectors), -1)
        row_of[these[near_enough.any(axis=1)]] = np.flatnonzero(near_enough.any(axis=1))
        asks = by_vector[row_of[a.of[by_vector]] >= 0]
        for q in range(0, len(asks), 256):
            mine = asks[q : q + 256]
            row = row_of[a.of[mine]]
            those = np.flatnonzero(near_enough[np.unique(row)].any(axis=0)[b.of])
            k = min(top_k, len(those))
            rough = np.where(b.at[those] < a.at[mine, None], products[row[:, None], b.of[those]], -np.inf)
            near, fresh = bound[mine], np.isnan(least[mine])
            if fresh.any():
                near[fresh] = np.maximum(np.partition(rough[fresh], -k, axis=1)[:, -k], floor)
            i, j = np.nonzero(rough >= near[:, None] - SLACK)
            # A product of matrices may sum in any order; what may be among the best is summed in one order only.
            pair = np.zeros(products.shape, bool)
            pair[row[i], b.of[those[j]]] = True
            x, y = np.nonzero(pair)
            sums = np.empty(products.shape)
            for p in range(0, len(x), PAIRS):
                sums[x[p : p + PAIRS], y[p : p + PAIRS]] = (a.vectors[these[x[p : p + PAIRS]]] * b.vectors[y[p : p + PAIRS]]).sum(axis=1)
            exact = sums[row[i], b.of[those[j]]]
            keep = exact >= bound[mine[i]]
            i, j, exact = i[keep], j[keep], exact[keep]
            order = np.lexsort((j, -exact, i))
            i, j, exact = i[order], j[order], exact[order]
            keep = np.arange(len(i)) - np.searchsorted(i, i) < k
            out.append((mine[i[keep]], those[j[keep]], exact[keep]))
    i, j, exact = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.argsort(i, kind="stable")
    return i[order], j[order], exact[order]


def forest(chunks: list[_Part], blocks: list[_Part], floor: float, meet: Callable[[int, int], np.ndarray]) -> np.ndarray:
    """For each vector of the chunks, then of the blocks, the first of those that it is joined with by pairs of a chunk and a block not below the floor."""
    first = np.cumsum([0, *(len(p.vectors) for p in [*chunks, *blocks])])
    root = np.arange(first[-1])
    for n, a in enumerate(chunks):
        for m, b in enumerate(blocks, len(chunks)):
            some = meet(n, m - len(chunks))
            for u in range(0, len(some), 256):
                near = a.vectors[some[u : u + 256]] @ b.vectors.T >= floor - SLACK
                x, y = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
                near, rows, columns = near[np.ix_(x, y)], first[n] + some[u + x], first[m] + y
                # Each column is joined with one row at a time, until no pair has two roots.
                while (apart := near & (root[rows][:, None] != root[columns])).any():
                    for c in np.flatnonzero(apart.any(axis=0)):
                        r, o = rows[apart[:, c].argmax()], columns[c]
                        while root[r] != r:
                            r = root[r]
                        while root[o] != o:
                            o = root[o]
                        root[max(r, o)] = min(r, o)
                    while (root != root[root]).any():
                        root = root[root]
    return root


def linked(vectors: DataFrame, floor: float, block_rows: int = 4096) -> Nearest:
    """Pairs ``query_id, product_id`` of ``vectors(id, embedding)``, all different, that join whatever is joined by pairs not below ``floor``, one by another; a task gives no more pairs than it has vectors."""
    named = lambda c: vectors.select(F.col("id").alias(c), "embedding")
    return nearest(named("query_id"), named("product_id"), floor=floor, block_rows=block_rows, links=True)


def nearest(queries: DataFrame, catalog: DataFrame, top_k: int = 5, floor: float = 0.6, block_rows: int = 4096, pivots: int = PIVOTS, ordered: bool = False, links: bool = False) -> Nearest:
    """For each of ``queries(query_id, embedding)`` what may be among its ``top_k`` best of ``catalog(product_id, embedding)``, its ``top_k`` best at least.

    With ``ordered`` both have a column ``at`` (long), and a query finds only what has a smaller one. With ``links`` see ``linked``.
    Vectors should have length one; if one is off by more than 0.001, all chunks meet all blocks. Null vectors
    find nothing and are not found; ids are unique on each side. What a task holds grows with ``block_rows`` only (``LOT`` blocks
    and ``GROUP`` chunks, each cut to ``BLOCK_BYTES``), what the driver holds with ``pivots`` and the number of blocks.
    """
    spark = queries.sparkSession
    qt, ct = dict(queries.dtypes)["query_id"], dict(catalog.dtypes)["product_id"]
    at = lambda other: (F.col("at") if ordered else F.lit(other)).cast("long").alias("at")
    q = queries.filter(F.col("embedding").isNotNull()).select(F.col("query_id").alias("id"), F.col("embedding").cast("array<float>").alias("vector"), at(1))
    c = catalog.filter(F.col("embedding").isNotNull()).select(F.col("product_id").alias("id"), F.col("embedding").cast("array<float>").alias("vector"), at(0))
    n = c.count()
    schema = f"query_id {qt}, product_id {ct}, similarity double"
    if not n:
        return Nearest(spark.createDataFrame([], schema), spark.createDataFrame([], "chunk int, block int"), 0, 0)
    sample = [r[0] for r in c.orderBy(F.xxhash64("id"), "id").limit(min(pivots, -(-n // block_rows)) * SAMPLED).select("vector").collect()]
    drawn = np.array(sample, np.float64)
    block_rows = max(1, min(block_rows, BLOCK_BYTES // (4 * max(1, drawn.shape[1]))))
    norms = np.linalg.norm(drawn, axis=1, keepdims=True)
    sent = spark.sparkContext.broadcast(_spread(drawn / np.where(norms > 0, norms, 1), min(pivots, -(-n // block_rows))))

    made: list[str] = []
    tables: list[str] = []
    placed_c, placed_q = written(_place(c, sent, ct), "vectors", made), written(_place(q, sent, qt), "vectors", made)
    (rings, blocks), (asked, chunks) = _cut(placed_c, block_rows), _cut(placed_q, block_rows)
    if not chunks:
        dropped(spark, made)
        return Nearest(spark.createDataFrame([], schema), spark.createDataFrame([], "chunk int, block int"), blocks, 0)
    off = placed_c.select("off").unionByName(placed_q.select("off")).agg(F.max("off")).head()[0] or 0.0
    prune = blocks > 1 and off <= OFF
    block_table = written(_packed(placed_c, rings, ct, "block"), "blocks", tables)
    chunk_rows = _packed(placed_q, asked, qt, "chunk")

    of_cell: dict[int, list[_Ring]] = {}
    for r in rings:
        of_cell.setdefault(r.cell, []).append(r)

    def home(r: _Ring) -> int | None:
        """The first block of the ring of the same cell whose angles are nearest."""
        mid = (r.lo + r.hi) / 2
        return min(((max(0.0, x.lo - mid, mid - x.hi), x.first) for x in of_cell.get(r.cell, [])), default=(0, None))[1]

    homes = [(r.first + p, home(r)) for r in asked for p in range(r.parts)] if prune and not links else []
    own = spark.createDataFrame(homes, "chunk int, block int")

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Chunks with what the ``top_k``-th best of each query has at least: the worst of so many that a block of their cell has."""
        for part in batches:
            for n, r in enumerate(part.itertuples()):
                m = len(r.chunk_ids)
                known = np.full(m, np.nan)
                if not links and r.block_vectors is not None and len(r.block_ids) >= top_k:
                    a = _Part.read(r.chunk_vectors, r.chunk_of, r.chunk_at)
                    i, _, exact = best_of(a, np.arange(len(a.vectors)), known, _Part.read(r.block_vectors, r.block_of, r.block_at), top_k, floor)
                    full = np.flatnonzero(np.bincount(i, minlength=m) >= top_k)
                    known[full] = exact[np.searchsorted(i, full, side="right") - 1]
                yield part.iloc[n : n + 1][["chunk", "chunk_ids", "chunk_vectors", "chunk_of", "chunk_at"]].assign(least=[known.tobytes()])

    met = chunk_rows.join(own, "chunk", "left").join(block_table, "block", "left")
    chunk_rows = written(met.mapInPandas(fill, f"chunk int, chunk_ids array<{qt}>, chunk_vectors binary, chunk_of binary, chunk_at binary, least binary"), "chunks", tables)
    dropped(spark, made)
    cell, lo, hi, parts, first = (np.array(x) for x in zip(*[(r.cell, r.lo, r.hi, r.parts, r.first) for r in rings], strict=True))
    ring_of = np.repeat(np.arange(len(rings)), parts)

    def to_pivots(a: _Part) -> np.ndarray | None:
        return _angles(a.vectors, sent.value) if prune else None

    def may_hold(t: np.ndarray | None, low: np.ndarray, these: np.ndarray) -> np.ndarray:
        """Which of these rings may hold what each vector looks for, by its angles to the pivots."""
        if t is None:
            return np.ones((len(low), len(these)), bool)
        bound = np.cos(np.maximum(0, np.maximum(t[:, cell[these]] - hi[these], lo[these] - t[:, cell[these]])))
        return bound >= low[:, None] - SLACK

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for r in part.itertuples():
                a = _Part.read(r.chunk_vectors, r.chunk_of, r.chunk_at)
                t, low = to_pivots(a), a.lowest(np.frombuffer(r.least), floor)
                keep = np.concatenate([may_hold(t, low, np.arange(x, min(x + 256, len(rings)))).any(axis=0) for x in range(0, len(rings), 256)])
                found = np.flatnonzero(keep[ring_of]).astype(np.int32)
                yield pd.DataFrame({"chunk": np.full(len(found), r.chunk, np.int32), "block": found})

    def compare(some_chunks: pd.DataFrame, some_blocks: pd.DataFrame) -> pd.DataFrame:
        """What earlier blocks of the lot gave raises what later ones must reach."""
        columns = ["query_id", "product_id", "similarity"]
        out = [pd.DataFrame(columns=columns)]
        some_blocks = some_blocks.sort_values("block")
        for r in some_chunks.itertuples():
            a, least, asks, best = _Part.read(r.chunk_vectors, r.chunk_of, r.chunk_at), np.frombuffer(r.least).copy(), np.asarray(r.chunk_ids), None
            t = to_pivots(a)
            for b in some_blocks.itertuples():
                some = np.flatnonzero(may_hold(t, a.lowest(least, floor), ring_of[b.block : b.block + 1])[:, 0])
                i, j, exact = best_of(a, some, least, _Part.read(b.block_vectors, b.block_of, b.block_at), top_k, floor)
                if len(i):
                    new = pd.DataFrame({"i": i, "query_id": asks[i], "product_id": np.asarray(b.block_ids)[j], "similarity": exact})
                    best = new if best is None else pd.concat([best, new])
                    best = best.sort_values(["i", "similarity", "product_id"], ascending=[True, False, True], kind="stable").groupby("i").head(top_k)
                    full = best.groupby("i")["similarity"].agg(["size", "min"])
                    full = full[full["size"] >= top_k]
                    least[full.index] = np.fmax(least[full.index], full["min"])
            if best is not None:
                out.append(best[columns])
        return pd.concat(out[1:] or out)

    def join_up(some_chunks: pd.DataFrame, some_blocks: pd.DataFrame) -> pd.DataFrame:
        """Each vector with the first of those that it is joined with."""
        asking = [_Part.read(r.chunk_vectors, r.chunk_of, r.chunk_at) for r in some_chunks.itertuples()]
        asked_of = [_Part.read(r.block_vectors, r.block_of, r.block_at) for r in some_blocks.itertuples()]
        at = [to_pivots(a) for a in asking]
        meet = lambda n, m: np.flatnonzero(may_hold(at[n], np.full(len(asking[n].vectors), floor), ring_of[some_blocks["block"].iloc[m] :][:1])[:, 0])
        root = forest(asking, asked_of, floor, meet)
        one = np.concatenate([np.asarray(i)[np.unique(p.of, return_index=True)[1]] for i, p in zip([*some_chunks["chunk_ids"], *some_blocks["block_ids"]], [*asking, *asked_of], strict=True)])
        joined = np.flatnonzero(one != one[root])
        return pd.DataFrame({"query_id": one[joined], "product_id": one[root[joined]], "similarity": np.nan})

    lots, groups = max(-(-blocks // LOT), min(blocks, LOTS)), max(-(-chunks // GROUP), min(chunks, GROUPS))
    pairs = chunk_rows.select("chunk", "chunk_vectors", "chunk_of", "chunk_at", "least").mapInPandas(visit, "chunk int, block int")
    of = lambda c, n, all_: F.expr(f"cast({c} * {n}L div {all_} as int)")
    pairs = written(pairs.withColumns({"lot": of("block", lots, blocks), "group": of("chunk", groups, chunks)}), "pairs", tables)
    asking, asked_of = (rows.join(F.broadcast(pairs.select(c, F.col("group").alias(f"{c}_g"), F.col("lot").alias(f"{c}_l")).distinct()), c).groupBy(f"{c}_g", f"{c}_l") for rows, c in ((chunk_rows, "chunk"), (block_table, "block")))
    found = asking.cogroup(asked_of).applyInPandas(join_up if links else compare, schema)
    return Nearest(found, pairs, blocks, chunks, tables)
