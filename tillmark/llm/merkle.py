"""Merkle manifest of a table: a tree of digests over each group's rows, and one over the groups' roots.

Rows stand in order within their group, every ``FANOUT`` consecutive nodes of a level become one of the next, the last
run may be shorter and is hashed as it is, without padding. No task needs a whole group:

* rows are dealt by ranges of (group, order) and numbered; a number for each partition is all that the driver adds;
* a task climbs with a mountain-range stack over whatever run of numbered leaves it reads: it works like a counter in
  base ``FANOUT``, whose carries emit completed nodes; what stays open at the run's unaligned edges is passed on;
* open nodes meet in rounds over blocks of ``FANOUT ** STEP`` leaves, then of blocks of blocks, where the short runs at
  a group's end are closed too; a round has a few nodes for each run, not the leaves;
* proofs come down by the same blocks, each bounded, so that a group of any size is spread over all tasks.

Digests are SHA-256 and are hashed as their hex text; they are kept as 32 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillmark.llm.common import arrow_map, drop_path, map_arrow, written

FANOUT, STEP = 3, 8
#: Leaves of a partition that are numbered together: at most about, and at least about, however many partitions the session asks for.
LEAVES, FEW = 2_000_000, 10_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(parts: list[bytes]) -> bytes:
    """The parent of digests."""
    return sha256("".join(p.hex() for p in parts).encode()).digest()


def leaf(values: list[Column]) -> Column:
    """Digest of values (strings and integers), each as its count of UTF-8 bytes, a colon and itself, a null as a minus sign."""
    told = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in values]
    return F.unhex(F.sha2(F.concat(*told).cast("binary"), 256))


@dataclass
class Mountains:
    """Peaks of a run of nodes, pushed from left to right: what is complete is carried, ``nodes`` are the nodes made, ``open`` those that lack siblings."""

    fanout: int = FANOUT
    levels: list[list[tuple[int, bytes]]] = field(default_factory=list)
    nodes: list[tuple[int, int, bytes]] = field(default_factory=list)
    open: list[tuple[int, int, bytes]] = field(default_factory=list)

    def push(self, level: int, index: int, h: bytes) -> None:
        while True:
            while len(self.levels) <= level:
                self.levels.append([])
            peak = self.levels[level]
            peak.append((index, h))
            if index % self.fanout != self.fanout - 1:
                return
            self.levels[level] = []
            if len(peak) < self.fanout:  # the run began within these siblings
                self.open += [(level, i, x) for i, x in peak]
                return
            level, index, h = level + 1, index // self.fanout, digest([x for _, x in peak])
            self.nodes.append((level, index, h))

    def finish(self, n: int, top: int) -> bytes | None:
        """Closes short runs, as the group ends at ``n`` leaves and all nodes below ``top`` that it has here were pushed; the root if it is met."""
        for level in range(top):
            peak = self.levels[level] if level < len(self.levels) else []
            if n <= self.fanout**level:
                return self.levels.pop(level)[0][1]
            if peak:
                self.levels[level] = []
                index, h = peak[0][0] // self.fanout, digest([x for _, x in peak])
                self.nodes.append((level + 1, index, h))
                self.push(level + 1, index, h)
        if n <= self.fanout**top:
            return self.levels.pop(top)[0][1]
        return None

    def close(self) -> None:
        """Ends the run: its right edge stays open."""
        self.open += [(level, i, x) for level, peak in enumerate(self.levels) for i, x in peak]
        self.levels = []


def _changes(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.empty(0, np.int64)


def _objects(column: pa.Array) -> np.ndarray:
    out = np.empty(len(column), object)
    out[:] = column.to_pylist()
    return out


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows with their partition, their place in their group's run there, and whether that run is the partition's first."""
    from pyspark import TaskContext

    part, group, seen, first = TaskContext.get().partitionId(), None, 0, True
    started = False
    for batch in batches:
        if not batch.num_rows:
            continue
        groups = _objects(batch.column("grp"))
        begins = _changes(groups)
        ends = np.append(begins[1:], len(groups))
        place, lead = np.zeros(len(groups), np.int64), np.zeros(len(groups), bool)
        for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
            if started and groups[a] != group:
                seen, first = 0, False
            group, started = groups[a], True
            place[a:b] = np.arange(seen, seen + b - a)
            lead[a:b] = first
            seen += b - a
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(place), pa.array(lead)], names=[*batch.schema.names, "part", "place", "lead"])


_OUT = "kind string, grp string, level int, idx long, h binary, n long"
_NAMES = ["kind", "grp", "level", "idx", "h", "n"]


def _rows(group: str | None, m: Mountains) -> list[tuple]:
    return [("node", group, *x, None) for x in m.nodes] + [("open", group, *x, None) for x in m.open]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.int64())
    columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=_NAMES)


def _climb(fanout: int):  # noqa: ANN202
    """Mountain ranges over the runs of numbered leaves that a task reads, wherever they begin and end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, due, m = None, None, Mountains(fanout)
        for batch in batches:
            out: list[tuple] = []
            for g, index, h in zip(*(batch.column(c).to_pylist() for c in ("grp", "idx", "h")), strict=True):
                if g != group or index != due:
                    m.close()
                    out += _rows(group, m)
                    group, m = g, Mountains(fanout)
                m.push(0, index, h)
                due = index + 1
            out += _rows(group, m)
            m.nodes, m.open = [], []
            yield _batch(out)
        m.close()
        yield _batch(_rows(group, m))

    return run


def _meet(fanout: int, top: int):  # noqa: ANN202
    """Open nodes of blocks of ``fanout ** top`` leaves, sorted by their first leaf; the row of level -1 says that the group ends here, at ``n``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, m = None, Mountains(fanout)
        for batch in batches:
            out: list[tuple] = []
            for g, block, level, index, h, n in zip(*(batch.column(c).to_pylist() for c in ("grp", "block", "level", "idx", "h", "n")), strict=True):
                if (g, block) != now:
                    if now is not None:
                        m.close()
                        out += _rows(now[0], m)
                    now, m = (g, block), Mountains(fanout)
                if level >= 0:
                    m.push(level, index, h)
                else:
                    root = m.finish(n, top)
                    if root is not None:
                        out.append(("root", g, None, None, root, n))
            yield _batch(out)
        if now is not None:
            m.close()
            yield _batch(_rows(now[0], m))

    return run


@dataclass
class Tree:
    """``leaves`` with ``idx`` in their group; ``nodes(grp, level, idx, h)`` above them; ``roots(grp, h, n)``; ``rounds`` of blocks."""

    leaves: DataFrame
    nodes: DataFrame
    roots: DataFrame
    rounds: int


def plant(leaves: DataFrame, order: list[str], fanout: int = FANOUT, step: int = STEP, parts: int | None = None) -> Tree:
    """Trees of ``leaves(grp string, h binary, ...)`` by group, the leaves of each ordered by ``order``."""
    spark = leaves.sparkSession
    total = leaves.count()
    parts = parts or max(-(-total // LEAVES), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // FEW)), 1)
    ranged = leaves.repartitionByRange(parts, "grp", *order).sortWithinPartitions("grp", *order)
    numbered, _ = written(arrow_map(ranged, _number, ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in leaves.schema) + ", part int, place long, lead boolean"), "merkle-leaves")
    # A group's run in a partition begins where its runs in earlier partitions end; only a partition's first group can have such.
    counts = numbered.groupBy("part", "grp").agg(F.count("*").alias("n"))
    before = counts.selectExpr("part", "sum(n) over (partition by grp order by part) - n as begin")
    begins = before.filter("begin > 0")  # at most one row for each partition
    placed = numbered.join(F.broadcast(begins.select("part", F.lit(True).alias("lead"), "begin")), ["part", "lead"], "left")
    placed = placed.withColumn("idx", F.col("place") + F.coalesce("begin", F.lit(0))).select(*leaves.columns, "idx")
    ends, _ = written(counts.groupBy("grp").agg(F.sum("n").alias("n")), "merkle-sizes")
    largest = ends.agg(F.max("n")).head()[0] or 1

    pick = lambda df, kind: df.filter(F.col("kind") == kind)
    found, _ = written(arrow_map(placed.select("grp", "idx", "h"), _climb(fanout), _OUT), "merkle-range")
    nodes, roots, rounds = pick(found, "node"), None, 0
    while True:
        rounds += 1
        width = fanout ** (step * rounds)
        first = F.col("idx") * F.pow(F.lit(fanout), "level").cast("long")
        left = pick(found, "open").select("grp", "level", "idx", "h", F.lit(None).cast("long").alias("n"), first.alias("first"))
        # Groups that fitted a narrower block have ended already.
        closing = ends.filter(F.col("n") > (fanout ** (step * (rounds - 1)) if rounds > 1 else 0))
        closing = closing.select("grp", F.lit(-1).alias("level"), F.lit(None).cast("long").alias("idx"), F.lit(None).cast("binary").alias("h"), "n", (F.col("n") - 1).alias("first"))
        both = left.unionByName(closing).withColumn("block", F.expr(f"first div {width}"))
        dealt = both.repartition("grp", "block").sortWithinPartitions("grp", "block", (F.col("level") < 0), "first")
        found, _ = written(arrow_map(dealt.select("grp", "block", "level", "idx", "h", "n"), _meet(fanout, step * rounds), _OUT), "merkle-range")
        nodes = nodes.unionByName(pick(found, "node"))
        ended = pick(found, "root").select("grp", "h", "n")
        roots = ended if roots is None else roots.unionByName(ended)
        if width >= largest:
            return Tree(placed, nodes.select("grp", "level", "idx", "h"), roots, rounds)


def _descend(fanout: int, step: int, extra: list[str]):  # noqa: ANN202
    """Paths of the nodes of each block: their siblings within it, then the path of the block, which its first row has."""

    def paths(nodes: list[bytes], above: bytes, top: bool) -> list[bytes]:
        levels = [nodes]
        while len(levels) <= step and not (top and len(levels[-1]) == 1):
            levels.append([digest(levels[-1][k : k + fanout]) for k in range(0, len(levels[-1]), fanout)])
        path = [above]
        for level in reversed(levels[:-1]):
            path = [bytes((t, len(run) - 1 - t)) + b"".join(run[:t] + run[t + 1 :]) + path[k // fanout] for k in range(0, len(level), fanout) for run in [level[k : k + fanout]] for t in range(len(run))]
        return path

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, above, top, held = None, None, False, []
        names = ["grp", "idx", *extra, "h"]

        def flush() -> Iterator[pa.RecordBatch]:
            if above is None:
                if extra or len(held) > 1:
                    raise RuntimeError(f"no path for {now}")
                return  # the root of a group that is lower than this round's blocks: its path comes in a later round
            got = paths([x[-1] for x in held], above[32:], top)
            for k in range(0, len(held), 512):
                some = held[k : k + 512]
                columns = [pa.array([x[c] for x in some], t) for c, t in enumerate(types)]
                columns += [pa.array([above[:32]] * len(some), pa.binary()), pa.array(got[k : k + 512], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, "subroot", "path"])

        types: list[pa.DataType] = []
        for batch in batches:
            types = [batch.schema.field(c).type for c in names]
            for g, block, p, t, *row in zip(*(batch.column(c).to_pylist() for c in ("grp", "block", "path", "top", *names)), strict=True):
                if (g, block) != now:
                    if held:
                        yield from flush()
                    now, held, above = (g, block), [], None
                if p is not None:
                    above, top = p, t
                else:
                    held.append(row)
        if held:
            yield from flush()

    return run


def prove(tree: Tree, above: DataFrame, extra: list[str], fanout: int = FANOUT, step: int = STEP) -> DataFrame:
    """The leaves of ``tree`` as ``grp, idx, *extra, h, subroot, path``: their siblings up to their group's root, then the path that ``above(grp, h, n, path)`` has for it.

    A path has for each level two bytes, the counts of siblings to the left and to the right, and their digests in order.
    """
    base = above.select("grp", "n", F.concat("h", "path").alias("path"))
    got = None
    for k in reversed(range(tree.rounds)):
        if k:
            rows, payload = tree.nodes.filter(F.col("level") == step * k).select("grp", "idx", "h"), []
        else:
            rows, payload = tree.leaves.select("grp", "idx", "h", *extra), extra
        fits = (F.col("n") <= fanout ** (step * (k + 1))) & (F.col("n") > (fanout ** (step * k) if k else 0))
        tops = base.filter(fits).select("grp", F.lit(0).cast("long").alias("block"), "path", F.lit(True).alias("top"))
        if got is not None:
            tops = tops.unionByName(got.select("grp", F.col("idx").alias("block"), F.concat("subroot", "path").alias("path"), F.lit(False).alias("top")))
        both = rows.withColumn("block", F.expr(f"idx div {fanout**step}")).unionByName(tops, allowMissingColumns=True)
        dealt = both.repartition("grp", "block").sortWithinPartitions("grp", "block", F.col("path").isNull(), "idx")
        kinds = dict(rows.dtypes)
        schema = ", ".join(f"`{c}` {kinds[c]}" for c in ("grp", "idx", *payload)) + ", h binary, subroot binary, path binary"
        got = arrow_map(dealt.select("grp", "block", "path", "top", "idx", *payload, "h"), _descend(fanout, step, payload), schema)
        if k:
            got, _ = written(got, "merkle-paths")
    return got


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "source", order: str = "doc_id", tampered: tuple[str, Column] | None = None, fanout: int = FANOUT, step: int = STEP, parts: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The manifest of ``docs``: proofs, node records and subroots.

    * ``order, leaf, tampered_leaf, subroot, root, path`` for each row; digests are 32 bytes, ``path`` is as in ``prove``
      from the leaf through its group's root to the root of all. ``tampered_leaf`` is the leaf with one field replaced, as
      ``tampered`` (a field and the column that stands for it) says, else null.
    * ``grp, level, idx, h`` of every node above the leaves; the tree over the subroots is not among them.
    * ``grp, h, n``: root and number of leaves of each group.

    Nulls are values of their own in every field; null groups are one group, before all others; groups are ordered by the
    bytes of their text. A null in ``order`` stands first. Rows of equal group and order stand by their digest, and each
    repeated row is a leaf. A very long text is hashed within its row. An empty table has no rows, nodes or groups. Other
    columns are left out, whatever their names.
    """
    name, other = tampered or (None, None)
    values = [F.col(c) for c in fields]
    swapped = leaf([other if c == name else F.col(c) for c in fields]) if name else F.lit(None).cast("binary")
    rows, at = written(docs.select(F.col(group).cast("string").alias("grp"), F.col(order).alias("ord"), leaf(values).alias("h"), swapped.alias("other")), "merkle-rows")
    rows = rows.withColumn("other", F.when(F.col("other") != F.col("h"), F.col("other")))
    trees = plant(rows, ["ord", "h"], fanout, step, parts)
    drop_path(docs.sparkSession, at)
    subroots, _ = written(trees.roots, "merkle-roots")
    summit = plant(subroots.select(F.lit("").alias("grp"), F.col("grp").alias("of"), "h", "n"), ["of"], fanout, step, parts)
    # The root of all is one row; it goes along as a constant.
    found = summit.roots.head()
    root = bytes(found["h"]) if found else b""
    whole = summit.roots.select("grp", "h", "n", F.unhex(F.lit("")).alias("path"))
    above, _ = written(prove(summit, whole, ["of"], fanout, step).select("of", "path"), "merkle-above")
    top = subroots.join(above, F.col("grp").eqNullSafe(F.col("of"))).select("grp", "h", "n", "path")
    proofs = prove(trees, top, ["ord", "other"], fanout, step)
    return proofs.select(F.col("ord").alias(order), F.col("h").alias("leaf"), F.col("other").alias("tampered_leaf"), "subroot", F.unhex(F.lit(root.hex())).alias("root"), "path"), trees.nodes, subroots


def folded(h: bytes, path: bytes) -> tuple[bytes, bytes]:
    """The root that a leaf and its siblings lead to, and the digest of the siblings' hex texts in order."""
    seen, at = sha256(), 0
    while at < len(path):
        left, right = path[at], path[at + 1]
        at += 2
        sides = [path[at + 32 * k : at + 32 * k + 32] for k in range(left + right)]
        at += 32 * (left + right)
        seen.update("".join(s.hex() for s in sides).encode())
        h = digest([*sides[:left], h, *sides[left:]])
    return h, seen.digest()


def audited(proofs: DataFrame, order: str = "doc_id") -> DataFrame:
    """``proofs`` of ``manifest`` read back: ``order``, the digests in hex, ``proof_sha256`` over the siblings, ``folded_root`` from the tampered leaf (else the leaf) and whether it is the root."""
    rows = proofs.select(F.col(order).alias("ord"), "leaf", "subroot", "root", F.coalesce("tampered_leaf", "leaf").alias("seen"), "path")

    def fold(batch: pa.RecordBatch) -> dict:
        got = [folded(h, p) for h, p in zip(batch.column("seen").to_pylist(), batch.column("path").to_pylist(), strict=True)]
        return {**{c: batch.column(c) for c in ("ord", "leaf", "subroot", "root")}, "folded_root": [x[0] for x in got], "proof_sha256": [x[1] for x in got]}

    kind = dict(rows.dtypes)["ord"]
    out = map_arrow(rows, fold, f"ord {kind}, leaf binary, subroot binary, root binary, folded_root binary, proof_sha256 binary")
    told = [F.lower(F.hex(c)).alias(c) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")]
    return out.select(F.col("ord").alias(order), *told, (F.col("folded_root") == F.col("root")).alias("verified"))
