"""Minimax contiguous sharding of atomic groups.

Rows with equal texts form one group that no cut may split. Groups stand in
the order of a 128-bit key, and the capacity is the smallest for which a greedy
walk along that order needs at most ``n_shards`` runs; the shards are those
runs. A group above the mean shard size gets a shard of its own first, so that
one huge group does not leave the other shards empty.

The driver never sees the groups. It sees sums over key ranges and divides only
the ranges that a candidate cut falls into, so what it holds is bounded by the
number of shards and steps, not by the input.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillmark.llm.common import written

#: Hex digits of the key that tell the first ranges, and that each division adds.
FIRST, MORE = 3, 2
NULL_KEY = "0" * 32


class _Ranges:
    """Sums over ranges of the key: ``keys`` (prefixes, sorted), ``sizes``, ``single`` (holds one group)."""

    def __init__(self, rows: list[tuple[str, int, int]]) -> None:
        self.rows = {k: (s, n) for k, s, n in rows}
        self._sort()

    def _sort(self) -> None:
        self.keys = sorted(self.rows)
        self.ends = list(accumulate(self.rows[k][0] for k in self.keys))
        self.single = [self.rows[k][1] == 1 for k in self.keys]

    def replace(self, gone: set[str], rows: list[tuple[str, int, int]]) -> None:
        for k in gone:
            del self.rows[k]
        self.rows |= {k: (s, n) for k, s, n in rows}
        self._sort()

    def walk(self, capacity: int, n: int, hopeful: bool) -> tuple[bool, list[int], set[str]]:
        """Greedy runs of at most ``capacity``: whether ``n`` suffice, the range each run begins at, and the ranges of several groups that a cut met.

        A cut within a range of several groups is taken where it falls if ``hopeful``
        (no real walk gets further), else at the start of the range (any real walk gets as far).
        """
        at, total, last, starts, met = 0, 0, self.ends[-1] if self.ends else 0, [], set()
        for _ in range(n):
            if at >= last:
                break
            i = bisect_right(self.ends, at + capacity)
            starts.append(bisect_right(self.ends, at))
            total = self.ends[i - 1] if i else 0
            if i < len(self.keys) and not self.single[i]:
                met.add(self.keys[i])
                if hopeful:
                    total = at + capacity
            if total <= at:
                break
            at = total
        return at >= last, starts, met

    def least(self, n: int, hopeful: bool) -> int:
        low, high = max(1, -(-self.ends[-1] // n)), self.ends[-1]
        while low < high:
            mid = (low + high) // 2
            if self.walk(mid, n, hopeful)[0]:
                high = mid
            else:
                low = mid + 1
        return low


def minimax_cuts(groups: DataFrame, n_shards: int) -> tuple[dict[str, int], list[str]]:
    """Shards for ``groups(key, size)``, one row for each group, ``key`` of 32 hex digits, ``size`` over 0.

    Returns the groups that get a shard of their own (numbered from 0), and the
    first key of each further shard but the first of them. The answer is exact:
    for any capacity the walk that is too hopeful and the one that is too
    careful bound the real one, and ranges in which they part are divided until
    they agree.
    """
    own: dict[str, int] = {}
    total, n_groups = groups.agg(F.sum("size"), F.count("*")).head()
    rest = total or 0
    while n_groups and len(own) < n_shards - 1:
        mean = rest / (n_shards - len(own))
        more = [r for r in groups.filter(F.col("size") > mean).filter(~F.col("key").isin(list(own)) if own else F.lit(True)).orderBy(F.desc("size"), "key").limit(n_shards - 1 - len(own)).collect()]
        if not more:
            break
        for r in more:
            own[r["key"]] = len(own)
            rest -= r["size"]
    if own:
        groups = groups.filter(~F.col("key").isin(list(own)))
    n = n_shards - len(own)
    sums = lambda df, digits: [tuple(r) for r in df.groupBy(F.substring("key", 1, digits).alias("k")).agg(F.sum("size"), F.count("*")).collect()]
    ranges = _Ranges(sums(groups, FIRST))
    if not ranges.keys:
        return own, []
    while True:
        low, high = ranges.least(n, True), ranges.least(n, False)
        met: set[str] = set()
        for c in {low, (low + high) // 2, high} if low < high else {low}:
            for hopeful in (True, False):
                met |= ranges.walk(c, n, hopeful)[2]
        if not met:
            ok, starts, _ = ranges.walk(high, n, False)
            assert ok
            return own, [ranges.keys[i] for i in starts[1:]]
        new: list[tuple[str, int, int]] = []
        for digits in {len(k) for k in met}:
            new += sums(groups.filter(F.substring("key", 1, digits).isin([k for k in met if len(k) == digits])), digits + MORE)
        ranges.replace(met, new)


def shard_rows(df: DataFrame, n_shards: int = 16, text: str = "text", id_col: str = "doc_id", salts: int = 1024) -> DataFrame:
    """``id_col, size, text_crc32, shard, slot`` for each row of ``df``, by UTF-8 bytes plus one.

    Null texts have size 1 and are one group, apart from empty ones; null ids are
    kept; repeated rows each count; an empty table gives no rows. ``slot`` numbers
    a shard's rows from 0 without gaps: rows are dealt to ``salts`` cells of a
    shard by their id, so no window and no count needs one task for a shard.
    """
    t = F.col(text)
    # A part that equal texts share may be very large: cells are keyed by id, and the group's sums are pre-aggregated.
    rows, _ = written(
        df.select(
            F.col(id_col).alias("id"),
            (F.coalesce(F.octet_length(t), F.lit(0)) + 1).cast("long").alias("size"),
            F.coalesce(F.crc32(F.encode(t, "UTF-8")), F.lit(0)).cast("long").alias("text_crc32"),
            F.coalesce(F.md5(F.encode(t, "UTF-8")), F.lit(NULL_KEY)).alias("key"),
        ),
        "shard-rows",
    )
    groups, _ = written(rows.groupBy("key").agg(F.sum("size").alias("size")), "shard-groups")
    own, cuts = minimax_cuts(groups, n_shards)
    shard: Column = F.lit(len(own))
    for k, cut in enumerate(cuts):
        shard = F.when(F.col("key") >= cut, len(own) + 1 + k).otherwise(shard)
    for key, k in own.items():
        shard = F.when(F.col("key") == key, k).otherwise(shard)
    cells = rows.withColumn("shard", shard.cast("int")).withColumn("cell", (F.coalesce(F.crc32(F.encode(F.col("id").cast("string"), "UTF-8")), F.lit(0)) % salts).cast("int"))
    counts = sorted(tuple(r) for r in cells.groupBy("shard", "cell").count().collect())  # n_shards x salts rows at most
    begins, at, of = [], 0, None
    for s, c, n in counts:
        at, of = (at, of) if s == of else (0, s)
        begins.append((s, c, at))
        at += n
    spark = df.sparkSession
    offsets = spark.createDataFrame(begins, "shard int, cell int, begin long")
    ranked = cells.selectExpr("*", "row_number() over (partition by shard, cell order by id, key) - 1 as rank")
    return ranked.join(F.broadcast(offsets), ["shard", "cell"]).select(F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("begin") + F.col("rank")).cast("long").alias("slot"))
