"""Places within groups of any size: rows are sorted in ranges of (group, keys) and counted, so that no task gets a group.

A window over a group is one task, which for a hundred shoppers of a chain or one of a million lines is too large.
Here the rows are dealt by ranges of (group, keys) over all partitions and written with their place in that order;
how many rows of a group stand in earlier partitions is a sum over counts, a row for each group and partition.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tillmark.sources.shared import written

#: ``monotonically_increasing_id`` counts rows in the lower bits and partitions above.
_ROW_BITS = 33


def place_in_groups(df: DataFrame, by: list[str], order: list[Column], name: str = "rank", parts: int | None = None) -> DataFrame:
    """``df`` with ``name``, the place from 1 on (int) of each row in its group of ``by`` in the given ``order``.

    Null groups are groups. Rows that are equal in all of ``order`` get places in any order, each its own.
    """
    groups = [F.asc_nulls_first(c) for c in by]
    n = [parts] if parts else []
    ranged = df.repartitionByRange(*n, *groups, *order).sortWithinPartitions(*groups, *order)
    at, part = "_at", "_part"
    rows = written(ranged.withColumn(at, F.monotonically_increasing_id()), "ranges").withColumn(part, F.shiftright(at, _ROW_BITS))
    runs = rows.groupBy(*by, part).agg(F.min(at).alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*by).orderBy(part).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # The place is the number in the partition, less where the group's run begins there, plus what came before.
    runs = runs.select(*(F.col(c).alias(f"_by_{c}") for c in by), F.col(part).alias("_run"), (before - F.col("_first") + 1).alias("_shift"))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by), F.col(part) == F.col("_run"))
    return rows.join(runs, same).withColumn(name, (F.col(at) + F.col("_shift")).cast("int")).select(*df.columns, name)
