"""Places in groups against a plain sort: one group over many partitions, null groups and keys, equal rows."""

import random

import pytest
from pyspark.sql import functions as F

from tillmark.operators.ranks import place_in_groups


@pytest.mark.parametrize(("n", "groups", "parts"), [(500, 1, 13), (300, 40, 7), (200, 3, None), (0, 1, 3)])
def test_places(spark, n, groups, parts):
    rng = random.Random(n)
    rows = [(rng.choice([None, *range(groups)]) if groups > 1 else 7, rng.choice([None, *range(20)]), k) for k in range(n)]
    df = spark.createDataFrame(rows, "g int, x int, k int")
    got = place_in_groups(df, ["g"], [F.desc_nulls_last("x"), F.asc_nulls_first("k")], parts=parts)
    want = {}
    for r in sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[2])):
        want.setdefault(r[0], []).append(r)
    assert sorted((r["rank"], str(r["g"]), r["k"]) for r in got.collect()) == sorted((i, str(g), r[2]) for g, x in want.items() for i, r in enumerate(x, 1))
    assert got.columns == ["g", "x", "k", "rank"]


def test_no_task_gets_a_group(spark):
    df = spark.range(4000).select(F.lit("one").alias("g"), (F.col("id") % 97).alias("x"), "id")
    got = place_in_groups(df, ["g"], [F.col("x"), F.col("id")], parts=16)
    sizes = [spark.read.parquet(f).count() for f in set(got.inputFiles())]  # one for each task that sorted
    assert len(sizes) == 16 and max(sizes) < 800
    assert got.agg(F.max("rank"), F.count_distinct("rank")).head() == (4000, 4000)


def test_equal_rows_have_places_of_their_own(spark):
    df = spark.createDataFrame([(1, 5)] * 30 + [(2, 5)], "g int, x int")
    got = place_in_groups(df, ["g"], [F.col("x")], parts=4)
    assert sorted(r["rank"] for r in got.filter("g = 1").collect()) == list(range(1, 31))
