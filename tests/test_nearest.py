"""Exact nearest vectors against all pairs: clusters, none, ties, odd lengths; how many blocks meet."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillmark.operators import matching, nearest

Q, C = "query_id long, embedding array<float>", "product_id string, embedding array<float>"


def unit(x):
    x = np.asarray(x, np.float32)
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def plain(queries, catalog, k, floor):
    """Ranks by exact dot product, ties by id."""
    out = {}
    for q, a in queries:
        a = np.asarray(a, np.float32).astype(np.float64)
        sims = sorted((-float((np.asarray(b, np.float32).astype(np.float64) * a).sum()), p) for p, b in catalog)
        out.update({(q, p): r for r, (s, p) in enumerate(sims[:k], 1) if -s >= floor})
    return out


def got(spark, queries, catalog, k, floor, **how):
    q, c = (spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], s) for rows, s in ((queries, Q), (catalog, C)))
    n = nearest.nearest(q, c, k, floor, **how)
    ranks = matching.candidates(q, c, k, floor, how.get("block_rows", 4096)).collect()
    return n, {(r["query_id"], r["product_id"]): r["rank"] for r in ranks}


def clustered(seed, clusters, each, d, spread):
    rng = np.random.default_rng(seed)
    centres = unit(rng.normal(size=(clusters, d)))
    return unit(np.repeat(centres, each, axis=0) + rng.normal(size=(clusters * each, d)) * spread)


@pytest.mark.parametrize("floor", [-1.0, 0.6])
def test_clusters_meet_few_blocks(spark, floor):
    v = clustered(1, 30, 40, 24, 0.03)
    queries = [(i, x) for i, x in enumerate(clustered(1, 30, 10, 24, 0.03))]
    catalog = [(f"p{i:04d}", x) for i, x in enumerate(v)]
    n, ranks = got(spark, queries, catalog, 5, floor, block_rows=40)
    assert ranks == plain(queries, catalog, 5, floor)
    met = n.pairs.count()
    assert n.blocks >= 30 and n.chunks >= 20 and met == n.pairs.select("chunk", "block").distinct().count() < 0.2 * n.blocks * n.chunks


@pytest.mark.parametrize(("d", "rows", "block_rows"), [(3, 200, 17), (16, 150, 20), (2, 60, 1000)])
def test_without_clusters(spark, d, rows, block_rows):
    rng = np.random.default_rng(d)
    queries = list(enumerate(unit(rng.normal(size=(40, d)))))
    catalog = [(f"p{i:04d}", x) for i, x in enumerate(unit(rng.normal(size=(rows, d))))]
    _, ranks = got(spark, queries, catalog, 7, 0.2, block_rows=block_rows)
    assert ranks == plain(queries, catalog, 7, 0.2)


def test_ties_and_a_large_group_of_copies(spark):
    rng = np.random.default_rng(4)
    one = unit(rng.normal(size=8))
    catalog = [(f"p{i:04d}", one if i % 3 else x) for i, x in enumerate(unit(rng.normal(size=(120, 8))))]
    queries = [(0, one), (1, -one), (2, unit(rng.normal(size=8)))]
    _, ranks = got(spark, queries, catalog, 5, 0.1, block_rows=11)
    assert ranks == plain(queries, catalog, 5, 0.1)


def test_other_lengths_nulls_and_empty_tables(spark):
    rng = np.random.default_rng(6)
    catalog = [(f"p{i:03d}", x * (1 + i % 4)) for i, x in enumerate(unit(rng.normal(size=(60, 5))))] + [("zero", np.zeros(5))]
    queries = list(enumerate(unit(rng.normal(size=(9, 5)))))
    n, ranks = got(spark, queries, catalog, 4, 0.5, block_rows=9)
    assert ranks == plain(queries, catalog, 4, 0.5)
    assert n.pairs.count() == n.blocks * n.chunks  # bounds hold for vectors of length one only
    q = spark.createDataFrame([(1, None), (2, [1.0, 0.0])], Q)
    c = spark.createDataFrame([("a", None), ("b", [1.0, 0.0])], C)
    assert [(r["query_id"], r["product_id"]) for r in matching.candidates(q, c).collect()] == [(2, "b")]
    assert matching.candidates(q, c.limit(0)).collect() == [] and matching.candidates(q.limit(0), c).collect() == []


def test_copies_are_held_once_and_blocks_are_sent_once_for_each_group(spark, monkeypatch):
    rng = np.random.default_rng(8)
    monkeypatch.setattr(nearest, "LOTS", 2)
    monkeypatch.setattr(nearest, "GROUPS", 3)
    v = unit(rng.normal(size=(12, 6)))
    catalog = [(f"p{i:04d}", v[i % 12]) for i in range(180)]
    queries = [(i, v[i % 12]) for i in range(90)]
    n, ranks = got(spark, queries, catalog, 4, -1.0, block_rows=20)
    assert ranks == plain(queries, catalog, 4, -1.0)
    (blocks,) = [t for t in n.tables if "tillmark-blocks-" in t]
    packed = spark.read.parquet(blocks).selectExpr("octet_length(block_vectors) / 24 as held", "size(block_ids) as ids").collect()
    assert sum(r["ids"] for r in packed) == 180 and all(r["held"] <= 12 for r in packed) and sum(r["held"] for r in packed) < 180
    assert n.pairs.select("block", "group").distinct().count() <= 3 * n.blocks and n.pairs.select("chunk", "lot").distinct().count() <= 2 * n.chunks


def test_a_task_holds_no_more_than_a_lot_and_a_group_however_many_there_are(spark, monkeypatch):
    rng = np.random.default_rng(9)
    for name, n in (("LOT", 3), ("GROUP", 2), ("LOTS", 1), ("GROUPS", 1)):
        monkeypatch.setattr(nearest, name, n)
    for rows in (60, 240):
        catalog = [(f"p{i:04d}", x) for i, x in enumerate(unit(rng.normal(size=(rows, 6))))]
        queries = list(enumerate(unit(rng.normal(size=(rows // 2, 6)))))
        n, ranks = got(spark, queries, catalog, 4, 0.2, block_rows=10)
        assert ranks == plain(queries, catalog, 4, 0.2)
        held = n.pairs.groupBy("group", "lot").agg(F.countDistinct("block").alias("blocks"), F.countDistinct("chunk").alias("chunks")).collect()
        assert n.blocks >= rows // 10 and len(held) > 1 and all(r["blocks"] <= 3 and r["chunks"] <= 2 for r in held)


@pytest.mark.parametrize(("d", "rows", "floor", "block_rows"), [(3, 120, 0.97, 17), (2, 90, -1.0, 20), (16, 80, 0.99, 9), (8, 150, 0.6, 1000)])
def test_links_join_what_pairs_join_and_are_few(spark, d, rows, floor, block_rows):
    rng = np.random.default_rng(d)
    v = unit(np.concatenate([rng.normal(size=(rows // 2, d)), np.repeat(rng.normal(size=(5, d)), rows // 10, axis=0) + rng.normal(size=(rows // 10 * 5, d)) * 0.05]))
    n = nearest.linked(spark.createDataFrame([(i, [float(x) for x in y]) for i, y in enumerate(v)], "id long, embedding array<float>"), floor, block_rows)

    def parts(pairs):
        part = list(range(len(v)))
        for a, b in pairs:
            old, new = part[a], part[b]
            part = [new if p == old else p for p in part]
        return {frozenset(i for i, p in enumerate(part) if p == q) for q in set(part)}

    pairs = [(r["query_id"], r["product_id"]) for r in n.found.collect()]
    want = np.argwhere(v.astype(np.float64) @ v.astype(np.float64).T >= floor)
    assert parts(pairs) == parts(want.tolist())
    tasks = n.pairs.select("group", "lot").distinct().count()
    assert len(pairs) <= 2 * len(v) * max(tasks, 1)
