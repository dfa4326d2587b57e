"""A batch resolved in rounds against the plain loop that takes one string after another."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillmark.operators import resolution
from tillmark.operators.resolution import resolve_in_order
from tillmark.operators.providers import adjudicator

P = "key long, store string, raw_description string, brand string, product string, variant string, needs_review boolean, embedding array<float>"
C = "product_id string, brand string, product string, variant string, aliases array<string>, embedding array<float>"


def told(x):
    x = (x or "").strip().lower()
    return x or None


def verdict(a, b):
    for c in ("brand", "variant"):
        if told(a[c]) and told(b[c]) and told(a[c]) != told(b[c]):
            return "different"
    return "same" if told(a["product"]) and told(a["product"]) == told(b["product"]) else "unsure"


def one_by_one(spark, parsed, catalog, k, floor, judge=None):
    """The loop; ids of new products are those of the operator."""
    from hashlib import sha256

    names = ("brand", "product", "variant")
    entries = [{"id": c[0], "entry": f"{c[0]}#-1", **dict(zip(names, c[1:4], strict=True)), "v": c[5]} for c in catalog]
    aliases = {}
    for c in sorted(catalog, key=lambda c: c[0]):
        for a in c[4]:
            aliases.setdefault(a, c[0])
    out = {}
    for key, store, text, brand, product, variant, review, v in sorted(parsed, key=lambda r: r[0]):
        alias = f"{((store or '').strip() or 'unknown').upper()}||{(text or '').strip()}"
        me = {"brand": brand, "product": product, "variant": variant}
        if alias in aliases:
            out[key] = ("matched", aliases[alias])
            continue
        if not product or review:
            out[key] = ("review", None)
            continue
        a = np.array(v, np.float32).astype(float)
        near = sorted(((-float((np.array(e["v"], np.float32).astype(float) * a).sum()), e["entry"], e) for e in entries if e["v"] is not None), key=lambda x: x[:2])
        said = []
        for s, _, e in near[:k]:
            if -s >= floor:
                w = verdict(me, e)
                said.append((judge(me, e) if judge and w == "unsure" else w, e))
        same, unsure = ([e for w, e in said if w == kind] for kind in ("same", "unsure"))
        if same:
            out[key] = ("matched", same[0]["id"])
        elif unsure:
            out[key] = ("review", unsure[0]["id"])
            continue
        else:
            new = sha256(alias.encode()).hexdigest()[:16]
            entries.append({"id": new, "entry": f"{new}#{key}", **me, "v": v})
            out[key] = ("created", new)
        aliases[alias] = out[key][1]
    return out


def batch(seed, n, d=4):
    rng = random.Random(seed)
    gen = np.random.default_rng(seed)
    centres = gen.normal(size=(max(3, n // 8), d))
    rows = []
    for k in range(n):
        v = rng.choice(list(centres)) + gen.normal(size=d) * rng.choice([0.02, 0.3])
        v = v / np.linalg.norm(v)
        rows.append((k * 3, rng.choice(["s", "t", None]), f"text {rng.randrange(max(2, n // 2))}", rng.choice([None, None, "A", "b"]), rng.choice([None, "milk", "Milk ", "oats", "tea"]), rng.choice([None, None, "x", "y"]), rng.random() < 0.1, [float(x) for x in v]))
    rng.shuffle(rows)
    take = rng.sample(rows, n // 6)
    catalog = [(f"p{i:03d}", r[3], r[4] or "salt", r[5], [f"S||text {rng.randrange(9)}"] if i % 3 == 0 else [], r[7] if i % 4 else None) for i, r in enumerate(take)]
    return rows, catalog


@pytest.mark.parametrize(("seed", "n", "k", "floor"), [(1, 60, 5, 0.6), (2, 150, 2, 0.3), (4, 12, 1, -1.0)])
def test_rounds_give_what_the_loop_gives(spark, seed, n, k, floor):
    rows, catalog = batch(seed, n)
    got, rounds = resolve_in_order(spark.createDataFrame(rows, P), spark.createDataFrame(catalog, C), top_k=k, floor=floor, block_rows=40)
    want = one_by_one(spark, rows, catalog, k, floor)
    assert {r["key"]: (r["outcome"], r["product_id"]) for r in got.collect()} == want
    assert rounds <= 15
    assert {w for w, _ in want.values()} == {"matched", "review", "created"}


def test_a_second_string_for_a_new_product_becomes_its_alias(spark):
    v = [1.0, 0.0]
    rows = [(1, "s", "GUAVA", None, "guava", None, False, v), (2, "s", "GUAVAS 2LB", None, "Guava", None, False, v), (3, "s", "GUAVAS 2LB", None, None, None, True, v), (4, "t", "G", "b", "guava", "red", False, v), (5, "t", "H", "c", "guava", None, False, v)]
    got, _ = resolve_in_order(spark.createDataFrame(rows, P), spark.createDataFrame([], C))
    by = {r["key"]: (r["outcome"], r["product_id"]) for r in got.collect()}
    assert by[1][0] == "created" and by[2] == by[3] == by[4] == by[5] == ("matched", by[1][1])


def test_a_large_group_settles_in_few_rounds(spark):
    rows = [(k, "s", f"t{k}", None if k % 5 else "a", "milk" if k % 7 else "whole milk", None, False, [1.0, 0.001 * (k % 11)]) for k in range(400)]
    got, rounds = resolve_in_order(spark.createDataFrame(rows, P), spark.createDataFrame([], C), block_rows=100)
    assert {r["key"]: (r["outcome"], r["product_id"]) for r in got.collect()} == one_by_one(spark, rows, [], 5, 0.6)
    assert rounds <= 6


def test_unsure_pairs_are_judged_once(spark):
    rows, catalog = batch(9, 60)
    judge = lambda a, b: "same" if (told(a["product"]) or "")[:1] <= "n" and (told(b["product"]) or "")[:1] <= "n" else "different"
    asked = []

    def adjudicate(pairs):
        asked.append([tuple(r) for r in pairs.select("at", "entry").collect()])
        return adjudicator(judge)(pairs)

    got, rounds = resolve_in_order(spark.createDataFrame(rows, P), spark.createDataFrame(catalog, C), adjudicate, block_rows=1000)
    assert {r["key"]: (r["outcome"], r["product_id"]) for r in got.collect()} == one_by_one(spark, rows, catalog, 5, 0.6, judge)
    all_ = sum(asked, [])
    assert len(all_) == len(set(all_)) and len(asked) == rounds


def test_what_does_not_settle_is_an_error(spark):
    rows, catalog = batch(2, 150)
    with pytest.raises(RuntimeError, match="settle"):
        resolve_in_order(spark.createDataFrame(rows, P), spark.createDataFrame(catalog, C), top_k=2, floor=0.3, max_rounds=1)


def test_nothing_to_resolve(spark):
    empty = spark.createDataFrame([], P)
    got, _ = resolve_in_order(empty, spark.createDataFrame([], C))
    assert got.collect() == [] and got.select(F.col("outcome")).schema[0].dataType.simpleString() == "string"


def test_tables_of_past_rounds_are_deleted(spark):
    import os

    at = spark.sparkContext.getConf().get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(at)) if os.path.exists(at) else set()
    rows, catalog = batch(5, 30)
    got, rounds = resolve_in_order(spark.createDataFrame(rows, P), spark.createDataFrame(catalog, C), block_rows=40)
    left = sorted(x.split("-")[1] for x in set(os.listdir(at)) - before if x.startswith("tillmark-"))
    assert rounds > 1 and left == ["decisions", "strings"]
    assert {r["key"]: (r["outcome"], r["product_id"]) for r in got.collect()} == one_by_one(spark, rows, catalog, 5, 0.6)


def test_a_long_chain_is_read_in_one_round(spark):
    """Each string is unsure of the one before it and differs from the one before that, so every other one is created."""
    rows = [(i, "s", f"t{i}", None if i % 2 else "ab"[i // 2 % 2], f"p{i}", "xy"[i // 2 % 2] if i % 2 else None, False, [float(np.cos(i / 100)), float(np.sin(i / 100))]) for i in range(40)]
    got, rounds = resolve_in_order(spark.createDataFrame(rows, P), spark.createDataFrame([], C), top_k=1, max_rounds=8)
    by = {r["key"]: (r["outcome"], r["product_id"]) for r in got.collect()}
    assert by == one_by_one(spark, rows, [], 1, 0.6) and rounds == 1
    assert [by[i][0] for i in range(40)] == ["created", "review"] * 20


@pytest.mark.parametrize("slab", [7, 40])
def test_parts_larger_than_a_slab(spark, monkeypatch, slab):
    monkeypatch.setattr(resolution, "SLAB", slab)
    rows, catalog = batch(3, 90)
    got, rounds = resolve_in_order(spark.createDataFrame(rows, P), spark.createDataFrame(catalog, C), block_rows=30)
    assert {r["key"]: (r["outcome"], r["product_id"]) for r in got.collect()} == one_by_one(spark, rows, catalog, 5, 0.6)
    assert rounds > 1


def test_each_different_vector_is_searched_for_once_and_hashes_that_two_share_are_not_used(spark, monkeypatch):
    searched = []
    hashed, linked = resolution.vector_hash, resolution.linked
    monkeypatch.setattr(resolution, "vector_hash", lambda seed: F.hash(F.lit(7)).cast("long") if seed == 0 else hashed(seed))
    monkeypatch.setattr(resolution, "linked", lambda vectors, *how: (searched.append(vectors.count()), linked(vectors, *how))[1])
    rows = [(k, "s", f"t{k}", None if k % 5 else "a", "milk" if k % 7 else "whole milk", None, False, [1.0, 0.001 * (k % 11)] if k % 13 else None) for k in range(200)]
    got, _ = resolve_in_order(spark.createDataFrame(rows, P), spark.createDataFrame([], C), block_rows=4)
    by = {r["key"]: (r["outcome"], r["product_id"]) for r in got.collect()}
    seen = [r for r in rows if r[7]]
    assert searched == [11] and {k: v for k, v in by.items() if k % 13} == one_by_one(spark, seen, [], 5, 0.6)
    assert all(by[k][0] == "created" for k in range(0, 200, 13))
