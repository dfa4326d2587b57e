"""The store: all tables of one version or none, replaced receipts, cascades, references, streams that repeat themselves."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tillmark.sources.store import BrokenReference, Conflict, Store, Transaction
from tillmark.streaming import ingest as streaming

R = "receipt_id long, source_file string, total_cents long, shopper_id long"
L = "line_item_id long, receipt_id long, line_number int, raw_description string, product_id string"
C = "receipt_id long, check_name string, status string"


def receipts(spark, *rows):
    return spark.createDataFrame(rows, R)


def lines(spark, *rows):
    return spark.createDataFrame(rows, L)


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store", buckets=8)


def save(store, *args):
    tx = store.begin()
    tx.save_receipts(*args)
    return tx.commit()


def seen(snapshot):
    r = sorted((x["source_file"], x["receipt_id"], x["total_cents"], x["shopper_id"]) for x in snapshot.table("receipts").collect())
    li = sorted((x["receipt_id"], x["line_number"], x["raw_description"]) for x in snapshot.table("line_items").collect())
    return r, li


def first(store, spark):
    tx = store.begin()
    tx.put("shoppers", spark.createDataFrame([(7, "ann")], "shopper_id long, name_key string"))
    tx.save_receipts(
        receipts(spark, (1, "a.jpg", 100, 7), (2, "b.jpg", 200, None)), lines(spark, (11, 1, 1, "milk", None), (12, 1, 2, "okra", None), (21, 2, 1, "rice", None)),
        spark.createDataFrame([(1, "item_count", "pass"), (2, "item_count", "fail")], C),
    )
    return tx.commit()


def test_a_receipt_is_replaced_with_its_lines_and_keeps_its_owner(spark, store):
    assert store.snapshot().table("receipts").count() == 0
    assert first(store, spark) == 1
    old = store.snapshot()
    assert save(store, receipts(spark, (5, "a.jpg", 150, None), (4, "a.jpg", 1, None)), lines(spark, (51, 5, 1, "milk 2", None), (41, 4, 1, "of the loser", None))) == 2
    assert seen(store.snapshot()) == ([("a.jpg", 5, 150, 7), ("b.jpg", 2, 200, None)], [(2, 1, "rice"), (5, 1, "milk 2")])
    assert [r["receipt_id"] for r in store.snapshot().table("validation_results").collect()] == [2]
    assert seen(old) == ([("a.jpg", 1, 100, 7), ("b.jpg", 2, 200, None)], [(1, 1, "milk"), (1, 2, "okra"), (2, 1, "rice")])  # a reader of the old version still has all of it
    assert seen(store.snapshot(1)) == seen(old)


def test_only_touched_buckets_are_rewritten(spark, store):
    save(store, receipts(spark, *[(k, f"f{k}.jpg", k, None) for k in range(100)]), lines(spark, *[(k, k, 1, "x", None) for k in range(100)]))
    before = store.snapshot().files
    save(store, receipts(spark, (3, "f3.jpg", -3, None)), lines(spark, (3, 3, 1, "y", None)))
    after = store.snapshot().files
    assert len(before["receipts"]) == 8
    assert sum(before["receipts"][b] != after["receipts"][b] for b in range(8)) == 1
    assert sum(before["line_items"][b] != after["line_items"][b] for b in range(8)) == 1
    one = store.snapshot().lookup("receipts", "f3.jpg")
    assert [r["total_cents"] for r in one.collect()] == [-3]
    assert {f.split("bucket=")[1][0] for f in one.inputFiles()} == {str(b) for b in range(8) if before["receipts"][b] != after["receipts"][b]}


@pytest.mark.parametrize("step", [0, 2, 3, 4])
def test_a_crash_between_two_writes_leaves_the_old_version(spark, store, step, monkeypatch):
    first(store, spark)
    was, count = seen(store.snapshot()), [0]

    def dying(f):
        def run(*args):
            count[0] += 1
            if count[0] > step:
                raise RuntimeError("killed")
            return f(*args)

        return run

    monkeypatch.setattr(Transaction, "_rewrite", dying(Transaction._rewrite))
    monkeypatch.setattr(Store, "_publish", dying(Store._publish))
    tx = store.begin()
    args = receipts(spark, (9, "a.jpg", 900, None)), lines(spark, (91, 9, 1, "new", None)), spark.createDataFrame([(9, "item_count", "pass")], C)
    if step < 4:  # three tables and the manifest
        with pytest.raises(RuntimeError, match="killed"):
            tx.save_receipts(*args)
            tx.commit()
        assert seen(store.snapshot()) == was
        monkeypatch.undo()
        save(store, *args)  # and the store goes on
    else:
        tx.save_receipts(*args)
        tx.commit()
    assert seen(store.snapshot())[0] == [("a.jpg", 9, 900, 7), ("b.jpg", 2, 200, None)]
    assert seen(store.snapshot())[1] == [(2, 1, "rice"), (9, 1, "new")]
    store.vacuum(keep=1)
    assert seen(store.snapshot())[1] == [(2, 1, "rice"), (9, 1, "new")]
    assert store._versions() == [2]


def test_two_writers(spark, store):
    first(store, spark)
    a, b = store.begin(), store.begin()
    a.save_receipts(receipts(spark, (3, "c.jpg", 3, None)))
    b.save_receipts(receipts(spark, (4, "d.jpg", 4, None)))
    a.commit()
    with pytest.raises(Conflict):
        b.commit()
    assert [r[0] for r in seen(store.snapshot())[0]] == ["a.jpg", "b.jpg", "c.jpg"]


def test_deletes_cascade_and_say_what_was_there(spark, store):
    first(store, spark)
    tx = store.begin()
    tx.save_products(spark.createDataFrame([("p", "milk")], "product_id string, canonical_text string"))
    said = tx.delete_receipts(spark.createDataFrame([(1,), (99,), (1,)], "receipt_id long")).collect()
    tx.commit()
    assert sorted((r["receipt_id"], r["existed"]) for r in said) == [(1, True), (99, False)]
    now = store.snapshot()
    assert seen(now) == ([("b.jpg", 2, 200, None)], [(2, 1, "rice")])
    assert now.table("validation_results").count() == 1 and now.table("products").count() == 1


def test_upserts_updates_and_owners(spark, store):
    first(store, spark)
    P = "product_id string, canonical_text string, embedding array<float>, created_at string"
    A = "store string, raw_description string, product_id string"
    tx = store.begin()
    tx.save_products(spark.createDataFrame([("p", "milk", [1.0], "then"), ("q", "okra", None, "then")], P))
    tx.save_aliases(spark.createDataFrame([(" shop ", " MILK ", "p"), (None, "X", "q")], A))
    tx.commit()
    tx = store.begin()
    tx.save_products(spark.createDataFrame([("p", "whole milk", None, "now")], P))
    tx.save_aliases(spark.createDataFrame([("SHOP", "MILK", "q")], A))
    tx.update_lines(spark.createDataFrame([(12, "q"), (77, "p")], "line_item_id long, product_id string"))
    tx.set_owners(spark.createDataFrame([(2, 7)], "receipt_id long, shopper_id long"))
    tx.append("line_items", lines(spark, (22, 2, 2, "tea", "p")))
    tx.commit()
    now = store.snapshot()
    assert sorted((r["product_id"], r["canonical_text"], r["embedding"], r["created_at"]) for r in now.table("products").collect()) == [("p", "whole milk", [1.0], "then"), ("q", "okra", None, "then")]
    assert sorted((r["store"], r["raw_description"], r["product_id"]) for r in now.table("product_aliases").collect()) == [("SHOP", "MILK", "q"), ("UNKNOWN", "X", "q")]
    assert {r["line_item_id"]: r["product_id"] for r in now.table("line_items").collect()} == {11: None, 12: "q", 21: None, 22: "p"}
    assert {r["receipt_id"]: r["shopper_id"] for r in now.table("receipts").collect()} == {1: 7, 2: 7}


def test_broken_references_are_refused_by_name(spark, store):
    first(store, spark)
    was = seen(store.snapshot())
    tx = store.begin()
    tx.save_receipts(receipts(spark, (3, "c.jpg", 3, 8)))
    with pytest.raises(BrokenReference, match=r"receipts.shopper_id: no such row for 8"):
        tx.commit()
    tx = store.begin()
    with pytest.raises(BrokenReference, match=r"line_items.receipt_id: no such row for 5"):
        tx.save_receipts(receipts(spark, (3, "c.jpg", 3, None)), lines(spark, (1, 5, 1, "x", None)))
    tx = store.begin()
    tx.save_receipts(receipts(spark, (3, "c.jpg", 3, None)), lines(spark, (1, 3, 1, "x", "ghost")))
    with pytest.raises(BrokenReference, match=r"line_items.product_id: no such row for 'ghost'"):
        tx.commit()
    tx.save_products(spark.createDataFrame([("ghost", "boo")], "product_id string, canonical_text string"))  # in the same transaction it will do
    tx.commit()
    assert len(seen(store.snapshot())[0]) == len(was[0]) + 1


def test_no_key_goes_to_the_driver(spark, store, monkeypatch):
    plans, rewrite, collect = [], Transaction._rewrite, type(spark.range(0)).collect

    def noted(self, name, touched, rows):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return rewrite(self, name, touched, rows)

    def gathered(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return collect(df)

    monkeypatch.setattr(Transaction, "_rewrite", noted)
    monkeypatch.setattr(type(spark.range(0)), "collect", gathered)
    first(store, spark)
    tx = store.begin()
    tx.save_products(spark.createDataFrame([("p", "milk")], "product_id string, canonical_text string"))
    tx.save_receipts(receipts(spark, (9, "a.jpg", 900, None)), lines(spark, (91, 9, 1, "new", "p")))
    tx.update_lines(spark.createDataFrame([(91, "p")], "line_item_id long, product_id string"))
    tx.set_owners(spark.createDataFrame([(2, 7)], "receipt_id long, shopper_id long"))
    tx.delete_receipts(spark.createDataFrame([(2,)], "receipt_id long"))
    tx.commit()
    assert sum("SortMergeJoin" in p for p in plans) >= 10
    assert not any("Broadcast" in p for p in plans)
    assert seen(store.snapshot()) == ([("a.jpg", 9, 900, 7)], [(9, 1, "new")])


def write(folder, name, total, items):
    os.makedirs(folder, exist_ok=True)
    rows = [{"line_number": k + 1, "raw_description": d, "line_total": 1.0} for k, d in enumerate(items)]
    with open(f"{folder}/{name}_extracted.json", "w") as f:
        json.dump({"merchant_name": "m", "total": total, "line_items": rows}, f)


def test_a_file_that_comes_again_stands_once(spark, store, tmp_path):
    inbox, check = f"{tmp_path}/in", f"{tmp_path}/check"
    run = lambda: streaming.ingest(spark, inbox, store, check, files_per_batch=2).awaitTermination()
    for k in range(3):
        write(f"{inbox}/1", f"r{k}", 10.0 + k, ["a", "b"])
    run()
    tx = store.begin()
    tx.put("shoppers", spark.createDataFrame([(7, "ann")], "shopper_id long, name_key string"))
    tx.set_owners(store.snapshot().table("receipts").filter("source_file = 'r1.jpg'").select("receipt_id", F.lit(7).cast("long").alias("shopper_id")))
    tx.commit()
    write(f"{inbox}/2", "r1", 99.0, ["c"])
    write(f"{inbox}/2", "r9", 1.0, ["z"])
    run()
    now = store.snapshot()
    got = {r["source_file"]: (r["total_cents"], r["shopper_id"], r["receipt_id"]) for r in now.table("receipts").collect()}
    assert {k: v[:2] for k, v in got.items()} == {"r0.jpg": (1000, None), "r1.jpg": (9900, 7), "r2.jpg": (1200, None), "r9.jpg": (100, None)}
    texts = lambda f: sorted(r["raw_description"] for r in now.table("line_items").filter(F.col("receipt_id") == got[f][2]).collect())
    assert texts("r1.jpg") == ["c"] and texts("r0.jpg") == ["a", "b"] and now.table("line_items").count() == 6
    assert now.table("validation_results").filter(F.col("receipt_id") == got["r1.jpg"][2]).select("check_name").distinct().count() >= 5
    version = now.version
    run()  # nothing new
    assert store.snapshot().version == version


def test_a_batch_that_runs_again_changes_nothing(spark, store):
    rows = [("m", 5.0, [(1, "a", 1.0)], "x.jpg", 1)]
    from tillmark.sources.schemas import RECEIPT

    bare = spark.createDataFrame([{"merchant_name": m, "total": t, "line_items": [{"line_number": n, "raw_description": d, "line_total": v, "is_voided": False} for n, d, v in li]} for m, t, li, _, _ in rows], RECEIPT)
    batch = bare.withColumns({"source_file": F.lit("x.jpg"), "receipt_id": F.lit(1).cast("long")})
    assert streaming.save_batch(store, batch, 0) == 1
    assert streaming.save_batch(store, batch, 0) is None
    assert streaming.save_batch(store, batch.withColumn("total", F.lit(6.0)), 1) == 2
    assert [r["total_cents"] for r in store.snapshot().table("receipts").collect()] == [600]
    assert store.snapshot().batches == {"receipts": 1} and store.snapshot().table("line_items").count() == 1
