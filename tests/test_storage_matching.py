"""Replace, upsert, cascade, resolution, providers, ingest."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillmark.functions import scalars as sc
from tillmark.operators import images, matching, providers, storage
from tillmark.sources import readers, schemas
from tillmark.sources.store import Store
from tillmark.streaming import ingest


def test_reingest_replaces_and_keeps_owner(spark):
    old = spark.createDataFrame([(1, "a.jpg", 7, 5), (2, "b.jpg", 8, 5)], "receipt_id long, source_file string, shopper_id long, total_cents long")
    new = spark.createDataFrame([(3, "a.jpg", None, 6)], old.schema)
    lines = spark.createDataFrame([(1, "x"), (2, "y")], "receipt_id long, raw_description string")
    r, li = storage.save_receipts(old, new, lines)
    assert sorted(map(tuple, r.select("receipt_id", "source_file", "shopper_id", "total_cents").collect())) == [(2, "b.jpg", 8, 5), (3, "a.jpg", 7, 6)]
    assert [x["receipt_id"] for x in li.collect()] == [2]


def test_delete_cascades(spark):
    r = spark.createDataFrame([(1,), (2,)], "receipt_id long")
    li = spark.createDataFrame([(1, 1), (2, 2)], "receipt_id long, n int")
    left = storage.delete_receipts(spark.createDataFrame([(1,)], "receipt_id long"), r, li)
    assert [[x["receipt_id"] for x in t.collect()] for t in left] == [[2], [2]]


def test_product_upsert_keeps_time_and_vector(spark):
    cols = "product_id string, canonical_text string, embedding array<float>, created_at string"
    old = spark.createDataFrame([("p", "old", [1.0, 0.0], "t0")], cols)
    new = spark.createDataFrame([("p", "new", None, "t1"), ("q", "other", None, "t1")], cols)
    got = {x["product_id"]: x for x in storage.save_products(old, new).collect()}
    assert (got["p"]["canonical_text"], got["p"]["created_at"], got["p"]["embedding"]) == ("new", "t0", [1.0, 0.0]) and got["q"]["created_at"] == "t1"
    assert storage.save_products(old, new, keep_embedding=False).filter("product_id = 'p'").head()["embedding"] is None


def test_alias_upsert_and_line_update(spark):
    cols = "store string, raw_description string, product_id string, needs_review int"
    old = spark.createDataFrame([("SHOP", "MILK", "p", 1)], cols)
    new = spark.createDataFrame([(" shop ", " MILK ", "q", 0), (None, "EGGS", "e", 0)], cols)
    assert sorted((x["store"], x["raw_description"], x["product_id"]) for x in storage.save_aliases(old, new).collect()) == [("SHOP", "MILK", "q"), ("UNKNOWN", "EGGS", "e")]
    lines = spark.createDataFrame([(1, "a", None), (2, "b", "x")], "line_item_id long, raw_description string, product_id string")
    got = storage.update_lines(lines, spark.createDataFrame([(1, "p")], "line_item_id long, product_id string")).collect()
    assert sorted(tuple(x) for x in got) == [(1, "a", "p"), (2, "b", "x")]


def test_migration(spark):
    old = spark.createDataFrame([(1, "OLD.jpg", "Shop", 4377)], "receipt_id long, source_file string, merchant_name string, total_cents long")
    new = schemas.migrate(old, "receipts", 1)
    assert new.columns == schemas.TABLES["receipts"].names and new.head()["shopper_id"] is None and new.head()["total_cents"] == 4377
    with pytest.raises(ValueError):
        schemas.migrate(old, "receipts", 9)


@pytest.mark.parametrize(
    "raw, key",
    [("Dairy Products", "dairy"), ("health & beauty", "personal_care"), ("Pet/Supplies", "pet_supplies"), ("--", None), (None, None), ("Electronics", "electronics"), (" Fruit ", "produce")],
)
def test_categories(spark, raw, key):
    assert spark.createDataFrame([(raw,)], "x string").select(sc.normalize_category(F.col("x"))).head()[0] == key


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c).head()[0]
    assert one(sc.to_cents(F.lit(0.125))) == 12 and one(sc.to_cents(F.lit(0.135))) == round(13.5)
    assert [one(sc.format_cents(F.lit(x))) for x in (1205, 5, -305, 0)] == ["12.05", "0.05", "-3.05", "0.00"] and one(sc.format_cents(F.lit(None).cast("bigint"))) == "--"
    assert one(sc.alias_key(F.lit(" walmart "), F.lit(" EGGS "))) == "WALMART||EGGS" and one(sc.alias_key(F.lit(""), F.lit("X"))) == "UNKNOWN||X"
    assert one(sc.retry_after(F.lit("please retry in 12.5s"))) == 12.5 and one(sc.valid_pin(F.lit("1234"))) and not one(sc.valid_pin(F.lit("12a4")))


def test_attribute_verdicts(spark):
    rows = [("A", "a", None, None, "guava", "Guava ", "same"), ("A", "B", None, None, "x", "x", "different"), (None, "B", "red", "blue", "x", "x", "different"), (None, None, None, None, "x", "y", "unsure"), ("", None, " ", None, "", "", "unsure")]
    df = spark.createDataFrame([r[:6] for r in rows], "ab string, bb string, av string, bv string, ap string, bp string")
    v = matching.compare_attributes({"brand": F.col("ab"), "variant": F.col("av"), "product": F.col("ap")}, {"brand": F.col("bb"), "variant": F.col("bv"), "product": F.col("bp")})
    assert [x[0] for x in df.select(v).collect()] == [r[6] for r in rows]


def test_resolve(spark):
    cat = spark.createDataFrame([("p1", "Acme", "milk", None, ["SHOP||MLK"]), ("p2", None, "oat milk", None, [])], "product_id string, brand string, product string, variant string, aliases array<string>")
    rows = [("k1", "shop", "MLK", None, None, None, True), ("k2", "shop", "??", None, None, None, False), ("k3", "x", "MILK", "acme", "Milk", None, False), ("k4", "x", "OTM", None, "oat drink", None, False), ("k5", "x", "SOAP", None, "soap", None, False)]
    parsed = spark.createDataFrame(rows, "key string, store string, raw_description string, brand string, product string, variant string, needs_review boolean")
    near = spark.createDataFrame([("k3", "p2", 1), ("k3", "p1", 2), ("k4", "p2", 1)], "query_id string, product_id string, rank int")
    got = {x["key"]: (x["outcome"], x["product_id"]) for x in matching.resolve(parsed, cat, near).collect()}
    assert got["k1"] == ("matched", "p1") and got["k2"] == ("review", None) and got["k3"] == ("matched", "p1") and got["k4"] == ("review", "p2")
    assert got["k5"][0] == "created" and len(got["k5"][1]) == 8
    yes = providers.adjudicator(lambda a, b: "same")
    assert {x["key"]: x["outcome"] for x in matching.resolve(parsed, cat, near, yes).collect()}["k4"] == "matched"
    more = matching.add_aliases(cat, matching.resolve(parsed, cat, near))
    assert {x["product_id"]: x["aliases"] for x in more.collect()}["p1"] == ["SHOP||MLK", "X||MILK"]


def test_siblings(spark):
    li = spark.createDataFrame([(1, 1, "A", 0), (1, 2, "B", 0), (1, 3, "C", 1)], "receipt_id long, line_number int, raw_description string, is_voided int")
    assert {x["raw_description"]: x["siblings"] for x in matching.siblings(li).collect()} == {"A": ["B"], "B": ["A"]}


def test_parse_retries_with_context_and_cache(spark):
    def provider(text, store=None, others=None):
        return {"product": "milk" if store else None, "size_unit": "Fl Oz", "size_value": 8.0, "category": "Dairy Products"} if text == "MLK" else {"product": text.lower(), "size_unit": "parsec", "size_value": 3.0}

    items = spark.createDataFrame([("S", "MLK", ["EGGS"]), ("S", "EGGS", []), ("S", "MLK", ["EGGS"])], "store string, raw_description string, siblings array<string>")
    cache = spark.createDataFrame([("S", "EGGS", {"product": "cached", "parser_version": 2}), ("S", "MLK", {"product": "stale", "parser_version": 1})], f"store string, raw_description string, parsed {schemas.PARSED.simpleString()}")
    got, whole = providers.parse_through_cache(items, cache, provider)
    by = {x["raw_description"]: x["parsed"] for x in got.collect()}
    assert by["EGGS"]["product"] == "cached" and by["MLK"]["product"] == "milk" and by["MLK"]["attempts"] == 2 and by["MLK"]["size_unit"] == "fl_oz" and by["MLK"]["category"] == "dairy"
    assert whole.count() == 2


def test_retry_policy():
    waits, calls = [], []

    def fails(*_):
        calls.append(1)
        raise providers.Retryable("busy", after=90 if len(calls) > 1 else None)

    with pytest.raises(providers.Retryable):
        providers.with_retry(fails, sleep=waits.append)
    assert len(calls) == 3 and waits == [2.0, 75.0]
    with pytest.raises(providers.QuotaSpent):
        providers.with_retry(lambda: (_ for _ in ()).throw(providers.QuotaSpent("day")), sleep=waits.append)


def test_embedding_is_unit_length(spark):
    df = providers.embed(spark.createDataFrame([("a",), (None,)], "t string"), "t", lambda texts: [[3.0, 4.0] for _ in texts])
    assert [[round(v, 6) for v in x["embedding"]] for x in df.collect()] == [[0.6, 0.8]] * 2


RECEIPT = {"merchant_name": "Shop", "purchase_date": "2026-01-01", "subtotal": 3.0, "total": 3.0, "currency": None, "line_items": [{"line_number": 1, "raw_description": "MILK", "line_total": 3.0, "quantity": 1.0, "unit_price": 3.0, "tax_flag": "N", "is_voided": False}, {"line_number": 2, "raw_description": "X", "is_voided": True}]}


def test_read_receipts(spark, tmp_path):
    (tmp_path / "r1_extracted.json").write_text(json.dumps(RECEIPT))
    (r,) = readers.read_receipts(spark, str(tmp_path)).collect()
    assert r["source_file"] == "r1.jpg" and r["currency"] == "USD" and r["line_items"][1]["line_total"] is None
    for bad in ({**RECEIPT, "line_items": [{"line_number": 1}]}, {k: v for k, v in RECEIPT.items() if k != "line_items"}):
        (tmp_path / "r1_extracted.json").write_text(json.dumps(bad))
        with pytest.raises(Exception, match="without"):
            readers.read_receipts(spark, str(tmp_path)).collect()


def test_incremental_ingest_takes_each_file_once(spark, tmp_path):
    inbox, store = tmp_path / "in", Store(spark, f"file://{tmp_path}/out", buckets=4)
    inbox.mkdir()
    for k in range(2):
        (inbox / f"r{k}_extracted.json").write_text(json.dumps(RECEIPT))
        ingest.ingest(spark, str(inbox), store, str(tmp_path / "ck")).awaitTermination()
    read = store.snapshot().table
    assert read("receipts").count() == 2 and read("line_items").count() == 4
    assert read("validation_results").groupBy("status").count().count() == 2 and read("receipts").select("total_cents").distinct().head()[0] == 300


def test_capture_rules(spark, tmp_path):
    png = bytes([137, 80, 78, 71, 13, 10, 26, 10]) + b"\0\0\0\rIHDR"
    files = {"a.png": png + (700).to_bytes(4, "big") + (800).to_bytes(4, "big") + b"x" * 2000, "b.png": png + (200).to_bytes(4, "big") + (900).to_bytes(4, "big") + b"x" * 2000, "c.txt": b"x" * 2000, "e.jpg": b"garbage" * 300, "f.jpg": b"\xff\xd8\xff"}
    for k, v in files.items():
        (tmp_path / k).write_bytes(v)
    got = {x["path"].rsplit("/", 1)[1]: x["rejected"] for x in readers.capture(spark, str(tmp_path)).collect()}
    assert got == {"a.png": None, "b.png": "image too small", "c.txt": "unsupported type", "e.jpg": "not an image", "f.jpg": "file too small"}


def test_caches_catalog_vocabulary(spark, tmp_path):
    (tmp_path / "cache.json").write_text(json.dumps({"SHOP||MILK": {"product": "milk"}}))
    (x,) = readers.read_parse_cache(spark, str(tmp_path / "cache.json")).collect()
    assert (x["store"], x["raw_description"], x["parsed"]["product"]) == ("SHOP", "MILK", "milk")
    (tmp_path / "cat.json").write_text(json.dumps([{"product_id": "p", "aliases": ["A"], "embedding": [1.0]}]))
    assert readers.read_catalog(spark, str(tmp_path / "cat.json")).head()["aliases"] == ["A"]
    (tmp_path / "voc.json").write_text(json.dumps(["toys", "dairy"]))
    assert readers.read_vocabulary(spark, str(tmp_path / "voc.json")).count() == 14


def test_pixels():
    c = np.array([[90, 10], [10, 12], [12, 95], [95, 90]], np.float32)
    assert images.order_corners(c).tolist() == [[10, 12], [90, 10], [95, 90], [12, 95]]
    square = np.arange(100 * 100, dtype=np.int64).reshape(100, 100).astype(np.uint8)
    box = np.array([[10, 10], [60, 10], [60, 40], [10, 40]], np.float32)
    assert images.output_size(box) == (50, 30) and images.warp(square, box).shape == (30, 50)
    flat = np.full((64, 64), 100, np.uint8)
    flat[:, 32:] = 110
    out = images.local_contrast(flat)
    assert out.shape == flat.shape and int(out[:, 40].mean()) > int(out[:, 10].mean())


def test_blobs_quota_tallies_and_orders(spark, tmp_path):
    from tillmark.operators import pages

    v = spark.createDataFrame([([1.5, -2.0],), (None,)], "v array<float>")
    assert [r[0] for r in v.select(sc.blob_to_vector(sc.vector_to_blob("v"))).collect()] == [[1.5, -2.0], None]
    assert [r[0] for r in spark.createDataFrame([("429 GenerateRequestsPerDayPerProjectPerModel",), ("busy",), (None,)], "m string").select(sc.is_daily_quota(F.col("m"))).collect()] == [True, False, False]
    items = spark.createDataFrame([("S", "A"), ("S", "B"), ("S", "A")], "store string, raw_description string")
    cols = f"store string, raw_description string, parsed {schemas.PARSED.simpleString()}"
    before = spark.createDataFrame([("S", "A", {"product": "a"})], cols)
    after = spark.createDataFrame([("S", "A", {"product": "a"}), ("S", "B", {"attempts": 2})], cols)
    assert tuple(pages.parse_tallies(items, before, after).head()) == (2, 1, 1, 1, 1)
    h = spark.createDataFrame([("b", 2), ("a", 2), ("c", 5)], "name string, times_bought int")
    assert [r["name"] for r in pages.in_order(h, "histories", 2).collect()] == ["c", "a"]
    readers.write_vocabulary(readers.read_vocabulary(spark), str(tmp_path / "v"))
    assert readers.read_vocabulary(spark, str(tmp_path / "v")).count() == 13


def test_created_products_join_the_catalog(spark):
    cat = spark.createDataFrame([], "product_id string, brand string, product string, variant string, embedding array<float>, aliases array<string>")
    rows = [("k1", "s", "SOAP A", None, "soap", None, False, [0.1234567]), ("k2", "s", "SOAP B", None, "Soap", None, False, [0.5])]
    parsed = spark.createDataFrame(rows, "key string, store string, raw_description string, brand string, product string, variant string, needs_review boolean, embedding array<float>")
    near = spark.createDataFrame([], "query_id string, product_id string, rank int")
    d = matching.resolve(parsed, cat, near)
    (p,) = matching.add_created(cat, d, parsed).collect()
    assert p["aliases"] == ["S||SOAP A", "S||SOAP B"] and p["product"] == "soap" and round(p["embedding"][0], 6) == 0.12346
    assert matching.outcome_counts(d).head()["n"] == 2


def test_receipt_state(spark):
    from tillmark.operators import pages

    c = spark.createDataFrame([(1, "pass"), (1, "uncheckable"), (1, "fail")], "receipt_id long, status string")
    li = spark.createDataFrame([(1, 0, None), (1, 1, None), (2, 0, "p")], "receipt_id long, is_voided int, product_id string")
    assert sorted(map(tuple, pages.receipt_state(c, li).collect())) == [(1, 1, 2, 1), (2, 0, 0, 0)]


def test_page_is_found_and_straightened(spark):
    y, x = np.mgrid[0:300, 0:400]
    page = (np.abs((x - 200) * 0.9553 + (y - 150) * 0.2955) < 110) & (np.abs(-(x - 200) * 0.2955 + (y - 150) * 0.9553) < 80)
    photo = np.where(page, 230, 20).astype(np.uint8)
    corners = images.find_corners(photo)
    turn = np.array([[0.9553, -0.2955], [0.2955, 0.9553]])
    true = np.array([[200, 150]]) + np.array([[-110, -80], [110, -80], [110, 80], [-110, 80]]) @ turn.T
    assert np.abs(corners - images.order_corners(true)).max() < 5
    assert images.find_corners(np.full((200, 200), 128, np.uint8)) is None
    df = spark.createDataFrame([("a", 300, 400, 3, np.repeat(photo[..., None], 3, 2).tobytes()), ("b", 20, 20, 3, bytes(1200))], "path string, height int, width int, n_channels int, data binary")
    got = {r["path"]: r for r in images.preprocess(df).collect()}
    assert got["a"]["deskewed"] and abs(got["a"]["width"] - 220) < 8 and abs(got["a"]["height"] - 160) < 8 and not got["b"]["deskewed"] and got["b"]["width"] == 20
