"""Members of JSON files by lines, against Python's own reader; splits that cut members; other layouts."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tillmark.sources import readers
from tillmark.sources.members import members


def values(spark, path):
    return sorted((json.dumps(json.loads(r["member"]), sort_keys=True) for r in members(spark, str(path)).collect()))


def made(seed, n):
    rng = random.Random(seed)
    words = ['a"b', "{", "}", "[", "],", "\\", 'x\\"', "é\n", ",", ": 1,", "plain", ""]
    leaf = lambda: rng.choice([None, True, 1.5, -3, rng.choice(words), "".join(rng.choice(words) for _ in range(9)), [], {}, [1, {"k": "]"}], {"in": {"deep": ["}"]}}])
    return {f"{k}{rng.choice(words)}": {rng.choice(words) + str(j): leaf() for j in range(rng.randint(0, 5))} if rng.random() < 0.7 else leaf() for k in range(n)}


@pytest.mark.parametrize("indent", [2, 0, 1, None, "\t"])
def test_objects_and_lists_of_any_layout(spark, tmp_path, indent):
    data = made(3, 60)
    (tmp_path / "o.json").write_text(json.dumps(data, indent=indent))
    assert values(spark, tmp_path / "o.json") == sorted(json.dumps({k: v}, sort_keys=True) for k, v in data.items())
    (tmp_path / "l.json").write_text(json.dumps(list(data.values()), indent=indent))
    assert values(spark, tmp_path / "l.json") == sorted(json.dumps(v, sort_keys=True) for v in data.values())


@pytest.mark.parametrize("text", ["{}", "[]", "{\n}", "", "[\n\n]"])
def test_no_members(spark, tmp_path, text):
    (tmp_path / "x.json").write_text(text)
    assert members(spark, str(tmp_path / "x.json")).collect() == []


@pytest.mark.parametrize("text", ['{"a": {\n"x": 1}, "b": 2}', '{\n"a": 1, "b": 2\n}', '{\n"a": {\n"x": [1,\n2]\n}, "b": 2}', '{"a":\n1\n,\n"b":2}'])
def test_members_that_lines_do_not_show(spark, tmp_path, text):
    (tmp_path / "x.json").write_text(text)
    assert values(spark, tmp_path / "x.json") == sorted(json.dumps({k: v}) for k, v in json.loads(text).items())


def test_a_large_cache_is_read_by_many_tasks(spark, tmp_path):
    cache = {f"SHOP {k % 7}||ITEM {k}": {"product": f"thing {k}", "brand": None, "size_value": 1.0 * k, "needs_review": False, "parser_version": 2, "parse_note": 'a "note", {of} [it]'} for k in range(4000)}
    path = tmp_path / "cache.json"
    path.write_text(json.dumps(cache, indent=2, sort_keys=True))
    old = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for c in old:
            spark.conf.set(c, "50000")
        assert spark.read.text(str(path)).rdd.getNumPartitions() > 15
        rows = {f"{r['store']}||{r['raw_description']}": r["parsed"] for r in readers.read_parse_cache(spark, str(path)).collect()}
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    assert len(rows) == 4000 and all(rows[k]["product"] == v["product"] and rows[k]["size_value"] == v["size_value"] and rows[k]["parse_note"] == v["parse_note"] for k, v in cache.items())


def test_catalogs_by_id_and_in_lists(spark, tmp_path):
    products = [{"product_id": f"p{k}", "canonical_text": f"t{k}", "aliases": ["A||B"], "embedding": [0.5, 1.0]} for k in range(5)]
    for name, data in (("map", {p["product_id"]: p for p in products}), ("list", products)):
        for indent in (2, None):
            (tmp_path / f"{name}{indent}.json").write_text(json.dumps(data, indent=indent))
            got = readers.read_catalog(spark, str(tmp_path / f"{name}{indent}.json"))
            assert sorted((r["product_id"], r["canonical_text"], tuple(r["embedding"])) for r in got.collect()) == [(p["product_id"], p["canonical_text"], (0.5, 1.0)) for p in products]
            assert got.filter(F.size("aliases") == 1).count() == 5


@pytest.mark.parametrize("indent", [2, None])
def test_a_vocabulary_over_several_lines(spark, tmp_path, indent):
    (tmp_path / "v.json").write_text(json.dumps(["dairy", "toys", "zebras"], indent=indent))
    assert {r[0] for r in readers.read_vocabulary(spark, str(tmp_path / "v.json")).collect()} > {"toys", "zebras", "produce"}
