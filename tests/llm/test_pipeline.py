"""The pipeline over planted cases, odd rows and empty tables."""

import random

import pytest

import corpus_pipeline
from tests.llm import cases
from tillmark.llm import simhash_gray


def store(spark, path, documents, labels, benchmark):
    cases.documents(spark, documents).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def through(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, out = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf)
        if k < 4:
            assert docs.columns == columns
        docs.write.parquet(f"{sf}/stage-{k}")
        docs = spark.read.parquet(f"{sf}/stage-{k}")
        out[name] = docs.collect()
    return out


def test_planted_cases(spark, tmp_path):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(900)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows, labels = [], []
    for k in range(300):
        toxic = k % 6 == 0
        t = text(rng.randint(40, 200))
        if toxic:
            w = t.split()
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["zqidiot", "zqm0ron", "zqscum"]))
            t = " ".join(w)
        rows.append((k, t, "en", "s", len(t)))
        labels.append((k, 1, int(toxic)))
    base, passage, item = text(150), text(60), text(30)
    near = base.split()
    near[70] = "changed"
    extra = {1000: base, 1001: base, 1002: " ".join(near), 1003: text(30) + " " + passage, 1004: text(30) + " " + passage + " end", 1005: text(20) + " " + item + " tail words", 1006: text(80)}
    rows += [(k, t, "en", "s", len(t)) for k, t in extra.items()]
    sf = store(spark, tmp_path, rows, labels, [(1, item)])
    got = through(spark, sf)
    kept = {r["doc_id"] for r in got["toxicity"]}
    toxic = {k for k, _, t in labels if t}
    assert len(toxic & kept) <= 2 and len({k for k, _, t in labels if not t} - kept) <= 2
    left = {r["doc_id"]: r["text"] for r in got["simhash_near_dedup"]}
    assert 1000 in left and not {1001, 1002} & left.keys() and {1003, 1004, 1005, 1006} <= left.keys() and len(kept - left.keys()) <= 4
    cut = {r["doc_id"]: r["text"] for r in got["suffix_array_dedup"]}
    assert passage in cut[1003] and passage not in cut[1004] and cut[1004].endswith(" end") and cut[1006] == extra[1006] and cut.keys() == left.keys()
    clean = {r["doc_id"]: r["text"] for r in got["benchmark_decontamination"]}
    assert item not in clean[1005] and clean[1005].endswith(" tail words") and clean[1006] == extra[1006] and clean.keys() == left.keys()
    tokens = {}
    for r in got["best_fit_packing"]:
        tokens[r["doc_id"]] = tokens.get(r["doc_id"], 0) + r["n_tokens"]
    assert tokens == {k: len(t.encode()) + 1 for k, t in clean.items()}


def test_odd_rows_and_empty_tables(spark, tmp_path):
    got = through(spark, store(spark, tmp_path / "odd", cases.odd_rows(), [(6, 1, 1), (3, None, 0), (None, 1, 1), (4, 1, None)], [(1, None), (None, "a"), (2, cases.PASSAGE)]))
    assert got["best_fit_packing"] and all(r["bin"] is not None for r in got["best_fit_packing"])
    assert not any(through(spark, store(spark, tmp_path / "empty", [], [], [])).values())


def test_run_is_the_stages(spark, tmp_path):
    sf = store(spark, tmp_path, cases.corpus(60), [(k, 1, 0) for k in range(60)], [(1, cases.PASSAGE)])
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == sorted(map(tuple, through(spark, sf)["best_fit_packing"]))


@pytest.mark.parametrize("twice", [False, True])
def test_clashing_names_are_kept_by_the_near_copy_stage(spark, twice):
    rows = cases.corpus(30)
    if twice:
        rows = [*rows, (3, "another text with the id of the third one", "en", "s", 40)]
    df = cases.with_clashes(cases.documents(spark, rows))
    got = simhash_gray.keep_one(df)
    assert got.columns == df.columns
    plain = simhash_gray.keep_one(cases.documents(spark, rows))
    assert sorted((r["doc_id"], r["text"]) for r in got.collect()) == sorted((r["doc_id"], r["text"]) for r in plain.collect())
    assert {r["kept_id"] for r in got.collect()} == {r["tillmark_digest"] for r in got.collect()} == {"theirs"}
