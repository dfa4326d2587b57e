"""Manifest, token counts and rearranged texts against plain versions, on odd rows and on random ones."""

import random
import re
import zlib
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import cases
from tillmark.llm import fill_in_middle, merkle, pretokens, queries, token_counts

public_tokenizers = pytest.importorskip("public_tokenizers")
BPE = public_tokenizers.path("byte_bpe_50k.json")


def show(rows):
    return sorted(tuple(str(v) for v in r) for r in rows)


# The manifest


def hexed(text):
    return sha256(text.encode()).hexdigest()


def plain_manifest(rows, fanout=3):
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of ``(doc_id, text, lang, source, n_chars)``, level by level."""
    told = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    groups = {}
    for d, text, lang, source, n in rows:
        leaf = hexed("".join(map(told, (d, source, lang, n, text))))
        seen = leaf
        if d is not None and zlib.crc32(str(d).encode()) % 2 == 0 and text is not None:
            seen = hexed("".join(map(told, (d, source, lang, n, text.replace("\n", "")))))
        groups.setdefault(source, []).append(((d is not None, d or 0, leaf), d, leaf, seen))

    def tree(level):
        out = [level]
        while len(out[-1]) > 1:
            out.append([hexed("".join(out[-1][k : k + fanout])) for k in range(0, len(out[-1]), fanout)])
        return out

    def path(levels, i):
        for level in levels[:-1]:
            b = i // fanout * fanout
            run = level[b : b + fanout]
            yield run[: i - b], run[i - b + 1 :]
            i //= fanout

    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x[2] for x in sorted(groups[g])]) for g in order}
    top = tree([trees[g][-1][0] for g in order]) if order else []
    out = []
    for j, g in enumerate(order):
        for i, (_, d, leaf, seen) in enumerate(sorted(groups[g])):
            siblings, h = [*path(trees[g], i), *path(top, j)], seen
            for left, right in siblings:
                h = hexed("".join([*left, h, *right]))
            out.append((d, leaf, trees[g][-1][0], top[-1][0], hexed("".join("".join(a + b) for a, b in siblings)), h, h == top[-1][0]))
    return out


def manifest(df, **how):
    cut = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    proofs, nodes, roots = merkle.manifest(df, tampered=("text", cut), **how)
    return merkle.audited(proofs).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"), nodes, roots


@pytest.mark.parametrize(("n", "step", "parts"), [(400, 2, 7), (3**6, 2, 3), (3**6 + 1, 3, 5), (1, 8, None), (0, 8, None)])
def test_manifest(spark, n, step, parts):
    rng = random.Random(n)
    rows = [(k, rng.choice([None, "", "x\ny", "z\n\n", "é" * 5]), rng.choice([None, "en"]), "hot" if rng.random() < 0.7 else rng.choice([None, "", "a", "é"]), rng.choice([None, 4])) for k in range(n)]
    got, nodes, roots = manifest(cases.documents(spark, rows), step=step, parts=parts)
    assert show(got.collect()) == show(plain_manifest(rows))
    sizes = {r["grp"]: r["n"] for r in roots.collect()}
    assert sum(sizes.values()) == n
    want = {}
    for g, size in sizes.items():
        level = 0
        while size > 1:
            level, size = level + 1, -(-size // 3)
            want[g, level] = size
    assert {(r["grp"], r["level"]): r["count"] for r in nodes.groupBy("grp", "level").count().collect()} == want  # each node once


def test_manifest_of_odd_rows(spark):
    got, _, _ = manifest(cases.with_clashes(cases.documents(spark)).withColumn("grp", F.lit("theirs")).withColumn("h", F.lit("theirs")), step=2, parts=4)
    assert show(got.collect()) == show(plain_manifest(cases.odd_rows()))


def test_a_run_anywhere_gives_the_same_nodes():
    leaves = [bytes([k]) * 32 for k in range(100)]
    whole = merkle.Mountains()
    for k, h in enumerate(leaves):
        whole.push(0, k, h)
    whole.finish(100, 8)
    for a, b in [(0, 37), (5, 94), (26, 28), (80, 100)]:
        part = merkle.Mountains()
        for k in range(a, b):
            part.push(0, k, leaves[k])
        part.close()
        assert set(part.nodes) <= set(whole.nodes)
        assert sum(3**level for level, _, _ in part.open) == b - a  # the open nodes cover the run
        assert len(part.open) <= 4 * 5


# Token counts


def library(texts):
    from tokenizers import Tokenizer

    return [len(e.ids) for e in Tokenizer.from_file(BPE).encode_batch(texts, add_special_tokens=False)]


HARD = ["it's we're I'll don't 's' ''s 'sabc 'ſ", "a  b\n\n c\t d \n", "<|endoftext|> x<|endoftext|>", " 　x  ", "naïve 中文 ٣٤ 𝒳𝒴 é", "\U0001fadf ՘ new", "x" * 300, "\x00\x01 \x1c\x1d", "'", "' s", " 's", "l'll've", "12.5%--==  ", " "]


def test_pretokens_are_the_librarys():
    from tokenizers import Tokenizer

    split, table, rng = Tokenizer.from_file(BPE).pre_tokenizer.pre_tokenize_str, pretokens.class_table(), random.Random(3)
    alphabet = ["a", "s", "t", "l", "L", "'", "'", "re", "ve", "ll", " ", " ", "\n", "\t", "　", "é", "1", "٣", ".", "-", "\0", "𝒳", "中", "́"]
    for _ in range(3000):
        texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14))) for _ in range(4)]
        data, start, n = pretokens.split(texts, table)
        ends = [*start.tolist()[1:], len(data)]
        want = [[t[a:b].encode() for _, (a, b) in split(t)] if t else [] for t in texts]
        assert [data[a:b] for a, b in zip(start.tolist(), ends, strict=True)] == sum(want, []) and n.tolist() == [len(w) for w in want]


def test_classes_of_all_known_code_points():
    from tokenizers import Tokenizer

    split, table = Tokenizer.from_file(BPE).pre_tokenizer.pre_tokenize_str, pretokens.class_table()
    known = np.flatnonzero(table != pretokens.UNKNOWN).tolist()
    assert len(known) > 280_000
    for k in range(0, len(known), 4000):
        text = "".join(f"a{chr(c)}a 1{chr(c)}1 .{chr(c)}.  {chr(c)}  " for c in known[k : k + 4000])
        ch = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        assert pretokens.starts(ch, table[ch], np.array([0])).tolist() == [a for _, (a, _) in split(text)]


@pytest.mark.parametrize("most", [0, 3, 32_768])
def test_token_counts(spark, most):
    rows = [*cases.odd_rows(), *[(100 + k, t, None, None, None) for k, t in enumerate(HARD)], *[(200 + r[0], *r[1:]) for r in cases.corpus(40)]]
    got = token_counts.count_tokens(cases.with_clashes(cases.documents(spark, rows)).repartition(5), BPE, limit=50, most=most)
    counts = library([r[1] or "" for r in rows])
    assert show(got.collect()) == show((r[0], len((r[1] or "").encode()), n, n > 50) for r, n in zip(rows, counts, strict=True))
    assert token_counts.count_tokens(cases.documents(spark, []), BPE).collect() == []


def test_pieces_of_long_texts():
    rng = random.Random(7)
    text = "".join(rng.choice(["word", "it's", " ", "  \n", "<|endoftext|>", "é", ". ", "7"]) for _ in range(20_000))
    cut = list(token_counts.pieces(text, 500))
    assert "".join(cut) == text and len(cut) > 50
    assert sum(library(cut)) == library([text])[0]
    assert list(token_counts.pieces("x" * 2000, 500)) == ["x" * 2000]


def test_frequent_pretokens_within_the_bound(spark):
    rows = [(k, " common" * 30 + f" rare{k} other{k * 7}", None, None, None) for k in range(300)]
    exact = dict(token_counts.frequent(cases.documents(spark, rows).repartition(40)))
    assert exact[b" common"] == 9000 and exact[b" rare"] == 300
    few = token_counts.frequent(cases.documents(spark, rows).repartition(40), most=4)
    assert 0 < len(few) <= 4 and few[0][0] == b" common" and few[0][1] <= 9000


def test_other_tokenizers_are_refused(spark):
    with pytest.raises(ValueError, match="byte-level"):
        token_counts.count_tokens(cases.documents(spark), public_tokenizers.path("word_bpe_49k.json"))


# Fill in the middle


def plain_fim(d, text, fim=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    dig = sha256(f"7:{'' if d is None else d}".encode()).hexdigest()
    h = [int(dig[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= fim:
        return d, len(units), "plain", None, None, text, text
    if h[3] % 100 < spm:
        return d, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", text
    return d, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", text


@pytest.mark.parametrize(("fim", "spm"), [(100, 50), (40, 0), (70, 100), (0, 50)])
def test_fill_in_middle(spark, fim, spm):
    rng = random.Random(5)
    made = ["".join(rng.choice(["a", "é𝒳", "\n", "\n", "<", "<P", "P>", "<M", "S>", "\r", " "]) for _ in range(rng.randint(0, 30))) for _ in range(150)]
    rows = [*cases.odd_rows(), *[(100 + k, t, None, None, None) for k, t in enumerate([*made, "x<M>y\nz", "\n", "\n\n\n", "a\n<P>"])]]
    out = fill_in_middle.rearrange(cases.with_clashes(cases.documents(spark, rows)).withColumn("units", F.lit("theirs")), fim_percent=fim, spm_percent=spm)
    got = out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", fill_in_middle.restored(F.col("output"), F.col("form"))).collect()
    assert show(got) == show(plain_fim(r[0], r[1], fim, spm) for r in rows)
    assert fill_in_middle.rearrange(cases.documents(spark, [])).collect() == []


def test_queries_are_registered():
    assert {"op11_merkle_manifest", "op12_token_counts", "op13_fill_in_middle"} <= set(queries.queries())
    assert {"op11_merkle_manifest", "op13_fill_in_middle"} <= set(queries.oracle_sql())
