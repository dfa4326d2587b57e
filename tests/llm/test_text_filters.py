"""Toxicity, licences, URLs and chat: round trips, plain versions, held-out accuracy."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm import cases
from tillmark.llm import chat, licenses, toxicity
from tillmark.llm import deobfuscation as noisy
from tillmark.llm import queries as q
from tillmark.llm import url_templates as ut

ENGLISH = "the idiot said that a clown is not a worthless person but a stupid moron and a pathetic loser would be here with the others too in this place "


@pytest.fixture(scope="module")
def chars(spark):
    df = spark.createDataFrame([(ENGLISH * 40,), (None,), ("",)], "text string")
    return noisy.CharModel(toxicity.char_counts(df))


@pytest.mark.parametrize(
    "said, meant",
    [("1d10t", "idiot"), ("$tup1d", "stupid"), ("i d i o t", "idiot"), ("m.o.r.o.n", "moron"), ("looooser", "loser"), ("w0rthl3ss", "worthless"), ("p4th3t1c", "pathetic"), ("cl*wn", "clown"), ("IDI0T".lower(), "idiot")],
)
def test_restored(chars, said, meant):
    assert meant in noisy.restore(f"the {said} here", chars).split()


@pytest.fixture(scope="module")
def more_chars(spark):
    df = spark.createDataFrame([((ENGLISH + "you are an ass and an asshole and such shit is hell so kill all of the stupid morons you moron ") * 40,)], "text string")
    return noisy.CharModel(toxicity.char_counts(df))


@pytest.mark.parametrize("gap", [" ", "  ", ".", "-"])
def test_long_spans_are_decoded(more_chars, gap):
    said = "you are a stupid idiot and a pathetic loser the worthless moron".split()
    spaced = (gap if len(gap) > 1 else " ").join(gap[0].join(w) for w in said) if len(gap) > 1 else gap.join("".join(said))
    assert len(spaced) > noisy.LONGEST and noisy._SUSPECT.search(spaced).group(0) == spaced and noisy.suspects([spaced]) == [0]
    assert {"stupid", "idiot", "pathetic", "loser", "worthless", "moron"} <= set(noisy.restore(spaced, more_chars).split())
    assert noisy.restore(gap.join("stupid" * 4000), more_chars).count("stupid") > 3900


def test_long_runs_are_decoded(more_chars):
    for said in ("stup" + 70 * "i" + "d", "s" + 50 * "t" + "up" + 50 * "i" + "d", "st" + 90 * "u" + "p1d"):
        assert "stupid" in noisy.restore(said, more_chars).split()


@pytest.mark.parametrize(
    "said, meant",
    [("ki11", "kill"), ("he11", "hell"), ("@$$hole", "asshole"), ("455hole", "asshole"), ("shi+", "shit"), ("stup!d!", "stupid!"), ("m 0 r 0 n", "moron"), ("s/t/u/p/i/d", "stupid"), ("s t u p 1 d", "stupid"), ("$ t u p i d", "stupid"), ("1 d 1 0 t", "idiot"), ("m.0.r.0.n", "moron"), ("shi*", "shit"), ("ki1|", "kill")],
)
def test_substitutes_at_ends_and_set_apart(more_chars, said, meant):
    text = f"the {said} here"
    assert noisy.suspects([text]) == [0] and noisy._SUSPECT.search(text)
    assert meant in noisy.restore(text, more_chars).split()


def test_signs_at_ends_stay_signs(more_chars):
    for clean in ("a good place!", "others!!!", "the 100th and others123", "1 2 3 4 5 6", "10/12/2024"):
        assert set(clean.split()) <= set(noisy.restore(clean, more_chars).split())
    assert noisy.restore("a good place! 10/12/2024 1 2 3 4", more_chars) == "a good place! 10/12/2024 1 2 3 4"


def test_clean_text_is_left_alone(chars):
    clean = "the others are here, in 2024 at 10:30; a good book (with 3 pages) for all. see you too!"
    assert noisy.restore(clean, chars) == clean and noisy.suspects(["a good book, 12 pages"]) == []


PRINTABLE = "".join(map(chr, range(32, 127)))


@settings(max_examples=600, deadline=None)
@given(st.lists(st.text(st.sampled_from(PRINTABLE + "abo01@$ .-!_/*+|[](){}=" * 3 + "éüßñçя日٣αﬀ\u0301\n"), max_size=30), min_size=1, max_size=4))
def test_suspects_miss_nothing(texts):
    texts = [t.lower() for t in texts]
    found = noisy.suspects(texts)
    assert found == sorted(set(found))
    for k, t in enumerate(texts):
        assert k in found or not noisy._SUSPECT.search(t), t


@pytest.mark.parametrize("text", ["[f u n]", "/f u n/", "=f u n=", "é ü é", "a 日 本 b", "x1", "1x", "ooo"])
def test_suspects_of_signs_around(text):
    assert noisy._SUSPECT.search(text) is None or noisy.suspects([text]) == [0]


def every_reading(o, inner):
    """All paths through the lattice: their text and the channel's cost."""
    arcs = noisy.lattice(o, inner)
    paths = [(0, "", 0.0)]
    while any(i < len(o) for i, *_ in paths):
        paths = [(i + k, text + letters, s + cost) for i, text, s in paths for k, letters, cost in (arcs[i] if i < len(o) else [(0, "", 0.0)])]
    return [(text, s) for _, text, s in paths]


@pytest.mark.parametrize("beam", [1, 2, 24])
def test_decoding_is_exact(more_chars, monkeypatch, beam):
    monkeypatch.setattr(noisy, "BEAM", beam)
    rng = random.Random(5)
    for _ in range(150):
        o = "".join(rng.choice("stupid10!@ .*") for _ in range(rng.randint(1, 6)))
        if o.count("*") > 2:
            continue
        known, inner = rng.choice([(0, False), (noisy.code_of([19, 20]), True)])
        best = -1e9
        for text, s in every_reading(o, inner):
            last = known
            for d in [*noisy.symbols_of(text).tolist(), 0]:
                if d or last % noisy.SYMBOLS:
                    s += more_chars.logp[last * noisy.SYMBOLS + d]
                    last = (last * noisy.SYMBOLS + d) % noisy._STATES
            best = max(best, s)
        score, text = more_chars.decoded(known, inner, False, o)
        assert abs(score - best) < 1e-6 and text in dict(every_reading(o, inner))


def test_counts_cover_all_texts(spark):
    a = toxicity.char_counts(spark.createDataFrame([("abc",)] * 3, "text string"))
    one = toxicity.char_counts(spark.createDataFrame([("abc",)], "text string"))
    assert (a[one > 0] >= one[one > 0]).all() and a.sum() > one.sum()


def test_learns_and_generalises(spark):
    rng = random.Random(2)
    plain = "the of and a to in is that it was for on are with as his they at be this".split()
    forms = ["idiot", "1d10t", "i d i o t", "moron", "m0ron", "mooooron"]
    rows, labels = [], []
    for k in range(400):
        w = [rng.choice(plain) for _ in range(rng.randint(5, 60))]
        toxic = k % 5 == 0
        if toxic:
            w.insert(rng.randrange(len(w)), rng.choice(forms))
        rows.append((k, " ".join(w), "en", "s", 1))
        labels.append((k, int(toxic)))
    df, lab = cases.documents(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(df, lab.filter(~toxicity.held_out()))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(df.filter(toxicity.held_out()), *model).collect()}
    right = [(got[k] >= toxicity.REJECT) == bool(t) for k, t in labels if k in got]
    assert len(right) > 50 and np.mean(right) > 0.97


@pytest.mark.parametrize("share", [0.5, 0.6, 0.9])
def test_learns_where_most_are_toxic(spark, share):
    rng = random.Random(3)
    plain = "the of and a to in is that it was for on are with as his they at be this".split()
    rows, labels = [], []
    for k in range(600):
        w = [rng.choice(plain) for _ in range(rng.randint(5, 60))]
        toxic = rng.random() < share
        if toxic:
            w.insert(rng.randrange(len(w)), rng.choice(["idiot", "m0ron"]))
        rows.append((k, " ".join(w), "en", "s", 1))
        labels.append((k, int(toxic)))
    df, lab = cases.documents(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    kept = {r["doc_id"] for r in toxicity.reject(df, lab).collect()}
    assert kept == {k for k, y in labels if not y}


def test_the_fit_is_at_its_optimum():
    rng = np.random.default_rng(7)
    x = rng.random((200, 12)) < 0.3
    y = (rng.random(200) < 1 / (1 + np.exp(-(x @ rng.normal(size=12) - 0.5)))).astype(float)
    w, b = toxicity.fit(*np.nonzero(x), y, 12, l2=0.1, rounds=5000)
    off = 1 / (1 + np.exp(-(x @ w + b))) - y
    assert np.abs(x.T @ off + 0.1 * w).max() < 1e-3 and abs(off.sum()) < 1e-3


def test_toxicity_of_odd_rows(spark):
    df = cases.with_clashes(cases.documents(spark))
    labels = spark.createDataFrame([(6, 1), (3, 0), (None, 1), (4, None), (6, 1)], "doc_id long, toxic int")
    out = toxicity.reject(df, labels)
    # two labelled rows give no feature, so nothing tells for or against a text
    assert out.columns == df.columns and out.count() == len(cases.odd_rows())
    scores = [r["score"] for r in toxicity.score(df, *toxicity.train(df, labels)).collect()]
    assert len(scores) == len(cases.odd_rows()) and len(set(scores)) == 1 and 0 < scores[0] < 1
    none = toxicity.train(df, labels.filter("false"))
    assert none[1] is None and all(r["score"] == 0 for r in toxicity.score(df, *none).collect())
    assert toxicity.reject(df, labels.filter("false")).count() == len(cases.odd_rows())
    empty = cases.documents(spark, [])
    assert toxicity.score(empty, *toxicity.train(empty, labels)).collect() == []


OWN = [set(licenses.bigrams_of(t)) for _, t in licenses.TEMPLATES]


MARKS = set(licenses.deciding())
NEEDS = [set(licenses.needs_of(t)) for _, t in licenses.TEMPLATES]


def plain_licences(text):
    norm = " ".join(licenses.re.sub(r"[^a-z0-9\n]+", " ", (text or "").lower()).split(" "))
    found, best = set(), 0.0
    ws = norm.split()
    windows = [" ".join(ws[max(0, i - k) : i - k + n]) for i, w in enumerate(ws) for cue, k, n in licenses.cue_spots() if w == cue]
    for u in {" ".join(x.split()) for x in [*norm.split("\n"), *licenses.re.split(r"\n *\n", norm), norm, *windows]}:
        g = set(licenses.bigrams_of(u))
        score = {}
        for k, (name, t) in enumerate(licenses.TEMPLATES):
            own = OWN[k]
            if g and g >= NEEDS[k] and g & MARKS == own & MARKS:
                score[k] = 2 * len(g & own) / (len(g) + len(own))
        top = max(score.values(), default=0)
        if top >= licenses.THRESHOLD:
            found |= {licenses.TEMPLATES[k][0] for k, v in score.items() if v == top}
            best = max(best, top)
    return ",".join(sorted(found)), best


def test_licences_across_the_ends_of_chunks(spark):
    names = [t for _, t in licenses.TEMPLATES]
    texts = {k: " ".join(["word"] * (k % 40 * 13 + licenses.WIDE - 220)) + f" {names[k % len(names)]} and {names[(k + 5) % len(names)]} " + "word " * (k * 7 % 300) for k in range(0, 120, 5)}
    got = licenses.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["licenses"], r["best_dice"]) for r in got} == {k: plain_licences(t) for k, t in texts.items()}


def test_licences_as_without_pruning(spark):
    rng = random.Random(3)
    rows = cases.odd_rows()
    for k, (_, t) in enumerate(licenses.TEMPLATES):
        w = t.split()
        for drop in range(0, len(w), max(3, len(w) // 5)):
            v = [x for x in w if rng.random() > drop / len(w) / 2]
            rows.append((100 + k, "Some text.\n" + " ".join(v).upper() + "\nmore, of it\n\n" + rng.choice(w), None, None, None))
    got = licenses.scan(cases.with_clashes(cases.documents(spark, rows))).collect()
    assert sorted((str(r["doc_id"]), r["licenses"], r["best_dice"]) for r in got) == sorted((str(d), *plain_licences(t)) for d, t, *_ in rows)
    mit = [r for r in got if r["licenses"] == "mit"]
    assert mit and all(r["class"] == "permissive" for r in mit)
    assert licenses.scan(cases.documents(spark, [])).collect() == []


def test_notices_within_other_text(spark):
    bsd = dict(licenses.TEMPLATES)["bsd-3-clause"]
    wrapped = "\n".join("# " + bsd[k : k + 70] for k in range(0, len(bsd), 70))
    texts = {
        0: ("it is free to use. Released under the MIT License. See the LICENSE file for details.", "mit"),
        1: ('code = 1\n# "Licensed under the Apache License,\n# Version 2.0."\nmore code', "apache-2.0"),
        2: (f"Copyright (c) 2001, Somebody\nAll rights reserved.\n\n{bsd}", "bsd-3-clause"),
        3: (f"import x\n{wrapped}\n" + "def f(): pass\n" * 40, "bsd-3-clause"),
        4: ("the license of the software is not known, and nobody may use it under the name of anything " * 5, ""),
        5: ("Released under the MIT License.\n" * 300, "mit"),
    }
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame([(k, t) for k, (t, _) in texts.items()], "doc_id long, text string")).collect()}
    assert {k: r["licenses"] for k, r in got.items()} == {k: x for k, (_, x) in texts.items()}


def test_size_bounds_and_cues():
    for n in range(1, 60):
        low, high = licenses.bounds(n)
        reach = [a for a in range(1, 200) if 2 * min(a, n) / (a + n) >= 0.8]
        assert (low, high) == (reach[0], reach[-1])
    cue = set(licenses.cues())
    for _, t in licenses.TEMPLATES:
        g = licenses.bigrams_of(t)
        without = [x for x in g if not cue & set(x.split())]
        assert all(2 * min(len(without), a) / (a + len(g)) < 0.8 for a in range(1, 2 * len(g) + 1))


PAGES = [
    ("http://A.Example.com/fr/1?x", "a.example.com", "/fr/1", "com/fr/", "allow"),
    ("https://com/de/x#y", "com", "/de/x", "com/de/", "block"),
    ("ftp://example.org/es/1", "example.org", "/es/1", "example.org/es/", "block"),
    ("x://www.example.org/en/19", "www.example.org", "/en/19", "example.org/en/1", "block"),
    ("x://www.example.org/en/29", "www.example.org", "/en/29", "org/", "allow"),
    ("x://myexample.org/es/", "myexample.org", "/es/", "org/", "allow"),
    ("x://example.org", "example.org", "", None, "allow"),
    ("x://example.org?/es/", "example.org", "", None, "allow"),
    ("no scheme", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("", "", "", None, "allow"),
    ("a://b://c/d", "b:", "//c/d", None, "allow"),
    ("x://ÄB.com/fr/\nz", "Äb.com", "/fr/\nz", "com/fr/", "allow"),
]


def test_rules(spark):
    df = spark.createDataFrame([(k, p[0], "theirs", "theirs") for k, p in enumerate(PAGES)], "page_id long, url string, host string, verdict string")
    got = {r["page_id"]: tuple(r)[1:5] for r in ut.judge_urls(df).collect()}
    assert got == {k: p[1:] for k, p in enumerate(PAGES)}
    assert ut.judge_urls(df.filter("false")).collect() == []


def test_templates_generalise_and_reject(spark):
    rules = (("block", "bad.net", "/shop/1"), ("block", "bad.net", "/shop/2"), ("allow", "bad.net", "/about"), ("allow", "good.net", "/shop/1"))
    rows = [(k, f"http://bad.net/shop/{k}") for k in range(100, 400)] + [(1000 + k, f"http://good.net/shop/{k}") for k in range(100, 400)] + [(2000 + k, f"http://bad.net/user/name{chr(97 + k % 26)}{chr(97 + k // 26)}/x") for k in range(60)]
    rows += [(3000 + k, "http://bad.net/about/us") for k in range(30)]
    got = {r["page_id"]: r for r in ut.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), rules=rules).collect()}
    assert got[350]["verdict"] == "block" and got[350]["rule"] is None and got[350]["template"] == "/shop/<n>"
    assert got[1350]["verdict"] == "allow" and got[2001]["template"] == "/user/*/x" and got[3000]["verdict"] == "allow"


def plain_templates(rows):
    """Verdicts by host and segments for ``(host, segs, n, b, a)``, walking the tree from its root."""
    out = {}

    def smooth(b, a, prior):
        return (b + ut.PRIOR * prior) / (b + a + ut.PRIOR)

    def walk(rows, depth, node, p):
        for host, segs, *_ in rows:
            if len(segs) == depth:
                out[host, tuple(segs)] = (node, p)
        rows = [r for r in rows if len(r[1]) > depth]
        kids = {r[1][depth] for r in rows}
        wide = len(kids) >= ut.MANY and sum(r[2] for r in rows) < ut.RARE * len(kids)
        by_name = {}
        for r in rows:
            seg = r[1][depth]
            by_name.setdefault("*" if wide and not seg.startswith("<") else seg, []).append(r)
        counts = {k: (sum(r[3] for r in v), sum(r[4] for r in v)) for k, v in by_name.items()}
        bins = {}
        for k, (b, a) in counts.items():
            bins.setdefault(100 * b // (a + b) if a + b else -1, []).append(k)
        classes, before = [], None
        for key in sorted(bins):
            b, a = (sum(counts[k][j] for k in bins[key]) for j in (0, 1))
            if key >= 0 and before is not None:
                b0, n0, n = before[0], sum(before), a + b
                pool = (b0 + b) / (n0 + n)
                if abs(b0 / n0 - b / n) / (pool * (1 - pool) * (1 / n0 + 1 / n)) ** 0.5 >= ut.Z:
                    classes.append([])
                classes[-1] += bins[key]
            else:
                classes.append(list(bins[key]))
            before = (b, a) if key >= 0 else None
        for names in classes:
            b, a = (sum(counts[k][j] for k in names) for j in (0, 1))
            label = names[0] if len(names) == 1 else f"{{{min(names)}|+{len(names) - 1}}}"
            walk([r for k in names for r in by_name[k]], depth + 1, f"{node}/{label}", p if len(kids) == 1 else smooth(b, a, p))

    for host in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == host]
        walk(own, 0, "", smooth(sum(r[3] for r in own), sum(r[4] for r in own), 0.0))
    return out


def test_templates_as_a_plain_walk(spark):
    rng = random.Random(4)
    rows = {}
    for _ in range(700):
        host = rng.choice(["a", "a", "a", "b", "c"])
        path = [rng.choice(["x", "y", "z", "<n>", "u" + str(rng.randint(0, 60))]) for _ in range(rng.choice([0, 1, 2, 3]))]
        if rng.random() < 0.3:
            path = ["p"] * 7 + path
        bad = path[:1] == ["x"] or path[7:8] == ["y"]
        n = rng.randint(1, 6)
        b = n if bad and rng.random() < 0.8 else 0
        rows[host, tuple(path)] = (n, b, (n - b) if rng.random() < 0.5 else 0)
    rows |= {("d", (f"v{k}", "x")): (1, k % 2, 1 - k % 2) for k in range(40)}
    rows = [(h, list(s), *v) for (h, s), v in rows.items()]
    got = ut.template_verdicts(spark.createDataFrame(rows, "host string, segs array<string>, n long, n_block long, n_allow long"))
    said = {(r["host"], tuple(r["segs"])): (r["template"], r["purity"]) for r in got.collect()}
    want = plain_templates(rows)
    assert said.keys() == want.keys() and all(said[k][0] == want[k][0] and abs(said[k][1] - want[k][1]) < 1e-12 for k in want)
    assert any("|+" in n for n, _ in want.values()) and any("*" in n for n, _ in want.values())


def test_deep_paths_and_odd_rows(spark):
    deep = "/a/b/c/d/e/f"
    rules = (("block", "s.net", f"{deep}/bad/1"), ("allow", "s.net", f"{deep}/good/1"))
    rows = [(k, f"http://s.net{deep}/{w}/{100 * v + k % 50}") for v, (w, base) in enumerate([("bad", 0), ("good", 1000)], 1) for k in range(base, base + 50)]
    rows += [(3000, f"http://s.net{deep}/bad/9"), (3001, f"http://s.net{deep}/good/9"), (None, f"http://s.net{deep}/bad/9"), (3001, f"http://s.net{deep}/good/9"), (3002, "http://s.net/" + "q/" * 3000)]
    rules = (("block", "s.net", f"{deep}/bad/1"), ("allow", "s.net", f"{deep}/good/2"))
    got = [tuple(r)[:6] for r in ut.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), rules=rules).collect()]
    assert len(got) == len(rows)
    verdict = {(r[0], r[2]): r[4] for r in got}
    assert verdict[3000, f"{deep}/bad/9"] == "block" and verdict[3001, f"{deep}/good/9"] == "allow" and verdict[None, f"{deep}/bad/9"] == "block"
    assert sum(r[0] == 3001 for r in got) == 2


def conversations(seed=1, n=40):
    rng = random.Random(seed)
    bits = ["<|im_end|>", "<|im_start|>assistant\n", "\\", "<", "|", "\n", "plain words ", "<\\|", "é", "\\n"]
    rows = []
    for c in range(n):
        turns = rng.randint(1, 30)
        for t in range(turns):
            role = "system" if t == 0 and c % 2 else rng.choice(["user", "assistant"])
            rows.append((c, t, role, "".join(rng.choice(bits) for _ in range(rng.randint(0, 60)))))
    return rows


def plain_turns(rows, key):
    own = sorted((r[1:] for r in rows if r[0] == key), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "", r[2] or ""))
    return [(r or "", t or "") for _, r, t in own]


@pytest.mark.parametrize("budget, history", [(4096, 1024), (300, 120), (50, 0)])
def test_chat_round_trip(spark, budget, history):
    rows = conversations() + [(100, None, None, None), (100, 1, "a\nb\\n", "x"), (100, 1, "assistant", "y"), (100, 1, "assistant", "y"), (None, 0, "user", "z"), (101, 0, "assistant", "q" * 5000)]
    df = spark.createDataFrame([(*r, "theirs") for r in rows], "conv_id long, turn long, role string, text string, window string")
    w = chat.windows(df, budget, history)
    got = {r["conv_id"]: r for r in chat.read_back(w).collect()}
    for key in {r[0] for r in rows}:
        turns = plain_turns(rows, key)
        assert [(t["role"], t["text"]) for t in got[key]["turns"]] == turns
        assert got[key]["loss"] == "".join(t for r, t in turns if r == "assistant")
    for r in w.collect():
        new = r["formatted"].count("<|im_start|>") - r["n_repeated"] - (r["window"] == 0 and r["formatted"].startswith("<|im_start|>system"))
        assert new >= 0 and (len(r["formatted"]) <= budget or new <= 1)
        assert r["formatted"].startswith("<|im_start|>") and r["formatted"].endswith("<|im_end|>\n")
    assert chat.read_back(chat.windows(df.filter("false"))).collect() == []


def test_windows_keep_the_system_turn(spark):
    rows = [(1, 0, "system", "be kind")] + [(1, k, "user" if k % 2 else "assistant", f"turn {k} " * 10) for k in range(1, 20)]
    w = chat.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), 500, 150).collect()
    assert len(w) > 3 and all(r["formatted"].startswith("<|im_start|>system\nbe kind") for r in w) and any(r["n_repeated"] > 1 for r in w)


def test_queries_give_the_contract_columns(spark):
    sf = "/root/testdata/sf0.001"
    need = {
        "op1": "doc_id held_out score predicted", "op2": "doc_id fingerprint component_id", "op3": "doc_id size text_crc32 law shard slot grown_shard",
        "op5": "doc_id n_words n_hit n_items items_sha256 contaminated", "op6": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
        "op7": "doc_id n_bytes n_removed n_spans kept_sha256", "op8": "page_id host path rule verdict",
        "op10": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    }
    for name, f in q.queries().items():
        if (n := name.split("_")[0]) in need:
            assert set(need[n].split()) <= set(f(spark, sf).columns), name
    _ = F


#: Notices as they stand in files: none is a template.
NOTICES = [
    ("/* Frobnitz is free software; you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation; either version 2 of the License, or\n * (at your option) any later version. */", "gpl-2.0", "copyleft"),
    ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful", "gpl-2.0", "copyleft"),
    ("# This program is free software; you can redistribute it and/or modify\n# it under the terms of the GNU General Public License version 2 as\n# published by the Free Software Foundation.", "gpl-2.0", "copyleft"),
    ("Frobnitz is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "gpl-3.0", "copyleft"),
    ("This file is part of libfrob. libfrob is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", "lgpl-2.1", "weak copyleft"),
    ("libfrob is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "lgpl-3.0", "weak copyleft"),
    ("frobd is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "agpl-3.0", "copyleft"),
    ("The photographs: this work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.", "cc-by-sa-4.0", "weak copyleft"),
    ("This article is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "cc-by-nd-4.0", "no derivatives"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 3.0 Unported License!", "cc-by-nc-sa-3.0", "non-commercial"),
    ("This work is licensed under the Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.", "cc-by-nc-nd-4.0", "no derivatives"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License", "cc-by-4.0", "permissive"),
    ("All text here is licensed under CC BY-SA 3.0.", "cc-by-sa-3.0", "weak copyleft"),
]


def test_notices_that_are_no_templates(spark):
    rows = [(k, t) for k, (t, _, _) in enumerate(NOTICES)] + [(100 + k, f"some words before it. {t}\nand some words after it.") for k, (t, _, _) in enumerate(NOTICES)]
    got = {r["doc_id"]: (r["licenses"], r["class"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {base + k: (name, kind) for base in (0, 100) for k, (_, name, kind) in enumerate(NOTICES)}
    assert all(t not in {x for _, x in licenses.TEMPLATES} for t, _, _ in NOTICES)
