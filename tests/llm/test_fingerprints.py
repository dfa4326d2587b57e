"""SimHash operators against plain versions: bits, links, components, edits, neighbours."""

import numpy as np
import pytest
import xxhash

from tests.llm import cases
from tillmark.llm import fingerprints as fp
from tillmark.llm import simhash_gray as sg


def plain_bits(text, words=3):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[k : k + words]) for k in range(max(1, len(w) - words + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_bits_of_texts():
    texts = ["", "a", "A b", "a b c", "a b c d a b c d", "x\ty\nz\x0bq", "é è ê"]
    assert [int(x) for x in sg.text_fingerprints([t.encode() for t in texts])] == [plain_bits(t) for t in texts]


@pytest.mark.parametrize("n, bits, seed", [(400, 64, 1), (1500, 14, 2), (900, 10, 3), (1, 64, 4), (0, 64, 5)])
def test_tree_links_as_all_pairs(n, bits, seed):
    rng = np.random.default_rng(seed)
    x = np.unique(rng.integers(0, 1 << 62, n, dtype=np.uint64) & np.uint64((1 << bits) - 1))
    group = rng.integers(0, 3, len(x))
    a, b = sg.group_links(group, x)
    got = sg.join_labels(np.arange(len(x)), a, b)
    i, j = np.nonzero(np.triu((np.bitwise_count(x[:, None] ^ x[None, :]) <= 3) & (group[:, None] == group[None, :]), 1))
    assert (got == sg.join_labels(np.arange(len(x)), i, j)).all() and len(a) <= max(0, len(x) - 1)


def test_small_frontier_and_check(monkeypatch):
    monkeypatch.setattr(sg, "FRONTIER", 50)
    rng = np.random.default_rng(7)
    x = np.unique(rng.integers(0, 1 << 12, 600, dtype=np.uint64))
    c = rng.integers(0, 1 << 62, (len(x), 2), dtype=np.uint64)
    a, b = sg.group_links(np.zeros(len(x), np.int64), x, 3, c, 58)
    near = (np.bitwise_count(x[:, None] ^ x[None, :]) <= 3) & (np.bitwise_count(c[:, None] ^ c[None, :]).sum(2, dtype=int) <= 58)
    i, j = np.nonzero(np.triu(near, 1))
    assert (sg.join_labels(np.arange(len(x)), a, b) == sg.join_labels(np.arange(len(x)), i, j)).all()


def test_the_tree_carries_the_search():
    """Groups of thousands: several levels, whose nodes drop most of what a search would have to look at, and all links found."""
    rng = np.random.default_rng(11)
    x = rng.integers(0, 1 << 63, 5000, dtype=np.uint64)
    x = np.unique(np.concatenate([x, x[:500] ^ (np.uint64(1) << rng.integers(0, 63, 500).astype(np.uint64)), x[:200] ^ np.uint64(7 << 40)]))
    assert sg.dealing_bits(10_000) == 1 and sg.dealing_bits(100) == 0 and sg.dealing_bits(10**12) == sg.WIDTH
    count = [[0, 0] for _ in range(9)]
    a, b = sg.group_links(np.zeros(len(x), np.int64), x, count=count)
    got = sg.join_labels(np.arange(len(x)), a, b)
    i, j = np.nonzero(np.triu(np.bitwise_count(x[:, None] ^ x[None, :]) <= 3, 1))
    assert (got == sg.join_labels(np.arange(len(x)), i, j)).all() and len(i) >= 700
    met, dropped = np.array([c for c in count if c[0]]).T
    assert len(met) >= 4 and (dropped[:3] > 0).all() and sum(dropped[1:]) > 0
    assert met[0] < len(x) * (len(x) - 1) / 2 / 2  # members compared, of all pairs


def test_groups_stream(spark):
    import pyarrow as pa

    from tillmark.llm.common import by_group

    rng = np.random.default_rng(2)
    key = np.sort(rng.integers(0, 40, 3000))
    key[700:2100] = key[700]
    key = np.sort(key)
    for size in (7, 100, 5000):
        batches = [pa.RecordBatch.from_arrays([pa.array(key[k : k + size]), pa.array(np.arange(k, min(k + size, 3000)))], names=["key", "v"]) for k in range(0, 3000, size)]
        got = list(by_group(iter(batches), "key", 50))
        assert np.concatenate([g["v"] for g in got]).tolist() == list(range(3000))
        ends = [set(g["key"].tolist()) for g in got]
        assert all(not a & b for k, a in enumerate(ends) for b in ends[k + 1 :]) and (size > 100 or len(got) > 5)
    assert list(by_group(iter([]), "key")) == []


def plain_components(rows):
    x = np.array([plain_bits(t) for _, t, *_ in rows], np.uint64)
    i, j = np.nonzero(np.triu(np.bitwise_count(x[:, None] ^ x[None, :]) <= 3, 1))
    labels = sg.join_labels(np.arange(len(x)), i, j)
    low = {}
    for label, (d, *_) in zip(labels.tolist(), rows, strict=True):
        if d is not None:
            low[label] = min(low.get(label, d), d)
    return sorted((str(d), int(f) - (1 << 64) * (int(f) >> 63), low.get(label)) for (d, *_), f, label in zip(rows, x, labels.tolist(), strict=True))


@pytest.mark.parametrize("split, group", [(sg.SPLIT_ROWS, sg.GROUP_ROWS), (0, sg.GROUP_ROWS), (sg.SPLIT_ROWS, 4), (0, 4)])
def test_components(spark, split, group, monkeypatch):
    monkeypatch.setattr(sg.near_links, "__defaults__", (split, group))
    for rows in (cases.odd_rows(), cases.corpus()):
        got = sg.near_duplicates(cases.with_clashes(cases.documents(spark, rows))).collect()
        assert sorted((str(r["doc_id"]), r["fp"], r["component_id"]) for r in got) == plain_components(rows)
    assert sg.near_duplicates(cases.documents(spark, [])).collect() == []


def jaccard(a, b):
    s = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (x.lower().split() for x in (a, b))]
    return len(s[0] & s[1]) / len(s[0] | s[1])


def test_keep_one_catches_near_copies_and_leaves_others(spark):
    rows = [r for r in cases.corpus(200, 9)]
    df = cases.with_clashes(cases.documents(spark, rows))
    out = sg.keep_one(df)
    assert out.columns == df.columns
    kept = {r["doc_id"] for r in out.collect()}
    text = {r[0]: r[1] for r in rows}
    pairs = [(a, b) for a in text for b in text if a < b and jaccard(text[a], text[b]) >= 0.8]
    assert pairs and sum(a in kept and b in kept for a, b in pairs) <= 0.02 * len(pairs)
    for d in text.keys() - kept:
        assert any(jaccard(text[d], text[o]) > 0.4 for o in text if o != d)


def edited_pairs(rng, n=60):
    """Pairs by shape of edit: contiguous ones and short texts, mostly a little over 0.8."""
    words = [f"w{k}" for k in range(2000)]
    text = lambda n: rng.choices(words, k=n)
    shapes = {
        "last of 15": lambda: (w := text(15), w[:-1] + text(1)),
        "one word less of 9": lambda: (w := text(9), w[:-1]),
        "cut by 15 %": lambda: (w := text(150), w[:128]),
        "appended": lambda: (w := text(120), w + text(27)),
        "phrase replaced": lambda: (w := text(100), w[:40] + text(6) + w[46:]),
        "cut at both ends": lambda: (w := text(60), w[5:-5]),
        "scattered": lambda: (w := text(200), [*w[:40], *text(1), *w[41:90], *text(1), *w[91:150], *text(1), *w[151:]]),
    }
    return {name: [tuple(" ".join(x) for x in make()) for _ in range(n)] for name, make in shapes.items()}


def test_keep_one_finds_every_shape_of_edit(spark):
    import random

    pairs = [(name, *p) for name, some in edited_pairs(random.Random(6)).items() for p in some]
    assert all(jaccard(a, b) >= 0.8 for _, a, b in pairs)
    rows = [(2 * k + j, t, "en", "s", len(t)) for k, p in enumerate(pairs) for j, t in enumerate(p[1:])]
    kept = {r["doc_id"] for r in sg.keep_one(cases.documents(spark, rows)).collect()}
    for name in dict.fromkeys(p[0] for p in pairs):
        both = [{2 * k, 2 * k + 1} <= kept for k, p in enumerate(pairs) if p[0] == name]
        assert sum(both) <= 1, (name, sum(both), len(both))
    assert all(2 * k in kept for k in range(len(pairs)))


def test_exact_links_as_all_pairs():
    rng = np.random.default_rng(8)
    for size in (5, 12, 60):
        base = [rng.choice(1 << 39, size, replace=False) for _ in range(6)]
        sets = [set(base[k % 6].tolist()) for k in range(90)]
        for x in sets:
            for _ in range(rng.integers(0, size // 4 + 1)):
                x.discard(rng.choice(sorted(x)))
                if rng.random() < 0.5:
                    x.add(int(rng.integers(1 << 39)))
        a, b = sg.exact_links([b"".join(t.to_bytes(5, "little") for t in sorted(x)) for x in sets])
        i, j = zip(*[(i, j) for i in range(90) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])])
        assert (sg.join_labels(np.arange(90), np.array(a), np.array(b)) == sg.join_labels(np.arange(90), np.array(i), np.array(j))).all()
        assert len(a) < 90


@pytest.mark.parametrize("weight", [sg.PART_WEIGHT, 2000])
def test_keep_one_leaves_pairs_below_the_threshold(spark, weight, monkeypatch):
    import random

    monkeypatch.setattr(sg.verified, "__defaults__", (weight,))
    rng, texts = random.Random(12), []
    words = [f"w{k}" for k in range(2000)]
    for _ in range(40):
        w = rng.choices(words, k=150)
        texts.append(" ".join(w))
        for edits in (2, 4, 5, 6, 7):
            v = list(w)
            for k in rng.sample(range(4, 146, 6), edits):
                v[k] = rng.choice(words)
            texts.append(" ".join(v))
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate(texts)]
    kept = {r["doc_id"] for r in sg.keep_one(cases.documents(spark, rows)).collect()}
    near = {d: [o for o in range(d // 6 * 6, d // 6 * 6 + 6) if o != d and jaccard(texts[d], texts[o]) >= 0.8] for d in range(len(texts))}
    low = {}  # the smallest id that pairs at 0.8 or more reach
    for d in range(len(texts)):
        seen, todo = {d}, [d]
        while todo:
            todo += (new := set(near[todo.pop()]) - seen)
            seen |= new
        low[d] = min(seen)
    assert kept == set(low.values()) and len(kept) > 100


def test_keep_one_on_odd_rows(spark):
    rows = cases.odd_rows()
    out = sg.keep_one(cases.documents(spark, rows)).collect()
    assert len({(r["doc_id"], r["text"]) for r in out}) == len(out)
    kept = [r["text"] for r in out]
    assert sum(t is not None and cases.PASSAGE == t for t in kept) == 1 and cases.LONG in kept and "a" in kept and "a b" in kept
    assert sg.keep_one(cases.documents(spark, [])).collect() == []


def edited_of(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    out = []
    for k, r in enumerate(order):
        t, nxt = r[1] or "", order[(k + 1) % len(order)][1] or ""
        q = len(t) // 4
        e = t[: len(t) - q] + nxt[:q]
        f, g, n = (int(x) for x in fp.fingerprints([x.encode() for x in (t, e, nxt)]))
        signed = lambda v: v - (1 << 64) * (v >> 63)
        out.append((str(r[0]), len(t), cases.sha(e), signed(f), signed(g), 1 - (f ^ g).bit_count() / 64, 1 - (f ^ n).bit_count() / 64))
    return sorted(out)


@pytest.mark.parametrize("part_rows", [4096, 7])
def test_edits_and_next(spark, part_rows, monkeypatch):
    monkeypatch.setattr(fp.with_next, "__defaults__", (part_rows, 10_000))
    for rows in (cases.corpus(90), cases.odd_rows(), cases.corpus(1)):
        got = fp.edited_likeness(cases.with_clashes(cases.documents(spark, rows))).collect()
        assert sorted((str(r[0]), *list(r)[1:]) for r in got) == edited_of(rows)
    assert fp.edited_likeness(cases.documents(spark, [])).collect() == []


def test_likeness_tells_edits_from_strangers(spark):
    rows = [r for r in cases.corpus(150, 11) if len(r[1]) > 200]
    got = fp.edited_likeness(cases.documents(spark, rows)).collect()
    assert np.mean([r["near_edited"] > r["near_next"] for r in got]) > 0.9 and np.mean([r["near_edited"] for r in got]) > 0.72


def test_block_tables_find_all_neighbours(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    near = base[:120] ^ (np.uint64(1) << rng.integers(0, 64, 120).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 120).astype(np.uint64))
    x = np.unique(np.concatenate((base, near, near[:50] ^ np.uint64(5))))
    df = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long")
    count = (np.bitwise_count(x[:, None] ^ x[None, :]) <= 3).sum(1) - 1
    assert {r["fp"]: r["n_near"] for r in fp.near_counts(df).collect()} == {int(v): int(n) for v, n in zip(x.view(np.int64), count, strict=True) if n}
