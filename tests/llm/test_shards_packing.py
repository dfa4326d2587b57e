"""Shards and sequences: the least capacity by trying all cuts, whole rows, nothing lost."""

import random
import zlib
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tests.llm import cases
from tillmark.llm import packing, sharding


def least_by_trying(sizes, n):
    best = sum(sizes)
    for k in range(1, min(n, len(sizes)) + 1):
        for cut in combinations(range(1, len(sizes)), k - 1):
            at = [0, *cut, len(sizes)]
            best = min(best, max(sum(sizes[a:b]) for a, b in zip(at, at[1:], strict=False)))
    return best


@pytest.mark.parametrize("seed", range(6))
def test_least_capacity(spark, seed):
    rng = random.Random(seed)
    n = rng.randint(2, 5)
    rows = [(f"{rng.getrandbits(128):032x}" if seed % 2 else f"{k:032x}", rng.randint(1, 30)) for k in range(11)]
    df = spark.createDataFrame(rows, "key string, size long")
    own, cuts = sharding.minimax_cuts(df, n)
    rest = sorted((k, s) for k, s in rows if k not in own)
    shard = [sum(k >= c for c in cuts) for k, _ in rest]
    sums = [sum(s for (_, s), x in zip(rest, shard, strict=True) if x == j) for j in range(len(cuts) + 1)]
    assert len(own) + len(cuts) + 1 <= n
    assert max(sums) == least_by_trying([s for _, s in rest], n - len(own))


def test_shards_of_odd_rows(spark):
    rows = cases.odd_rows()
    got = sharding.shard_rows(cases.with_clashes(cases.documents(spark, rows)), 4, salts=3).collect()
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == sorted((str(d), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(4))
    text = {r[0]: r[1] for r in rows if r[0] is not None}
    where = {}
    for r in got:
        if r["doc_id"] is not None:
            where.setdefault(text[r["doc_id"]], set()).add(r["shard"])
    assert all(len(s) == 1 for s in where.values())
    assert sharding.shard_rows(cases.documents(spark, [])).collect() == []


def test_a_huge_group_leaves_no_shard_empty(spark):
    rows = [(k, "same text " * 50 if k % 3 == 0 else f"own text {k} " * 3, None, None, None) for k in range(300)]
    got = sharding.shard_rows(cases.documents(spark, rows), 8).collect()
    assert {r["shard"] for r in got} == set(range(8)) and len({r["shard"] for r in got if r["doc_id"] % 3 == 0}) == 1


@pytest.mark.parametrize("seed", range(4))
def test_bins_hold_all_pieces_apart(seed):
    rng = random.Random(seed)
    caps = (16, 40, 100)
    lengths = [rng.choice([rng.randint(1, 100), rng.randint(1, 12), 100, 16]) for _ in range(400)]
    bins, offsets, sizes = packing.pack_lengths(lengths, caps, 2)
    filled = {}
    for n, b, o in sorted(zip(lengths, bins, offsets, strict=True), key=lambda x: (x[1], x[2])):
        assert o == filled.get(b, 0)
        filled[b] = o + n
    for b, n in filled.items():
        assert sizes[b] == min(c for c in caps if c >= n)
    assert sum(lengths) / sum(sizes) > 0.93


def plain_pack(lengths, caps, overhead):
    """The same rules by looking at every open bin: least room that suffices, the bin that got it last among equals; a new bin by least cost for what can still be filled."""
    caps, left, bins, where = sorted(caps), list(lengths), [], [None] * len(lengths)

    def filled(space, first):
        pool, got = sorted(left, reverse=True), 0
        pool.remove(first)
        for n in sorted(set(pool), reverse=True):
            take = min(pool.count(n), space // n)
            got, space = got + take * n, space - take * n
        return got

    clock = 0
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n, clock = lengths[i], clock + 1
        fit = [b for b in bins if b["room"] >= n]
        if fit:
            b = min(fit, key=lambda b: (b["room"], -b["since"]))
        else:
            cap = min((c for c in caps if c >= n), key=lambda c: ((c + overhead) / (n + filled(c - n, n)), c))
            b = {"number": len(bins), "room": cap, "used": 0, "since": 0}
            bins.append(b)
        where[i] = (b["number"], b["used"])
        b.update(room=b["room"] - n, used=b["used"] + n, since=clock)
        left.remove(n)
    return [w[0] for w in where], [w[1] for w in where], [min(c for c in caps if c >= b["used"]) for b in bins]


@pytest.mark.parametrize("seed", range(12))
def test_same_bins_as_the_plain_form(seed):
    rng = random.Random(seed)
    caps = rng.choice([(16, 40, 100), (100,), (7, 20, 50, 90)])
    most = rng.choice([max(caps), max(caps) // 3, 12])
    lengths = [rng.randint(1, min(most, max(caps))) for _ in range(rng.randint(1, 150))]
    overhead = rng.choice([0, 2, 64])
    assert packing.pack_lengths(lengths, caps, overhead) == plain_pack(lengths, caps, overhead)


@pytest.mark.parametrize("same", [None, 5])
def test_one_id_is_spread_over_groups(spark, same):
    rows = [(same, "x" * (k % 50), None, None, None) for k in range(900)] + [(1000 + k, "y" * 30, None, None, None) for k in range(100)]
    got = packing.pack(cases.documents(spark, rows).repartition(6), F.octet_length("text"), capacities=(64, 128), group_rows=50).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in got) == sorted((str(r[0]), len(r[1])) for r in rows)
    per_group, held = {}, {}
    for r in got:
        if r["bin"]:
            g = r["bin"].rsplit("-", 1)[0]
            per_group[g] = per_group.get(g, 0) + 1
            held.setdefault(r["bin"], []).append((r["bin_offset"], r["n_tokens"], r["capacity"]))
    assert max(per_group.values()) < 300 and len(per_group) > 15
    for pieces in held.values():
        pieces.sort()
        assert [o for o, _, _ in pieces] == [sum(n for _, n, _ in pieces[:k]) for k in range(len(pieces))] and sum(n for _, n, _ in pieces) <= pieces[0][2]


def test_downsizing_and_cost():
    assert packing.pack_lengths([10], (16, 40, 100), 2) == ([0], [0], [16])
    assert packing.pack_lengths([], (16,), 2) == ([], [], [])
    bins, _, sizes = packing.pack_lengths([60, 40, 16], (16, 40, 100), 2)
    assert sorted(sizes) == [16, 100] or sum(sizes) == 116 and len(bins) == 3


def test_pieces_of_odd_rows(spark):
    rows = [*cases.odd_rows(), (99, "y" * 70_000, None, None, None)]
    df = cases.with_clashes(cases.documents(spark, rows))
    got = packing.pack(df, F.octet_length("text"), group_rows=5).collect()
    total = {}
    for r in got:
        total[str(r["doc_id"])] = total.get(str(r["doc_id"]), 0) + r["n_tokens"]
        assert (r["bin"] is None) == (r["n_tokens"] == 0)
    expected = {}
    for d, t, *_ in rows:
        expected[str(d)] = expected.get(str(d), 0) + len((t or "").encode())
    assert total == expected
    assert sorted(r["start"] for r in got if r["doc_id"] == 99) == [0, 16384, 32768, 49152, 65536]
    assert packing.pack(cases.documents(spark, []), F.octet_length("text")).collect() == []
