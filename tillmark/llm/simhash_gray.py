"""SimHash near-duplicates through a hierarchical index in Gray order.

Distinct fingerprints go four times into groups of some thousands, each time by a few
bits of another block of 16: two that differ in at most three bits agree on one whole block,
so one of the groups has both. A group is sorted by
Gray rank, so that neighbours share bits, and stands under a tree whose nodes
hold the masked bits that all below them share; a node keeps only the bits that
its parent does not have yet. A search goes down the tree adding up the
differences and drops a whole group once they exceed the radius; a node all of
whose members must lie within the radius is taken whole. Each group passes on a
spanning forest of its links, never its pairs.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillmark.llm import fingerprints
from tillmark.llm.common import arrow_map, by_group, components, drop_path, free_name, free_shuffles, join_heavy, map_arrow, raw_texts, written

SEED = 42
RADIUS = 3
BLOCKS = 4
WIDTH = 64 // BLOCKS
FAN = 8
#: Rows of a group on average: so many of the bits of a block deal as leave that; and rows from which on a group is dealt again by a second block.
GROUP_ROWS, SPLIT_ROWS = 4096, 200_000
#: Entries that a search may hold at once; beyond them its queries are halved.
FRONTIER = 2_000_000


def majority(hashes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Bits set in over half the hashes of each run; ``begins`` has the first index of each run and the end of all."""
    out = np.zeros(len(begins) - 1, np.uint64)
    at = 0
    while at < len(out):
        to = max(at + 1, int(np.searchsorted(begins, begins[at] + 200_000, side="right")) - 1)
        h = hashes[begins[at] : begins[to]]
        n = np.diff(begins[at : to + 1])
        full = np.flatnonzero(n)
        if len(full):
            bits = np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64)
            sums = np.add.reduceat(bits, begins[at:to][full] - begins[at], axis=0, dtype=np.int32)
            out[at:to][full] = np.packbits(2 * sums > n[full][:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
        at = to
    return out


def text_fingerprints(texts: list[bytes], words: int = 3) -> np.ndarray:
    """SimHash of each text over its shingles of ``words`` lower-cased words; no words: zero."""
    digest, hashes, counts = xxhash.xxh64_intdigest, [], [0]
    for t in texts:
        ws = t.lower().split()
        if len(ws) < words:
            hashes += [digest(b" ".join(ws), SEED)] if ws else []
        elif words == 3:
            hashes += [digest(b"%b %b %b" % x, SEED) for x in zip(ws, ws[1:], ws[2:])]
        else:
            hashes += [digest(b" ".join(x), SEED) for x in zip(*(ws[k:] for k in range(words)))]
        counts.append(len(hashes))
    return majority(np.array(hashes, np.uint64), np.array(counts))


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each code in the reflected Gray sequence."""
    x = x.copy()
    for k in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(k)
    return x


class GrayTree:
    """Groups of fingerprints of one height, each sorted by Gray rank, under levels of masked patterns."""

    def __init__(self, x: np.ndarray, begins: np.ndarray) -> None:
        self.x = x
        self.levels: list[tuple[np.ndarray, ...]] = []  # child begins, pattern, mask, last member; leaves first
        ors = ands = x
        last = np.arange(len(x))
        at = begins  # first element of each group, and the end
        while True:
            n = np.diff(at)
            nodes = -(-n // FAN)
            group_at = np.concatenate(([0], np.cumsum(nodes)))
            first = np.repeat(at[:-1] - group_at[:-1] * FAN, nodes) + np.arange(group_at[-1]) * FAN
            child = np.concatenate((first, [at[-1]]))
            last = last[child[1:] - 1]
            ors, ands = np.bitwise_or.reduceat(ors, first), np.bitwise_and.reduceat(ands, first)
            mask = ~(ors ^ ands)
            self.levels.append((child, ands & mask, mask, last))
            at = group_at
            if nodes.max() == 1:
                break

    def links(self, radius: int, labels: np.ndarray, also=None, count: list[list[int]] | None = None) -> np.ndarray:
        """``labels`` (a root for each member) with linked members joined; ``also`` says which pairs within the radius link (all).

        ``count`` gets for each level, leaves first, how many nodes (below them: members) searches met and how many they dropped.
        """
        x = self.x
        leaves = self.levels[0]
        spread = np.bitwise_count(~leaves[2])
        close = np.flatnonzero(spread <= radius) if also is None else []  # leaves whose members all link
        if len(close):
            a = np.concatenate([np.arange(leaves[0][k], leaves[0][k + 1] - 1) for k in close]).astype(np.int64)
            labels = join_labels(labels, a, a + 1)
        members = self._members()
        root_of = np.repeat(np.arange(len(self.levels[-1][0]) - 1), np.diff(members))
        if also is not None:  # neighbours first: a large group of near copies is then one label, and left out below
            for k in (1, 2):
                a = np.flatnonzero((root_of[k:] == root_of[:-k]) & (np.bitwise_count(x[k:] ^ x[:-k]) <= radius))
                labels = join_labels(labels, (a := a[also(a, a + k)]), a + k)
        spans = self._label_spans(labels) if also is not None else None
        todo = [(i, min(i + 20_000, len(x))) for i in range(0, len(x), 20_000)]
        while todo:
            lo, hi = todo.pop()
            q = np.arange(lo, hi)
            node = root_of[lo:hi]
            acc = np.bitwise_count((x[q] ^ self.levels[-1][1][node]) & self.levels[-1][2][node]).astype(np.int16)
            ok = self.levels[-1][3][node] > q
            if spans is not None:
                ok &= (spans[-1][0][node] != labels[q]) | (spans[-1][1][node] != labels[q])
            q, node, acc = q[ok], node[ok], acc[ok]
            pairs_a, pairs_b = [], []
            for depth in range(len(self.levels) - 1, -1, -1):
                child, _, mask, last = self.levels[depth]
                # all below are within reach: one link stands for the node, its members are linked below
                whole = acc + np.bitwise_count(~mask[node]) <= radius
                if depth == 0 and also is None and whole.any():
                    pairs_a.append(q[whole])
                    pairs_b.append(last[node[whole]])
                    q, node, acc = q[~whole], node[~whole], acc[~whole]
                n = child[node + 1] - child[node]
                if n.sum() > FRONTIER and hi - lo > 1:
                    q = None
                    break
                below = np.repeat(child[node] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                q, acc, above = np.repeat(q, n), np.repeat(acc, n), np.repeat(mask[node], n)
                if depth:
                    _, pattern, own, end = self.levels[depth - 1]
                    acc = acc + np.bitwise_count((x[q] ^ pattern[below]) & own[below] & ~above)
                    ok = (acc <= radius) & (end[below] > q)
                    if spans is not None:
                        ok &= (spans[depth - 1][0][below] != labels[q]) | (spans[depth - 1][1][below] != labels[q])
                else:
                    ok = (below > q) & (np.bitwise_count(x[q] ^ x[below]) <= radius)
                    if also is not None:
                        ok &= labels[q] != labels[below]
                        some = np.flatnonzero(ok)
                        ok[some] = also(q[some], below[some])
                if count is not None:
                    count[depth][0] += len(ok)
                    count[depth][1] += int((~ok).sum())
                q, node, acc = q[ok], below[ok], acc[ok]
            if q is None:
                mid = (lo + hi) // 2
                todo += [(lo, mid), (mid, hi)]
                continue
            labels = join_labels(labels, np.concatenate([*pairs_a, q]), np.concatenate([*pairs_b, node]))
            if spans is not None and len(q):
                spans = self._label_spans(labels)
        return labels

    def _label_spans(self, labels: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Least and greatest label below each node, by level."""
        out, low, high = [], labels, labels
        for child, *_ in self.levels:
            low, high = np.minimum.reduceat(low, child[:-1]), np.maximum.reduceat(high, child[:-1])
            out.append((low, high))
        return out

    def _members(self) -> np.ndarray:
        at = np.arange(len(self.levels[-1][0]))
        for child, *_ in reversed(self.levels):
            at = child[at]
        return at


def join_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots after the links ``a - b``: hooks the larger root to the smaller until no link joins two."""
    while len(a):
        la, lb = labels[a], labels[b]
        apart = la != lb
        if not apart.any():
            break
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels = up
    return labels


def group_links(group: np.ndarray, rotated: np.ndarray, radius: int = RADIUS, check: np.ndarray | None = None, apart: int = 0, count: list[list[int]] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest (indexes) of the links within each group.

    With ``check`` (rows of further bits) a pair links only if these too differ in ``apart`` bits at most.
    """
    order = np.lexsort((gray_rank(rotated), group))
    g, x = group[order], rotated[order]
    begins = np.concatenate((np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1]))), [len(g)])) if len(g) else np.zeros(1, np.int64)
    sizes = np.diff(begins)
    height = np.ceil(np.log(np.maximum(sizes, FAN)) / np.log(FAN)).astype(int)
    out_a, out_b = [], []
    for h in np.unique(height[sizes > 1]):
        some = np.flatnonzero((height == h) & (sizes > 1))
        n = sizes[some]
        at = np.concatenate(([0], np.cumsum(n)))
        members = np.repeat(begins[some] - at[:-1], n) + np.arange(at[-1])
        also = None
        if check is not None:
            c = check[order[members]]
            also = lambda a, b, c=c: np.bitwise_count(c[a] ^ c[b]).sum(1, dtype=np.int64) <= apart
        labels = GrayTree(x[members], at).links(radius, np.arange(len(members)), also, count)
        low = np.flatnonzero(labels != np.arange(len(members)))
        out_a.append(order[members[low]])
        out_b.append(order[members[labels[low]]])
    if not out_a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(out_a), np.concatenate(out_b)


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for c in by_group(batches, "key"):
        key, fp = c["key"], c["fp"].view(np.uint64)
        block = ((key >> 32) & 3).astype(np.uint64) * np.uint64(WIDTH)  # of whose bits the group has the same
        rotated = np.where(block == 0, fp, (fp >> block) | (fp << ((np.uint64(64) - block) & np.uint64(63))))
        a, b = group_links(key, rotated)
        yield pa.RecordBatch.from_arrays([pa.array(fp[a].view(np.int64)), pa.array(fp[b].view(np.int64))], names=["a", "b"])


def dealing_bits(n: int, group_rows: int = GROUP_ROWS) -> int:
    """How many bits of a block deal ``n`` fingerprints into groups of about ``group_rows``."""
    return min(WIDTH, max(0, (n // group_rows).bit_length() - 1))


def near_links(fps: DataFrame, split_rows: int = SPLIT_ROWS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Links ``a, b`` whose components are those of all pairs of ``fps(fp)`` within three bits."""
    bits = dealing_bits(fps.count(), group_rows)
    tables = " union all ".join(f"select {t}L as t, shiftrightunsigned(fp, {t * WIDTH}) & {(1 << bits) - 1}L as v, fp from {{fps}}" for t in range(BLOCKS))
    keyed = fps.sparkSession.sql(tables, fps=fps).selectExpr("(t << 32) | v as key", "fp")
    hot = keyed.groupBy("key").count().filter(F.col("count") > split_rows).select("key")
    hot, _ = written(hot, "hot-blocks")
    if hot.head(1):
        # of a pair that agrees on the whole block the other 48 bits agree on one of four blocks of 12: finer groups, the same links
        cold = keyed.join(hot, "key", "left_anti")
        rest = keyed.join(hot, "key").selectExpr(
            "key", "fp", f"case when key >> 32 = 0 then fp else shiftrightunsigned(fp, cast((key >> 32) * {WIDTH} as int)) | shiftleft(fp, cast(64 - (key >> 32) * {WIDTH} as int)) end as r"
        ).selectExpr("key", "fp", "r", "explode(sequence(0, 3)) as s")
        fine = rest.selectExpr("key | (cast(s + 1 as long) << 34) | ((shiftrightunsigned(r, 16 + 12 * s) & 4095L) << 16 << 24) as key", "fp")
        keyed = cold.unionByName(fine)
    return arrow_map(keyed.repartition("key").sortWithinPartitions("key"), _forest, "a long, b long")


#: Words of a shingle, and fingerprints over distinct shingles that lead to a pair. At Jaccard 0.8 two sets have a cosine of 8/9 at least, whatever
#: the edit, and bits differ by 0.152 at most: one of the 4 * LEADS blocks of 16 bits agrees with a chance of 1 - (1 - 0.848 ** 16) ** 80 = 0.997.
SHINGLE, LEADS = 5, 20
#: Bits of 64 and of ``CHECK_BITS`` further ones that may differ in a candidate: 3.5 deviations above their means at Jaccard 0.8.
LEAD_APART, CHECK_BITS, CHECK_APART = 16, 128, 34


def sketches(texts: list[bytes], shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """``LEADS`` fingerprints over distinct shingles, two further ones, and the sorted distinct shingles (five bytes each), for each text."""
    leads, checks, sets = [np.empty((0, LEADS), np.uint64)], [np.empty((0, CHECK_BITS // 64), np.uint64)], []
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (size == 0 or size < fingerprints.CHUNK_BYTES):
            size += len(texts[to]) + 1
            to += 1
        word, first = fingerprints.words(texts[at:to])
        n = np.diff(first)
        whole = np.maximum(1, n - shingle + 1) * (n > 0)  # shingles of each text
        ends = np.concatenate(([0], np.cumsum(whole)))
        begin = np.repeat(first[:-1] - ends[:-1], whole) + np.arange(ends[-1])
        stop = np.repeat(first[1:], whole)
        joint = np.zeros(len(begin), np.uint64)
        for j in range(shingle):
            inside = begin + j < stop
            joint = np.where(inside, fingerprints._mixed(joint * np.uint64(3) + np.where(inside, word[np.minimum(begin + j, len(word) - 1)] if len(word) else 0, 0)), joint)
        terms, _, runs = fingerprints.distinct_terms(joint, ends)
        leads.append(np.stack([fingerprints.vote(terms, None, runs, 1 + k) for k in range(LEADS)], 1))
        checks.append(np.stack([fingerprints.vote(terms, None, runs, 101 + k) for k in range(CHECK_BITS // 64)], 1))
        packed = np.ascontiguousarray(terms.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()
        sets += [packed[5 * lo : 5 * hi] for lo, hi in zip(runs[:-1].tolist(), runs[1:].tolist(), strict=True)]
        at = to
    return np.concatenate(leads), np.concatenate(checks), sets


#: Sets of so few shingles differ in one at Jaccard 0.8, where ties make bits err more; what is left without each one leads to those pairs.
ONE_OFF = (4, 9)


def one_off(shingles: bytes) -> list[int]:
    """Of a small set a digest that removing a shingle changes to one that the set without it has: its own, and those without each."""
    if not ONE_OFF[0] <= len(shingles) // 5 <= ONE_OFF[1]:
        return []
    terms = [int.from_bytes(shingles[k : k + 5], "little") for k in range(0, len(shingles), 5)]
    whole = functools.reduce(operator.xor, terms)
    return [whole, *(whole ^ t for t in terms)]


def _checked_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for c in by_group(batches, "key"):
        check = np.stack([c["c0"].view(np.uint64), c["c1"].view(np.uint64)], 1)
        a, b = group_links(c["key"], c["fp"].view(np.uint64), LEAD_APART, check, CHECK_APART)
        yield pa.RecordBatch.from_arrays([pa.array(c["node"][a]), pa.array(c["node"][b])], names=["a", "b"])


#: Weight (shingles, and ``SET_WEIGHT`` for each set) of the part of a candidate component that is compared with another at once.
PART_WEIGHT, SET_WEIGHT = 250_000, 200


def exact_links(sets: list[bytes]) -> tuple[list[int], list[int]]:
    """Spanning forest (indexes) of all pairs of sets of shingles (distinct, five bytes each) with a Jaccard index of 0.8 or more."""
    n = np.array([len(x) // 5 for x in sets], np.int64)
    order = np.argsort(n, kind="stable")
    n, at = n[order], np.concatenate(([0], np.cumsum(n[order])))
    wide = np.zeros((at[-1], 8), np.uint8)
    wide[:, :5] = np.frombuffer(b"".join(sets[k] for k in order), np.uint8).reshape(-1, 5)
    distinct, term = np.unique(wide.view("<u8")[:, 0], return_inverse=True)
    has = np.zeros(len(distinct), bool)
    labels, out_a, out_b = np.arange(len(sets)), [], []
    for i in range(1, len(sets)):
        first = int(np.searchsorted(n, -(-4 * n[i] // 5)))  # smaller sets share too little
        some = first + np.flatnonzero(labels[first:i] != i)
        if not len(some) or not n[i]:
            continue
        has[term[at[i] : at[i + 1]]] = True
        while len(some):
            # the latest first, so many shingles at once; what a link joins is not compared again
            take = max(1, int(np.searchsorted(np.cumsum(n[some][::-1]), 50_000)))
            now, some = some[-take:], some[:-take]
            size = n[now]
            here = np.repeat(at[now] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
            shared = np.add.reduceat(has[term[here]], np.concatenate(([0], np.cumsum(size)[:-1])), dtype=np.int64)
            near = now[9 * shared >= 4 * (size + n[i])]
            if len(near):
                roots, which = np.unique(labels[near], return_index=True)
                out_a += [order[i]] * len(roots)
                out_b += order[near[which]].tolist()
                labels[np.isin(labels, roots)] = i
                labels[i] = i
                some = some[labels[some] != i]
        has[term[at[i] : at[i + 1]]] = False
    return [int(x) for x in out_a], out_b


def _exact_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within each run of rows with the same ``root, i, j``; one run is held at a time."""
    key, nodes, sets = None, [], []

    def done() -> pa.RecordBatch:
        a, b = exact_links(sets)
        return pa.RecordBatch.from_arrays([pa.array([nodes[x] for x in a], pa.int64()), pa.array([nodes[x] for x in b], pa.int64())], names=["a", "b"])

    for batch in batches:
        for *k, node, x in zip(*(batch.column(c).to_pylist() for c in ("root", "i", "j", "node", "shingles")), strict=True):
            if k != key:
                if len(sets) > 1:
                    yield done()
                key, nodes, sets = k, [], []
            nodes.append(node)
            sets.append(x)
    if len(sets) > 1:
        yield done()


def verified(sets: DataFrame, part_weight: int = PART_WEIGHT) -> DataFrame:
    """Links ``a, b`` that join what pairs of a Jaccard index of 0.8 or more join among the ``sets(root, node, shingles)`` of each root.

    Roots above ``part_weight`` are cut into parts, of which every two meet.
    """
    weight = F.sum(F.octet_length("shingles") / 5 + SET_WEIGHT)
    cut = sets.groupBy("root").agg(F.ceil(weight / part_weight).cast("int").alias("parts")).filter("parts > 1")
    dealt = sets.join(F.broadcast(cut), "root", "left").selectExpr("root", "node", "shingles", "coalesce(parts, 1) as parts", "cast(pmod(xxhash64(node), coalesce(parts, 1)) as int) as part")
    dealt = dealt.selectExpr("root", "node", "shingles", "part", "explode(sequence(0, parts - 1)) as other").selectExpr("root", "least(part, other) as i", "greatest(part, other) as j", "node", "shingles")
    return arrow_map(dealt.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j"), _exact_forest, "a long, b long")


def keep_one(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with one row of each group of near copies: the one with the smallest id (null stands first).

    Near copies are pairs whose sets of five-word shingles have a Jaccard index of 0.8 or
    more, and what such pairs join. Fingerprints over the shingles lead to candidates, with
    a chance that depends on the Jaccard index and not on the shape of the edit; a pair
    links only if its sets of shingles (hashed to 40 bits) are that much alike. Texts
    without words are copies of each other, whole texts are read, of rows that agree in id and text one stays,
    an empty table gives no rows; ``df``'s columns come back as they are, whatever their names.
    """
    id_type = dict(df.dtypes)[id_col]

    def run(b: pa.RecordBatch) -> dict:
        leads, checks, sets = sketches(raw_texts(b, "text"))
        node = [int.from_bytes(xxhash.xxh3_64_digest(x), "little", signed=True) for x in sets]
        return {"id": b.column("id"), "node": node, "leads": list(leads.view(np.int64)), "c0": checks[:, 0].view(np.int64), "c1": checks[:, 1].view(np.int64), "shingles": sets, "few": [one_off(x) for x in sets]}

    rows, _ = written(map_arrow(df.select(F.col(id_col).alias("id"), F.col(text).alias("text")), run, f"id {id_type}, node long, leads array<long>, c0 long, c1 long, shingles binary, few array<long>"), "sketches")
    nodes = rows.groupBy("node").agg(F.first("leads").alias("leads"), F.first("c0").alias("c0"), F.first("c1").alias("c1"), F.first("few").alias("few"))
    nodes, _ = written(nodes, "nodes")
    led = nodes.selectExpr("node", "c0", "c1", "posexplode(leads) as (lead, fp)")
    led = led.selectExpr("node", "c0", "c1", "lead", "fp", f"explode(sequence(0, {BLOCKS - 1})) as t")
    turned = f"case when t = 0 then fp else shiftrightunsigned(fp, t * {WIDTH}) | shiftleft(fp, 64 - t * {WIDTH}) end as fp"
    keyed = led.selectExpr("node", "c0", "c1", turned, f"(cast(lead * {BLOCKS} + t as long) << 32) | (shiftrightunsigned(fp, t * {WIDTH}) & {(1 << WIDTH) - 1}L) as key")
    links = arrow_map(keyed.select("key", "fp", "node", "c0", "c1").repartition("key").sortWithinPartitions("key"), _checked_forest, "a long, b long")
    few = nodes.selectExpr("node", "explode(few) as v")
    links = links.unionByName(few.join(few.groupBy("v").agg(F.min("node").alias("a")), "v").filter("node <> a").select("a", F.col("node").alias("b")))
    # candidates only bring sets together: what they join is compared shingle by shingle
    sets = rows.groupBy("node").agg(F.first("shingles").alias("shingles")).join(components(links, "candidates"), "node").select("root", "node", "shingles")
    sets, at = written(sets, "shingles")
    free_shuffles(df.sparkSession)
    linked = components(verified(sets), "near")
    drop_path(df.sparkSession, at)
    # ids meet first for each node, then for each group of nodes: no task gets all rows of a group
    lowest = lambda df, key: df.groupBy(key).agg(F.min("low").alias("low"))
    first = lowest(rows.select("node", F.struct(F.col("id").isNotNull().alias("some"), "id").alias("low")), "node")
    kept_id, kept_d, of_row = (free_name(df, c) for c in ("kept_id", "kept_d", "digest"))
    kept = lowest(first.join(linked, "node", "left").withColumn("root", F.coalesce("root", "node")), "root").select(F.col("low.id").alias(kept_id))
    twice = rows.groupBy("id").count().filter("count > 1").head(1)
    if not twice:
        return df.join(kept, F.col(id_col).eqNullSafe(F.col(kept_id)), "left_semi")
    # ids are not unique: rows are told apart by their text, and of equal ones one stays
    digest = F.coalesce(F.sha2(text, 256), F.lit(""))
    marked = df.withColumn(of_row, digest)
    of_text = map_arrow(
        marked.select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.col(of_row).alias("d")), lambda b: run(b) | {"d": b.column("d")}, f"id {id_type}, node long, leads array<long>, c0 long, c1 long, shingles binary, few array<long>, d string"
    ).select("id", "node", F.col("d"))
    best = of_text.join(linked, "node", "left").withColumn("root", F.coalesce("root", "node")).groupBy("root").agg(F.min(F.struct(F.col("id").isNotNull().alias("some"), "id", "d")).alias("low"))
    best = best.select(F.col("low.id").alias(kept_id), F.col("low.d").alias(kept_d))
    return marked.dropDuplicates([id_col, of_row]).join(best, F.col(id_col).eqNullSafe(F.col(kept_id)) & (F.col(of_row) == F.col(kept_d)), "left_semi").drop(of_row)


def near_duplicates(df: DataFrame, words: int = 3, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id_col, fp, component_id`` for each row of ``df``.

    ``fp`` is the fingerprint as a long, ``component_id`` the smallest id that links of
    at most three differing bits reach. Null and empty texts have no words and
    fingerprint zero; whole texts are read, however long; repeated rows and equal texts are linked to each other; a null id is kept and is never
    a component's id unless all of them are null; other columns are not read; an empty table gives no rows.
    """
    id_type = dict(df.dtypes)[id_col]
    rows = map_arrow(
        df.select(F.col(id_col).alias("id"), F.col(text).alias("text")),
        lambda b: {"id": b.column("id"), "fp": text_fingerprints(raw_texts(b, "text"), words).view(np.int64)},
        f"id {id_type}, fp long",
    )
    rows, _ = written(rows, "fingerprints")
    distinct, _ = written(rows.groupBy("fp").agg(F.min("id").alias("low"), F.count("*").alias("n")), "distinct-fingerprints")
    linked = components(near_links(distinct.select("fp")), "gray")
    roots = distinct.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    low = roots.groupBy("root").agg(F.min("low").alias("component_id"))
    of_fp, _ = written(roots.select("fp", "n", "root").join(low, "root").select("fp", "n", "component_id"), "components")
    return join_heavy(rows, of_fp, "fp", "n").select(F.col("id").alias(id_col), "fp", "component_id")
