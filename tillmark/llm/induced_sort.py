"""External recursive induced suffix sorting with common-prefix values.

The string is many texts, each closed by the symbol 0; no comparison passes a 0.
Suffixes are S or L by whether they are smaller or larger than their successor.
The leftmost S suffixes are sorted first: their substrings are named, and the
string of names, at most half as long, is sorted by the same routine in turn,
until all names differ. Prefix lengths come back up with it: so many equal names
are so many symbols, and one substring is compared beyond them. From the leftmost
S suffixes the L suffixes are induced in ascending order, and from those the S
suffixes in descending order.

What is induced waits in a priority queue on disk, ordered by first symbol and then
by when it was put in, which is the order of its remainder. Symbols share a
queue where they are rare: names are many. A tuple is a symbol, a position and the length of the prefix
that it has in common with the entry before it of the same symbol; that is one more
than the least such length among the suffixes scanned between the two that induced
them.

The string, the order, the prefix lengths and what there is for each name are files
mapped into memory, and work is on blocks. The files are scratch of one task: a
task that runs again makes its own.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np

CAP = 255
BLOCK = 1 << 18
BUFFER = 1 << 21  # entries that the queues hold in memory
RANGE = 1 << 12  # entries of symbols that share a queue
#: Bytes up to which an array is held in memory.
IN_MEMORY = 32 << 20
_FAR = np.iinfo(np.int64).max
_RECORD = np.dtype([("symbol", "<i8"), ("pos", "<i8"), ("lcp", "u1")])


def new_map(folder: str, name: str, n: int, dtype) -> np.ndarray:
    """An array of ``n`` in a file of ``folder``; small ones stay in memory."""
    if n * np.dtype(dtype).itemsize <= IN_MEMORY:
        return np.zeros(n, dtype)
    return np.memmap(os.path.join(folder, name), dtype, "w+", shape=(n,))


def _places(n: int):
    """Type of a place among ``n``."""
    return np.int32 if n < 1 << 31 else np.int64


class DiskQueues:
    """Priority queues of (symbol, position, prefix length), one for each range of symbols, in order of arrival."""

    def __init__(self, folder: str, tag: str, ranges: int, buffer: int = BUFFER) -> None:
        self.folder, self.tag, self.buffer, self.held = folder, tag, buffer, 0
        self.waiting: dict[int, list[tuple[np.ndarray, ...]]] = {}
        self.on_disk = np.zeros(ranges, np.int64)

    def _path(self, r: int) -> str:
        return os.path.join(self.folder, f"{self.tag}{r}")

    def push(self, r: int, *entries: np.ndarray) -> None:
        self.waiting.setdefault(r, []).append(entries)
        self.held += len(entries[0])
        if self.held > self.buffer:
            for d, parts in self.waiting.items():
                with open(self._path(d), "ab") as f:
                    for part in parts:
                        out = np.empty(len(part[0]), _RECORD)
                        out["symbol"], out["pos"], out["lcp"] = part
                        f.write(out.tobytes())
                        self.on_disk[d] += len(out)
            self.waiting, self.held = {}, 0

    def pop(self, r: int, block: int) -> Iterator[tuple[np.ndarray, ...]]:
        """All that waits in ``r``, in blocks; what is pushed meanwhile is for the next call."""
        n, self.on_disk[r] = int(self.on_disk[r]), 0
        waiting = self.waiting.pop(r, [])
        self.held -= sum(len(x[0]) for x in waiting)
        if n:
            now = self._path(r) + "-now"
            os.replace(self._path(r), now)
            for at in range(0, n, block):
                got = np.fromfile(now, _RECORD, min(block, n - at), offset=at * _RECORD.itemsize)
                yield got["symbol"].copy(), got["pos"].copy(), got["lcp"].copy()
            os.remove(now)
        if waiting:
            whole = [np.concatenate(x) for x in zip(*waiting, strict=True)]
            for at in range(0, len(whole[0]), block):
                yield tuple(x[at : at + block] for x in whole)

    def __getitem__(self, r: int) -> bool:
        return bool(self.on_disk[r] or r in self.waiting)


class _Minima:
    """Least value of any range of one block of bytes."""

    def __init__(self, a: np.ndarray) -> None:
        self.rows = [a]
        k = 1
        while 2 * k <= len(a):
            top = self.rows[-1]
            self.rows.append(np.minimum(top[:-k], top[k:]))
            k *= 2

    def least(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Minimum of ``a[lo:hi]`` for each pair; ranges are not empty."""
        level = np.frexp(hi - lo)[1] - 1
        out = np.empty(len(lo), np.uint8)
        for k in np.unique(level):
            some = np.flatnonzero(level == k)
            row = self.rows[k]
            out[some] = np.minimum(row[lo[some]], row[hi[some] - (1 << int(k))])
        return out


class _Lengths:
    """Prefix lengths of what scanned suffixes induce."""

    def __init__(self, last: np.ndarray) -> None:
        self.last = last  # number of the suffix, counted as scanned from 1, that last induced each symbol
        self.below = np.zeros(CAP + 1, np.int64)  # number of the last one scanned with a length of at most each value
        self.seen = 0

    def of(self, c: np.ndarray, j: np.ndarray, lcp: np.ndarray) -> np.ndarray:
        """For the suffixes ``j`` of a block, sorted by the symbol ``c`` that they induce; ``lcp`` is of each of the block with the one before."""
        least = np.empty(len(j), np.uint8)
        if len(j):
            first = np.concatenate(([True], c[1:] != c[:-1]))
            starts = np.flatnonzero(first)
            before = self.last[c[starts]]
            so_far = np.minimum.accumulate(lcp)
            since = np.minimum(np.searchsorted(self.below, before, side="right"), CAP).astype(np.uint8)
            least[starts] = np.minimum(since, so_far[j[starts]])
            rest = np.flatnonzero(~first)
            if len(rest):
                least[rest] = _Minima(lcp).least(j[rest - 1] + 1, j[rest] + 1)
            least = np.minimum(least, CAP - 1) + np.uint8(1)
            least[starts[before == 0]] = 0
            self.last[c[starts]] = self.seen + 1 + j[np.append(starts[1:], len(j)) - 1]
        back = np.minimum.accumulate(lcp[::-1]).astype(np.int16)
        at = np.searchsorted(-back, -np.arange(CAP + 1, dtype=np.int16))
        found = at < len(lcp)
        self.below[found] = self.seen + len(lcp) - at[found]
        self.seen += len(lcp)
        return least


def types_of(s: np.ndarray, folder: str, block: int) -> np.ndarray:
    """True for S suffixes, from the right in blocks; a 0 is S."""
    n = len(s)
    out = new_map(folder, "types", n, bool)
    following, following_s = 0, True  # symbol and type after the block; the last symbol is a 0
    for lo in range((n - 1) // block * block, -1, -block):
        x = np.append(s[lo : lo + block].astype(np.int64), following)
        d = np.diff(x)
        kind = np.where(d > 0, 1, np.where(d < 0, 0, -1)).astype(np.int8)
        kind[x[:-1] == 0] = 1
        # equal neighbours: the type of the next that differs
        known = np.flatnonzero(kind >= 0)
        nearest = np.searchsorted(known, np.arange(len(kind)))
        values = np.append(kind[known], np.int8(following_s))
        t = values[nearest] == 1
        out[lo : lo + block] = t
        following, following_s = int(x[0]), bool(t[0])
    return out


def common_prefix(s: np.ndarray, a: np.ndarray, b: np.ndarray, known: np.ndarray | int = 0) -> np.ndarray:
    """Length (``CAP`` at most) of the common prefix of suffixes ``a`` and ``b``, of which ``known`` symbols agree; a 0 equals nothing."""
    out = np.minimum(np.zeros(len(a), np.int64) + known, CAP)
    live = np.flatnonzero(out < CAP)
    while len(live):
        x, y = s[a[live] + out[live]], s[b[live] + out[live]]
        live = live[(x == y) & (x > 0)]
        out[live] += 1
        live = live[out[live] < CAP]
    return out.astype(np.uint8)


def disk_order(key: np.ndarray, folder: str, chunk: int = 1 << 22) -> np.ndarray:
    """Positions of ``key`` in ascending order; beyond ``chunk`` by sorted runs that are merged between sampled splitters."""
    n = len(key)
    if n <= chunk:
        return np.argsort(key, kind="stable")
    runs, sample = [], []
    keys, at = new_map(folder, "run-keys", n, np.int64), new_map(folder, "run-at", n, np.int64)
    for lo in range(0, n, chunk):
        k = np.asarray(key[lo : lo + chunk])
        o = np.argsort(k, kind="stable")
        keys[lo : lo + len(k)], at[lo : lo + len(k)] = k[o], o + lo
        runs.append((lo, lo + len(k)))
        sample.append(k[o[:: max(1, len(k) // 256)]])
    splits = np.unique(np.sort(np.concatenate(sample))[:: max(1, 256 // 2)])
    out, done = new_map(folder, "run-order", n, np.int64), 0
    edges = [np.concatenate(([lo], lo + np.searchsorted(keys[lo:hi], splits), [hi])) for lo, hi in runs]
    for part in range(len(splits) + 1):
        k = np.concatenate([keys[e[part] : e[part + 1]] for e in edges])
        p = np.concatenate([at[e[part] : e[part + 1]] for e in edges])
        out[done : done + len(p)] = p[np.argsort(k, kind="stable")]
        done += len(p)
    return out


def _starts(key: np.ndarray) -> np.ndarray:
    """For each entry of a sorted array the place of the first that equals it."""
    new = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.empty(0, bool)
    return np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))


def name_stars(s: np.ndarray, types: np.ndarray, star: np.ndarray, alphabet: int, folder: str, block: int) -> np.ndarray:
    """Of each substring from one leftmost S position to the next the number of those that are smaller; zeros come first and all count as equal."""
    n, m = len(s), len(star)
    bits = int(2 * alphabet).bit_length()
    width = max(1, 62 // bits)  # symbols, with their types, that one word takes
    name = new_map(folder, "name", m, _places(m))
    open_ = np.arange(m)  # those whose name may still be refined
    k = 0
    while len(open_):
        word, longer = new_map(folder, "word", len(open_), np.int64), np.zeros(len(open_), bool)
        for lo in range(0, len(open_), block):
            at = open_[lo : lo + block]
            p = star[at]
            left = np.where(s[p] == 0, 1, np.append(star, n)[at + 1] - p + 1) - k  # with the first of the next; a 0 stands alone
            w = np.zeros(len(p), np.int64)
            for j in range(width):
                q = np.minimum(p + k + j, n - 1)
                w = (w << bits) | np.where(j < left, s[q].astype(np.int64) * 2 + types[q], 0)
            word[lo : lo + block] = w
            longer[lo : lo + block] = left > width
        order = disk_order(word, folder)
        ranks = np.empty(len(open_), np.int64)
        ranks[order] = _starts(word[order])
        joint = name[open_].astype(np.int64) * (len(open_) + 1) + ranks
        order = disk_order(joint, folder)
        old, both = _starts(name[open_][order]), _starts(joint[order])
        name[open_[order]] += both - old
        # a group of equal names stays open as long as one of its substrings goes on
        edge = np.unique(both)
        size = np.diff(np.append(edge, len(open_)))
        on = np.maximum.reduceat(longer[order].astype(np.int8), edge) > 0
        open_ = np.sort(open_[order][np.repeat((size > 1) & on, size)])
        k += width
    return name


def sort_stars(s: np.ndarray, types: np.ndarray, folder: str, block: int, buffer: int, alphabet: int) -> tuple[np.ndarray, np.ndarray]:
    """Leftmost S positions in the order of their suffixes, 0s first and in text order, and their prefix lengths with the one before."""
    parts = []
    for lo in range(0, len(s), block):
        t = types[lo - 1 : lo + block] if lo else np.append([True], types[:block])  # with the one before
        parts.append(np.flatnonzero((t[1:] & ~t[:-1]) | (s[lo : lo + block] == 0)) + lo)
    m = sum(map(len, parts))
    star, at = new_map(folder, "star", m, _places(len(s))), 0
    for p in parts:
        star[at : at + len(p)] = p
        at += len(p)
    del parts
    name = name_stars(s, types, star, alphabet, folder, block)
    order = disk_order(name, folder)
    zeros = int(np.searchsorted(name[order], 1)) if m else 0  # all zeros have the name 0
    firsts = _starts(name[order])[zeros:]
    distinct = len(np.unique(firsts))
    out, lcp = new_map(folder, "stars", m, _places(len(s))), new_map(folder, "star-lcp", m, np.uint8)
    out[:zeros] = star[np.sort(order[:zeros])]
    if distinct == m - zeros:
        own, same, below = order[zeros:], np.zeros(m - zeros, np.int64), None
    else:  # the string of names: sorted in turn, and its prefix lengths carried up
        below = tempfile.mkdtemp(prefix="names-", dir=folder)
        names = new_map(below, "string", m, _places(m))
        names[order[zeros:]] = 1 + np.cumsum(np.concatenate(([0], np.diff(firsts) != 0)))
        own, same = suffix_order(names, below, block, buffer, distinct + 1)
        del names
    for lo in range(0, m - zeros, block):
        b = own[lo : lo + block]
        b = b.astype(np.int64)
        a = np.append(own[lo - 1] if lo else b[0], b[:-1])
        k = same[lo : lo + block].astype(np.int64)
        got = common_prefix(s, star[a], star[b], star[b + k].astype(np.int64) - star[b])
        if lo == 0:
            got[:1] = 0
        out[zeros + lo : zeros + lo + len(b)], lcp[zeros + lo : zeros + lo + len(b)] = star[b], got
    if below:
        shutil.rmtree(below)  # what is still mapped goes with its last reader
    for name_ in ("star", "name", "word"):
        if os.path.exists(os.path.join(folder, name_)):
            os.remove(os.path.join(folder, name_))
    return out, lcp


class _Pass:
    """One pass of induction: up from leftmost S suffixes to L ones, or down from L ones to S ones, where symbols count backwards."""

    def __init__(self, s: np.ndarray, alphabet: int, counts: np.ndarray, static_counts: np.ndarray, folder: str, up: bool, block: int, buffer: int) -> None:
        self.s, self.alphabet, self.up, self.block = s, alphabet, up, block
        tag = "up" if up else "down"
        self.static_at = new_map(folder, f"{tag}-static", alphabet + 1, np.int64)
        np.cumsum(static_counts, out=self.static_at[1:])
        both = np.cumsum(counts + static_counts) // RANGE
        alone = np.flatnonzero(counts + static_counts > RANGE)
        self.edges = np.unique(np.concatenate(([0, alphabet], np.flatnonzero(np.diff(both)) + 1, alone, alone + 1)))
        self.queues = DiskQueues(folder, tag, len(self.edges), buffer)
        self.lengths = _Lengths(new_map(folder, f"{tag}-last", alphabet, np.int64))

    def symbols(self, raw: np.ndarray) -> np.ndarray:
        raw = raw.astype(np.int64)
        return raw if self.up else self.alphabet - raw

    def run(self, static, write, seam_at) -> None:
        """``static(i, j)`` gives positions and lengths of what is known, ``write(c, k, pos, lcp)`` puts the ``k``-th of a symbol, ``seam_at(c, lcp)`` hears what the last induced and the first known of a symbol share."""
        for r in range(len(self.edges) - 1):
            lo, hi = int(self.edges[r]), int(self.edges[r + 1])
            if hi - lo == 1:
                self._one(r, lo, static, write, seam_at)
            else:
                self._several(r, lo, hi, static, write, seam_at)

    def _induced(self, pos: np.ndarray, lcp: np.ndarray, before: np.ndarray, take: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What a scanned block induces, by symbol."""
        j = np.flatnonzero(take)
        j = j[np.argsort(before[j], kind="stable")]
        c = before[j]
        return c, pos[j] - 1, self.lengths.of(c, j, lcp)

    def _push(self, c: np.ndarray, pos: np.ndarray, lcp: np.ndarray) -> None:
        if len(c):
            r = np.searchsorted(self.edges, c, side="right") - 1
            edge = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
            for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(c)], strict=True):
                self.queues.push(int(r[a]), c[a:b], pos[a:b], lcp[a:b])

    def _one(self, r: int, c: int, static, write, seam_at) -> None:
        """A frequent symbol: its queue and what is known go by in blocks."""
        done, last = 0, None
        while self.queues[r]:
            for _, pos, lcp in self.queues.pop(r, self.block):
                write(np.full(len(pos), c), np.arange(done, done + len(pos)), pos, lcp)
                done += len(pos)
                last = pos[-1:]
                raw = self.s[pos - 1]
                before = self.symbols(raw)
                self._push(*self._induced(pos, lcp, before, (raw > 0) & (before >= c)))
        begin, end = int(self.static_at[c]), int(self.static_at[c + 1])
        for i in range(begin, end, self.block):
            pos, lcp = static(i, min(end, i + self.block))
            pos = pos.astype(np.int64)
            if i == begin:
                lcp[0] = common_prefix(self.s, last, pos[:1])[0] if done and c else 0
                seam_at(np.array([c]), lcp[:1])
            raw = self.s[pos - 1]
            before = self.symbols(raw)
            self._push(*self._induced(pos, lcp, before, (raw > 0) & (before > c)))

    def _several(self, r: int, lo: int, hi: int, static, write, seam_at) -> None:
        """Rare symbols: as many entries at once as cannot come after what they induce."""
        got = list(self.queues.pop(r, self.block))
        c, p, v = (np.concatenate(x) for x in zip(*got, strict=True)) if got else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint8))
        o = np.argsort(c, kind="stable")
        c, p, v = c[o], p[o], v[o]
        sp, sv = static(int(self.static_at[lo]), int(self.static_at[hi]))
        sp = sp.astype(np.int64)
        sc = self.symbols(self.s[sp])
        first = np.concatenate(([True], sc[1:] != sc[:-1])) if len(sc) else np.empty(0, bool)
        i, done, last_c, last_p = 0, np.zeros(hi - lo, np.int64), -1, 0
        while len(p) or i < len(sp):
            key = np.concatenate((2 * c, 2 * sc[i:] + 1))
            o = np.argsort(key, kind="stable")[: self.block]
            key, pos, lcp = key[o], np.concatenate((p, sp[i:]))[o], np.concatenate((v, sv[i:]))[o]
            raw, own, known = self.s[pos - 1], key >> 1, key & 1
            before = self.symbols(raw)
            take = (raw > 0) & (before >= own + known)
            reach = np.minimum.accumulate(np.where(take, 2 * before, _FAR))
            late = np.flatnonzero(reach[:-1] < key[1:])
            n = int(late[0]) + 1 if len(late) else len(key)
            pos, lcp, before, take, own, known = (x[:n] for x in (pos, lcp, before, take, own, known))
            is_known = known == 1
            n_known = int(is_known.sum())
            seam = np.flatnonzero(is_known)[first[i : i + n_known]]
            if len(seam):
                was_c, was_p = np.append(last_c, own[:-1])[seam], np.append(last_p, pos[:-1])[seam]
                lcp[seam] = 0
                joined = np.flatnonzero((was_c == own[seam]) & (own[seam] > 0))
                lcp[seam[joined]] = common_prefix(self.s, was_p[joined], pos[seam[joined]])
                seam_at(own[seam], lcp[seam])
            new = np.flatnonzero(~is_known)
            if len(new):
                at = own[new] - lo
                write(own[new], done[at] + np.arange(len(new)) - _starts(at), pos[new], lcp[new])
                np.add.at(done, at, 1)
            last_c, last_p = int(own[-1]), int(pos[-1])
            ic, ip, iv = self._induced(pos, lcp, before, take)
            here = int(np.searchsorted(ic, hi))
            self._push(ic[here:], ip[here:], iv[here:])
            i += n_known
            c, p, v = (np.concatenate((x[n - n_known :], y[:here])) for x, y in ((c, ic), (p, ip), (v, iv)))
            if here:
                o = np.argsort(c, kind="stable")
                c, p, v = c[o], p[o], v[o]


def suffix_order(s: np.ndarray, folder: str, block: int = BLOCK, buffer: int = BUFFER, alphabet: int = 257) -> tuple[np.ndarray, np.ndarray]:
    """Order of all suffixes of ``s`` that begin with a symbol over 0, and the length (255 at most) that each has in common with the one before.

    ``s`` holds symbols below ``alphabet``, begins and ends with a 0.
    """
    n = len(s)
    types = types_of(s, folder, block)
    large, small = new_map(folder, "large", alphabet, np.int64), new_map(folder, "small", alphabet, np.int64)
    for lo in range(0, n, block):
        x, t = s[lo : lo + block], types[lo : lo + block]
        np.add.at(small, x[t], 1)
        np.add.at(large, x[~t], 1)
    zeros = int(small[0])
    small[0] = 0
    begin = new_map(folder, "begin", alphabet + 1, np.int64)  # of each symbol in the order
    np.cumsum(large + small, out=begin[1:])
    order, lcp = new_map(folder, "order", n - zeros, _places(n)), new_map(folder, "lcp", n - zeros, np.uint8)
    star, star_lcp = sort_stars(s, types, folder, block, buffer, alphabet)
    stars = new_map(folder, "star-counts", alphabet, np.int64)
    for lo in range(0, len(star), block):
        np.add.at(stars, s[star[lo : lo + block]], 1)

    def put_up(c: np.ndarray, k: np.ndarray, pos: np.ndarray, common: np.ndarray) -> None:
        order[begin[c] + k], lcp[begin[c] + k] = pos, common

    up = _Pass(s, alphabet, large, stars, folder, True, block, buffer)
    up.run(lambda i, j: (np.array(star[i:j]), np.array(star_lcp[i:j])), put_up, lambda c, common: None)

    def known_down(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        g = np.arange(i, j)
        c = np.searchsorted(down.static_at, g, side="right") - 1
        at = begin[alphabet - c] + large[alphabet - c] - 1 - (g - down.static_at[c])
        return order[at], lcp[np.minimum(at + 1, len(lcp) - 1)]

    def put_down(c: np.ndarray, k: np.ndarray, pos: np.ndarray, common: np.ndarray) -> None:
        at = begin[alphabet - c + 1] - 1 - k  # descending: a length is with the larger neighbour
        order[at] = pos
        some = k > 0
        lcp[at[some] + 1] = common[some]

    def seam_down(c: np.ndarray, common: np.ndarray) -> None:
        raw = alphabet - c
        some = small[raw] > 0
        lcp[(begin[raw] + large[raw])[some]] = common[some]

    backwards = lambda x: np.append(0, np.asarray(x[1:])[::-1])
    down = _Pass(s, alphabet, backwards(small), backwards(large), folder, False, block, buffer)
    down.run(known_down, put_down, seam_down)
    return order, lcp
