"""Pre-tokens of byte-level BPE, found for whole batches at once in numpy.

The pattern that the vocabularies of this kind split texts by is
``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``. It says: a text falls into runs
of letters, numbers, white space and the rest; a space goes with the run that follows it; of white space before
anything else the last character stands apart; and some endings after an apostrophe are pre-tokens of their own.
Each of these rules is one step over arrays here.
"""

from __future__ import annotations

import sys
import unicodedata

import numpy as np

SPACE, LETTER, NUMBER, OTHER, UNKNOWN = range(5)
#: The code points that are white space to the pattern.
WHITE = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: Pre-tokens of up to so many bytes are told by two words, exactly; the length stands in the top byte.
SHORT = 15
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def class_table() -> np.ndarray:
    """The class of every code point; ``UNKNOWN`` where Unicode's versions may differ, as it was not assigned yet."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((UNKNOWN if (c := unicodedata.category(chr(k))) in ("Cn", "Cs") else kinds.get(c[0], OTHER) for k in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    table[list(WHITE)] = SPACE
    return table


def starts(ch: np.ndarray, cls: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where pre-tokens start in the code points ``ch`` of texts laid end to end, ``first`` being where each of them that is not empty starts."""
    n = len(ch)
    if not n:
        return np.empty(0, np.int64)
    begins = np.zeros(n, bool)
    begins[first] = True
    run = np.flatnonzero(np.concatenate(([True], cls[1:] != cls[:-1])) | begins)
    end = np.append(run[1:], n)
    at = np.zeros(n + 1, bool)
    at[run] = True
    # White space before something else in its text: its last character starts a pre-token, which goes on if it is a space.
    b = end[(cls[run] == SPACE) & (end < n)]
    b = b[~begins[b]]
    at[b - 1] = True
    at[b[ch[b - 1] == 0x20]] = False
    # An apostrophe by itself that starts a pre-token, and the letters that it takes.
    q = run[(ch[run] == 0x27) & (end - run == 1) & (end < n)]
    q = q[at[q] & (cls[q + 1] == LETTER) & ~begins[q + 1]]
    c1 = ch[q + 1]
    c2 = np.where((q + 2 < n) & ~begins[np.minimum(q + 2, n - 1)], ch[np.minimum(q + 2, n - 1)], 0)
    one = np.isin(c1, [ord(c) for c in "stmd"])
    two = ((c1 == ord("r")) | (c1 == ord("v"))) & (c2 == ord("e")) | (c1 == ord("l")) & (c2 == ord("l"))
    q, length = q[one | two], np.where(two, 3, 2)[one | two]
    at[q + 1] = False
    at[q + length] = True
    return np.flatnonzero(at[:n])


def split(texts: list[str], table: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The bytes of ``texts`` laid end to end, where their pre-tokens start in them, and how many each text has."""
    whole = "".join(texts)
    data = whole.encode()
    if len(data) == len(whole):
        ch, at = np.frombuffer(data, np.uint8), None
    else:
        ch = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        at = np.concatenate(([0], np.cumsum(1 + (ch > 0x7F) + (ch > 0x7FF) + (ch > 0xFFFF), dtype=np.int64)))
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.cumsum(sizes) - sizes
    found = starts(ch, table[ch], begin[sizes > 0])
    upto = np.searchsorted(found, begin + sizes)
    return data, found if at is None else at[found], upto - np.searchsorted(found, begin)


def short_keys(data: bytes, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two words that tell each pre-token of up to ``SHORT`` bytes exactly (of longer ones they tell nothing), and lengths in bytes."""
    size = np.diff(np.append(start, len(data)))
    padded = np.ndarray((len(data) + 8,), "<u8", data + bytes(16), 0, (1,))  # the eight bytes from each place on
    low = padded[start] & _MASKS[np.minimum(size, 8)]
    high = padded[np.minimum(start + 8, len(data))] & _MASKS[np.clip(size - 8, 0, 7)]
    return low, high | np.minimum(size, 255).astype(np.uint64) << np.uint64(56), size


def mix(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """One well-mixed word of two."""
    h = low * np.uint64(0x9E3779B97F4A7C15) ^ high * np.uint64(0xC2B2AE3D27D4EB4F)
    h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(32)


def key_bytes(low: int, high: int) -> bytes:
    """The pre-token that two words tell."""
    return (low.to_bytes(8, "little") + high.to_bytes(8, "little"))[: high >> 56]


class Table:
    """A hash table of short pre-tokens with open addressing; it takes 17 bytes a slot, and at most half the slots are taken."""

    def __init__(self, low: np.ndarray, high: np.ndarray, value: np.ndarray) -> None:
        n = 1 << max(4, int(2 * len(low)).bit_length())
        self.mask, self.low, self.high, self.value = n - 1, np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.zeros(n, np.uint8)
        for k, slot in enumerate((mix(low, high) & np.uint64(self.mask)).astype(np.int64).tolist()):
            while self.high[slot]:
                slot = slot + 1 & self.mask
            self.low[slot], self.high[slot], self.value[slot] = low[k], high[k], value[k]

    def get(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Values of keys, 0 for those that are not there."""
        out = np.zeros(len(low), np.uint8)
        left = np.arange(len(low))
        slot = (mix(low, high) & np.uint64(self.mask)).astype(np.int64)
        while len(left):
            there = self.high[slot]
            same = (there == high[left]) & (self.low[slot] == low[left])
            out[left[same]] = self.value[slot[same]]
            go_on = ~same & (there != 0)
            left, slot = left[go_on], slot[go_on] + 1 & self.mask
        return out
