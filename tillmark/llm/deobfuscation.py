"""Noisy channel for obfuscated words: a lattice of what each character may stand for, decoded by Viterbi under a character model.

The likeliest path is exact. It is one reading: where letters set apart follow a word of one letter
("a i d i o t"), the model alone says whether that letter belongs to them, and signs after what
is a word of its own ("a$$") stay signs if that is likelier.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np

#: Symbols of the character model: 0 a boundary, 1 to 26 a-z, the rest other letters by their code point; and how many it looks at at once.
SYMBOLS, ORDER = 32, 4

#: Letters that a character is used for in place of them.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "*": "abcdefghijklmnopqrstuvwxyz",
}
#: Log-probabilities of the channel: a letter or a sign after a word as it is, a digit beside letters as it is, a substitute, a dropped separator, a collapsed run.
AS_IS, DIGIT, SUBSTITUTE, DROP, COLLAPSE, COLLAPSE_TWO = -0.02, -1.2, -1.6, -0.4, -0.7, -6.0
#: Weight of the model of fewer symbols, in symbols seen.
PRIOR = 4.0
#: States at a character in a first search; where it leaves some out, its score bounds a second one that leaves out nothing that could win.
BEAM = 24
#: Characters that are decoded at once; a longer span is cut where its likeliest reading has a space, with so many characters after it known.
LONGEST, AHEAD = 64, 20

#: What may stand between letters set apart.
SEPARATORS = " .-_*/"
_RUN = re.compile(r"(.)\1{3,}", re.S)
_DOUBLE, _GAPS = re.compile(r"[ .\-_*/]{2}"), re.compile(r"[ .\-_*/]+")
_SUSPECT = re.compile(
    # letters and substitutes set apart, two letters among the first
    r"(?<!\w)(?=(?:(?:[^\W_]|[@$!|+])[ .\-_*/]{1,2}){0,3}?[^\W\d_][ .\-_*/]{1,2}(?:(?:[^\W_]|[@$!|+])[ .\-_*/]{1,2}){0,3}?[^\W\d_](?!\w))"
    r"(?:(?:[^\W_]|[@$!|+])[ .\-_*/]{1,2}){2,}(?:[^\W_]|[@$!|+])(?!\w)"
    # substitutes within, before or after the letters of a word, and runs
    r"|(?<![\w@$!|+*])(?=[\w@$!|+*]*[^\W\d_])(?=[\w@$!|+*]*?(?:[^\W\d_][0-9@$!|+*]+[^\W\d_]|(?<![\w@$!|+*])[0-9@$!|+]+[^\W\d_]|[^\W\d_][0-9@$!|+*]+(?![\w@$%&#*!|+])|([^\W\d_])\1\1))[\w@$!|+*]+"
)


def symbols_of(text: str) -> np.ndarray:
    """Symbols of lower-cased text."""
    cp = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return _TABLE[np.minimum(cp, len(_TABLE) - 1)]


_OTHER = 27


def _table() -> np.ndarray:
    out = np.zeros(0x2000, np.int64)
    for cp in range(len(out)):
        if 97 <= cp < 123:
            out[cp] = cp - 96
        elif chr(cp).isalpha() and cp > 127:
            out[cp] = _OTHER + cp % (SYMBOLS - _OTHER)
    return out


_TABLE = _table()


_STATES = SYMBOLS ** (ORDER - 1)


def code_of(symbols: list[int]) -> int:
    """Code of the last symbols, as many as the model looks back on."""
    code = 0
    for d in symbols:
        code = (code * SYMBOLS + d) % _STATES
    return code


class CharModel:
    """Interpolated model of ``ORDER`` symbols, from counts of their codes in base ``SYMBOLS``."""

    def __init__(self, counts: np.ndarray) -> None:
        n = [counts.reshape((SYMBOLS,) * ORDER).astype(np.float64)]
        for _ in range(ORDER - 1):
            n.append(n[-1].sum(0))
        p = (n[-1] + 1) / (n[-1].sum() + SYMBOLS)
        for c in reversed(n[:-1]):
            p = (c + PRIOR * p) / (c.sum(-1, keepdims=True) + PRIOR)
        self.logp = array("f", np.log(p).astype(np.float32).tobytes())  # by the code of ``ORDER`` symbols
        self.seen: dict[str, str] = {}
        self.tails: dict[tuple, str] = {}

    def reading(self, span: str) -> str:
        """What most likely stands behind ``span`` (lower-cased)."""
        if (got := self.seen.get(span)) is not None:
            return got
        if len(self.seen) > 200_000:
            self.seen.clear()
        if len(span) > LONGEST:
            span = _RUN.sub(r"\1\1\1", span)
        if len(span) <= LONGEST:
            out = self.seen[span] = self._viterbi(span)
            return out
        return " ".join(self.reading(x) for x in self._pieces(span))

    def _pieces(self, span: str) -> Iterator[str]:
        """``span`` in pieces of at most ``LONGEST``: cut between words, or overlapping where no end of a word is in sight."""
        at = 0
        while len(span) - at > LONGEST:
            window = span[at : at + LONGEST]
            # double separators first if others are single, else the spaces of the likeliest reading
            ends = [m.start() for m in _DOUBLE.finditer(window, 1, LONGEST - 2)]
            ends = ends if 2 * len(ends) < len(_GAPS.findall(window)) else []
            ends = ends or [k for k, c in enumerate(self._viterbi(window, True)[: LONGEST - AHEAD]) if c == " " and k]
            yield window[: ends[-1]] if ends else window
            at += ends[-1] if ends else LONGEST - AHEAD
            while at < len(span) and span[at] in SEPARATORS:
                at += 1
        if at < len(span):
            yield span[at:]

    def _viterbi(self, o: str, aligned: bool = False) -> str:
        """The likeliest reading of ``o``; an ``aligned`` one is as long as ``o``, filled up with zeros."""
        # letters at the beginning that can only be themselves: what follows depends on the last few
        k = 0
        while k < len(o) - 1 and o[k].isalpha() and o[k + 1] != o[k]:
            k += 1
        known = code_of(symbols_of(o[max(0, k - ORDER + 1) : k]).tolist())
        key = (known, k > 0, aligned, o[k:])
        if (got := self.tails.get(key)) is None:
            if len(self.tails) > 200_000:
                self.tails.clear()
            got = self.tails[key] = self.decoded(*key)[1]
        return o[:k] + got

    def decoded(self, known: int, inner: bool, aligned: bool, o: str) -> tuple[float, str]:
        """Score and text of the likeliest path through the lattice of ``o`` after symbols of the code ``known``; ``inner`` after letters of the same span."""
        score, text, whole = self._search(known, inner, aligned, o, BEAM, -np.inf)
        if not whole:  # no logarithm of a probability is above 0: a state below a path's score cannot lead to a better one
            score, text, _ = self._search(known, inner, aligned, o, None, score - 1e-9)
        return score, text

    def _search(self, known: int, inner: bool, aligned: bool, o: str, beam: int | None, floor: float) -> tuple[float, str, bool]:
        """The best path over the best ``beam`` states at each character, and whether those were all."""
        logp, n, whole = self.logp, len(o), True
        # at each character and for the code of the last symbols: the best reading so far
        at: list[dict[int, tuple[float, str]]] = [{} for _ in range(n + 1)]
        at[0][known] = (0.0, "")
        for i, arcs in enumerate(lattice(o, inner)):
            states = at[i]
            if beam and len(states) > beam:
                states, whole = {s: states[s] for s in sorted(states, key=lambda s: -states[s][0])[:beam]}, False
            if aligned:
                arcs = [(k, letters.ljust(k, "\0"), cost) for k, letters, cost in arcs]
            arcs = [(k, letters, cost, [int(_TABLE[min(ord(c), len(_TABLE) - 1)]) for c in letters if c != "\0"]) for k, letters, cost in arcs]
            for state, (score, text) in states.items():
                for k, letters, cost, symbols in arcs:
                    last, s = state, score + cost
                    for d in symbols:
                        if d or last % SYMBOLS:  # a boundary after a boundary is the same one
                            last = last * SYMBOLS + d
                            s += logp[last]
                            last %= _STATES
                    if s < floor:
                        continue
                    here = at[i + k].get(last)
                    if here is None or s > here[0] or s == here[0] and text + letters < here[1]:
                        at[i + k][last] = (s, text + letters)
        score, text = min(((s + logp[last * SYMBOLS] if last % SYMBOLS else s, t) for last, (s, t) in at[n].items()), key=lambda y: (-y[0], y[1]))
        return score, text, whole


def lattice(o: str, inner: bool = False) -> list[list[tuple[int, str, float]]]:
    """For each character of ``o`` its arcs: how many characters they take, the letters they stand for, and the channel's log-probability."""
    n = len(o)
    # signs before and after all letters may also be signs, if they are several or what ends a sentence
    letters_at = [-1] * inner + [k for k, c in enumerate(o) if c.isalpha()] or [n]
    first, last = letters_at[0], letters_at[-1]
    signs = set(range(first) if first > 1 else ()) | set(range(last + 1, n) if n - last > 2 or o[-1] in "!|+*" else ())
    out = []
    for i, x in enumerate(o):
        r = 1
        while i + r < n and o[i + r] == x:
            r += 1
        arcs = []
        if x.isalpha():
            arcs.append((1, x, AS_IS))
            if r >= 3:
                arcs += [(r, x, COLLAPSE), (r, x + x, COLLAPSE)]
            elif r == 2:
                arcs.append((2, x, COLLAPSE_TWO))
        else:
            arcs += [(k, c, SUBSTITUTE) for c in LEET.get(x, "") for k in sorted({1, r})]
            if i in signs and x not in " .-_/":
                arcs.append((1, x, AS_IS if x in "!|+*" else DIGIT))
            if x in SEPARATORS:
                arcs += [(r, "", DROP), (r, " ", DROP)]
            elif not arcs:
                arcs.append((r, "", 4 * DROP))
        out.append(arcs)
    return out


#: Bits of a character: 1 a letter or digit, 2 a substitute, 4 what may stand beside letters set apart, 8 a separator, 16 a letter.
_CLASS = np.zeros(0x2000, np.uint8)
for _b in range(len(_CLASS)):
    _c = chr(_b)
    _CLASS[_b] = (_c.isalnum() and 1) | (_c in LEET and 2) | ((not _c.isalnum() or _b > 127) and 4) | (_c in SEPARATORS and 8) | ((_c.isalpha() or _b > 127) and 16)
_CLASS[-1] = 1 | 4 | 16  # any character from here on


def suspects(texts: list[str]) -> list[int]:
    """Indexes of the lower-cased texts that may hold a suspicious span; the others hold none (where a class of characters is in doubt, both count)."""
    x = np.frombuffer(("\n\n" + "\n\n".join(texts) + "\n\n\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    k = _CLASS[np.minimum(x, len(_CLASS) - 1)]
    letter, leet, unit, beside, gap = (k & 16) > 0, (k & 2) > 0, (k & 3) > 0, (k & 4) > 0, (k & 8) > 0
    hit = np.zeros(len(x), bool)
    hit[1:] |= leet[1:] & letter[:-1]
    hit[:-1] |= leet[:-1] & letter[1:]
    hit[2:] |= letter[2:] & (x[2:] == x[1:-1]) & (x[1:-1] == x[:-2])
    # two set apart one after the other, a letter among them: every span of that form has such a pair
    alone = np.zeros(len(x), bool)
    alone[1:-1] = unit[1:-1] & beside[:-2] & gap[2:]
    for n in (2, 3):
        hit[:-n] |= alone[:-n] & alone[n:] & (letter[:-n] | letter[n:])
    starts = 2 + np.concatenate(([0], np.cumsum([len(t) + 2 for t in texts])))
    return np.unique(np.searchsorted(starts, np.flatnonzero(hit), side="right") - 1).tolist()


def restore(text: str, model: CharModel) -> str:
    """Lower-cased text with each suspicious span in its likeliest reading."""
    return _SUSPECT.sub(lambda m: model.reading(m.group(0)), text)
