"""Licence scan: normalised text against licence templates by Dice over word bigrams.

Column expressions only, and no shuffle. Units are lines, blocks of lines, the
whole text, and windows of it: as many words as a template has, laid so that one of its
longest words stands where the template has it, whatever line ends and words are around.
A template is compared only with units whose number of bigrams lets
the Dice coefficient reach the threshold, and a text only if it has one of the
cue words: those are chosen so that no unit without them can share enough
bigrams with any template, so the short cut loses nothing.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

#: Paragraphs that several texts share.
_MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'
_ISC = 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.'
_BSD = 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.'
_BSD_DISCLAIMER = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
#: The GNU licences by id, with how their notices name them, the version, and the marks that their standard headers have.
_GNU = (
    ("gpl-2.0", "program", "General Public License", "2", ";", ";"),
    ("gpl-3.0", "program", "General Public License", "3", ":", ","),
    ("lgpl-2.0", "library", "Library General Public License", "2", ";", ";"),
    ("lgpl-2.1", "library", "Lesser General Public License", "2.1", ";", ";"),
    ("lgpl-3.0", "program", "Lesser General Public License", "3", ":", ","),
    ("agpl-3.0", "program", "Affero General Public License", "3", ":", ","),
)
_GNU_NOTICES = tuple(
    (name, text)
    for name, what, title, version, a, b in _GNU
    for text in (
        f"This work is licensed under the GNU {title}, version {version}.",
        f"This {what} is free software{a} you can redistribute it and/or modify it under the terms of the GNU {title} as published by the Free Software Foundation{b} either version {version} of the License, or (at your option) any later version.",
        f"This {what} is free software{a} you can redistribute it and/or modify it under the terms of the GNU {title} version {version} as published by the Free Software Foundation.",
    )
)
#: The Creative Commons licences by code and name, and the versions with what follows their number in a deed.
_CC = (("by", "Attribution"), ("by-sa", "Attribution-ShareAlike"), ("by-nd", "Attribution-NoDerivatives"), ("by-nc", "Attribution-NonCommercial"), ("by-nc-sa", "Attribution-NonCommercial-ShareAlike"), ("by-nc-nd", "Attribution-NonCommercial-NoDerivatives"))
_CC_VERSIONS = (("4.0", "International"), ("3.0", "Unported"))
_CC_NOTICES = tuple(
    (f"cc-{code}-{version}", text)
    for code, title in _CC
    for version, reach in _CC_VERSIONS
    for text in (f"Licensed under CC {code.upper()} {version}.", f"This work is licensed under a Creative Commons {title} {version} {reach} License.", f"This work is licensed under the Creative Commons {title} {version} {reach} License. To view a copy of this license, visit http://creativecommons.org/licenses/{code}/{version}/")
)
#: Notices and texts by licence id.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("mit", _MIT),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("isc", _ISC),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    *_GNU_NOTICES,
    *_CC_NOTICES,
    # complete texts; for the longer licences (apache, gpl, lgpl, agpl, mpl, cc) the notices above, as files carry them
    ("mit", _MIT + " " + 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("isc", _ISC + " " + 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("bsd-2-clause", _BSD + " " + _BSD_DISCLAIMER),
    ("bsd-3-clause", _BSD + " " + '3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.' + " " + _BSD_DISCLAIMER),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("unlicense", "This is free and unencumbered software released into the public domain. " + 'Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.'),
)

#: How a licence bears on training: the strictest of a text's licences counts.
CLASSES = {"apache-2.0": 1, "mit": 1, "isc": 1, "bsd-2-clause": 1, "bsd-3-clause": 1, "zlib": 1, "unlicense": 1, "mpl-2.0": 2, "lgpl-2.0": 2, "lgpl-2.1": 2, "lgpl-3.0": 2, "gpl-2.0": 3, "gpl-3.0": 3, "agpl-3.0": 3}
CLASSES |= {f"cc-{code}-{version}": 5 if "nd" in code else 4 if "nc" in code else 2 if "sa" in code else 1 for code, _ in _CC for version, _ in _CC_VERSIONS}
CLASS_NAMES = ("none", "permissive", "weak copyleft", "copyleft", "non-commercial", "no derivatives")


def words_of(text: str) -> list[str]:
    return re.sub(r"[^a-z0-9\n]+", " ", text.lower()).split()


def bigrams_of(text: str) -> list[str]:
    ws = words_of(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(ws, ws[1:])))


#: Words that tell a licence from its siblings.
DECIDING = {"lesser", "affero", "sharealike", "noderivatives", "noncommercial", "nc", "sa", "nd"}


def decides(bigram: str) -> bool:
    return bool(set(bigram.split()) & DECIDING) or bigram in ("gnu library", "library general")


def needs_of(text: str) -> list[str]:
    """The bigrams of a template without which no unit matches it, however alike: those that decide, and version numbers."""
    pairs = [(g, *g.split()) for g in bigrams_of(text)]
    return [g for g, a, b in pairs if decides(g) or b.isdigit() and (a in ("version", "v") or a.isdigit())]


def deciding() -> list[str]:
    """All bigrams of templates that decide. A unit matches a template only if it has the same ones."""
    return sorted({g for _, text in TEMPLATES for g in bigrams_of(text) if decides(g)})


def bounds(n: int, t: float = THRESHOLD) -> tuple[int, int]:
    """Fewest and most bigrams of a unit that can reach ``t`` with a template of ``n``: 2 min(a, n) / (a + n) >= t."""
    fits = [a for a in range(1, int(n * (2 - t) / t) + 2) if 2 * min(a, n) / (a + n) >= t]
    return fits[0], fits[-1]


def cues(t: float = THRESHOLD) -> list[str]:
    """Words, longest first, until no template has enough bigrams without any of them to reach ``t``."""
    chosen: set[str] = set()
    for _, text in TEMPLATES:
        grams = bigrams_of(text)
        low = bounds(len(grams), t)[0]
        while sum(not chosen & set(g.split()) for g in grams) >= t * (low + len(grams)) / 2:
            chosen.add(max((w for g in grams for w in g.split() if w not in chosen), key=lambda w: (len(w), w)))
    return sorted(chosen)


#: Words of a template by which windows are laid.
ANCHORS = 2


def cue_spots() -> list[tuple[str, int, int]]:
    """The longest words of each template, each with how many words stand before it there and how many the template has."""
    out = set()
    for _, text in TEMPLATES:
        ws = words_of(text)
        for w in sorted(set(ws), key=lambda w: (-len(w), w))[:ANCHORS]:
            out.add((w, ws.index(w), len(ws)))
    return sorted(out)


#: Words that are cut off at once to lay windows in; no template is longer.
WIDE = 256


def _tree(words: list[str]) -> str:
    """A pattern for any of the words that reads each common beginning once."""
    heads: dict[str, list[str]] = {}
    for w in words:
        heads.setdefault(w[:1], []).append(w[1:])
    ways = [h + (_tree(rest) if h else "") for h, rest in sorted(heads.items(), reverse=True)]
    return ways[0] if len(ways) == 1 else "(?:" + "|".join(ways) + ")"


def any_word(words: list[str]) -> str:
    """A pattern for texts, in lower case, that have one of the words between others than a-z and 0-9."""
    return f"(?<![a-z0-9]){_tree(sorted(set(words)))}(?![a-z0-9])"


def normalised(text: Column) -> Column:
    """Lower case; anything but a-z, 0-9 and line ends becomes one space (single spaces are left as they are)."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9\n]{2,}|[^a-z0-9\n ]", " ")


def _windows(chunks: Column) -> Column:
    """Words around each anchor, one window for each place that a template has it at.

    A chunk is read with its two neighbours, so a text of any length costs three readings.
    """
    spots: dict[str, list[Column]] = {}
    for w, k, n in cue_spots():
        spots.setdefault(w, []).append(F.struct(F.lit(k).alias("before"), F.lit(n).alias("n")))
    assert max(n for _, _, n in cue_spots()) <= WIDE
    spots_of = F.create_map(*(x for w, found in spots.items() for x in (F.lit(w), F.array(*found))))
    beside = lambda i: F.coalesce(F.get(chunks, i), F.lit(""))

    def around(c: Column, i: Column) -> Column:
        words = F.split(F.rtrim(F.concat(beside(i - 1), c, beside(i + 1))), " ")
        return F.when(c.rlike(any_word(list(spots))), F.struct(words.alias("words"), F.when(i > 0, WIDE).otherwise(0).alias("begin")))

    def window(x: Column, at: Column, s: Column) -> Column:
        begin = F.greatest(at - s["before"], F.lit(0))
        return F.array_join(F.slice(x["words"], begin + 1, at - s["before"] + s["n"] - begin), " ")

    def laid(x: Column) -> Column:
        at = F.transform(x["words"], lambda w, j: F.when((j >= x["begin"]) & (j < x["begin"] + WIDE) & w.isin(*spots), j))
        at = F.filter(at, lambda j: j.isNotNull())
        return F.flatten(F.transform(at, lambda j: F.transform(spots_of[F.get(x["words"], j)], lambda s: window(x, j, s))))

    return F.flatten(F.transform(F.filter(F.transform(chunks, around), lambda x: x.isNotNull()), laid))


def scan(df: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id_col, n_matches, licenses, best_dice, class`` for each row.

    A template with a version or a word that decides between siblings (``needs_of``) matches no unit without it, nor one with another sibling's.
    ``licenses`` lists the ids that a unit matches, sorted and comma-joined (none: empty,
    with class ``none`` and ``best_dice`` 0); ``n_matches`` counts pairs of a distinct unit and
    a template that is its nearest (ties: all), windows that lie a word apart each. A null text counts as empty; null ids are kept, repeated rows each get a row, an
    empty table gives none; whole texts are read whatever their length; other columns are not read, whatever their names.
    """
    grams = [(name, bigrams_of(x), needs_of(x)) for name, x in TEMPLATES]
    low, high = min(bounds(len(g), threshold)[0] for _, g, _ in grams), max(bounds(len(g), threshold)[1] for _, g, _ in grams)
    cue = any_word(cues(threshold))
    one_line = lambda u: F.trim(F.regexp_replace(u, r"[ \n]{2,}|\n", " "))
    # all columns are null, and cost nothing, in a text without a cue word
    rows = df.select(F.col(id_col).alias("id"), F.when(F.lower(F.col(text)).rlike(cue), normalised(F.col(text))).alias("norm"))
    rows = rows.withColumn("chunks", F.regexp_extract_all(one_line(F.col("norm")), F.lit(f"(?:[^ ]++ ?){{1,{WIDE}}}"), 0))
    whole = F.transform(F.concat(F.split("norm", r"\n"), F.split("norm", r"\n *\n"), F.array("norm")), one_line)
    units = F.when(F.col("norm").isNotNull(), F.array_distinct(F.concat(whole, _windows(F.col("chunks")))))
    words = F.filter(F.transform(F.filter(units, lambda u: u.rlike(cue)), lambda u: F.split(u, " ")), lambda w: F.size(w) > low)
    pairs = F.transform(words, lambda w: F.array_distinct(F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat(a, F.lit(" "), b))))
    pairs = F.filter(pairs, lambda g: (F.size(g) >= low) & (F.size(g) <= high))

    marks = F.array(*map(F.lit, deciding()))

    def against(unit: Column) -> Column:
        g, found = unit["g"], []
        for name, own, needs in grams:
            a, b = bounds(len(own), threshold)
            dice = 2 * F.size(F.array_intersect(g, F.array(*map(F.lit, own)))) / (F.size(g) + len(own))
            fits = F.size(g).between(a, b) & (unit["n_marks"] == sum(map(decides, own)))
            for need in needs:
                fits = fits & F.array_contains(g, need)
            found.append(F.struct(F.lit(name).alias("name"), F.when(fits, dice).otherwise(0.0).alias("dice")))
        return F.array(*found)

    best = lambda found: F.filter(found, lambda x: (x["dice"] >= threshold) & (x["dice"] == F.aggregate(found, F.lit(0.0), lambda s, y: F.greatest(s, y["dice"]))))
    pairs = F.transform(pairs, lambda g: F.struct(g.alias("g"), F.size(F.array_intersect(g, marks)).alias("n_marks")))
    rows = rows.select("id", F.transform(pairs, against).alias("found"))
    rows = rows.select("id", F.coalesce(F.flatten(F.transform("found", best)), F.expr("cast(array() as array<struct<name: string, dice: double>>)")).alias("found"))
    strict = F.create_map(*(x for k, v in CLASSES.items() for x in (F.lit(k), F.lit(v))))
    worst = F.aggregate("found", F.lit(0), lambda s, x: F.greatest(s, strict[x["name"]]))
    return rows.select(
        F.col("id").alias(id_col),
        F.size("found").cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda x: x["name"]))), ",").alias("licenses"),
        F.aggregate("found", F.lit(0.0), lambda s, x: F.greatest(s, x["dice"])).alias("best_dice"),
        F.get(F.array(*map(F.lit, CLASS_NAMES)), worst).alias("class"),
    )
