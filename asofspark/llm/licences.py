"""License scans: lines of text against licence notices by the Dice coefficient over word bigrams.

Only DataFrame functions run. A segment is a line; words are its lower-cased runs of letters and digits, a segment's
set is its distinct bigrams of neighbouring words (a line of one word has that word alone). For Dice >= t, with set
sizes a and b, 2 * min(a, b) >= t * (a + b): templates whose size breaks this are not compared.

A notice that is wrapped is found in blocks: runs of two or more neighbouring lines with words (lines without words
between them do not count) that have at most one word more than the greatest set that a template can match. A block
needs t / (2 - t) of its set among the bigrams of all templates, and as a line without a word of the templates at its
start or end only lowers the score, blocks start and end at lines with one. Lines that match alone are part of no block;
of blocks that share lines the best score stays, then the first and the shortest.

Whole licence texts (``TEXTS``) are compared with blocks in the same way, but a document comes into question only if
it has t / (2 - t) of a text's bigrams at all, and a block only if its lines have so many.

The templates are a fixed handful of notices and texts that ride in the plan as literals. Lines and documents stay in
their partition; equal matches of a document are counted by one aggregation on the document's row.

Defined results: null or empty texts, and lines without words, match nothing and give a row with no match; of equal
scores the first template by name wins; repeated rows give repeated results; a very long text is one row; an empty table
gives no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Customary short notices by licence name.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "BSD-2-Clause": "Use of this source code is governed by a BSD 2-Clause license that can be found in the LICENSE file.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
#: Licence texts, and the notices that larger licences ask for, without names and years.
TEXTS = {
    "Apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
        You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and
        limitations under the License.""",
    "BSD-2-Clause-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
        and/or other materials provided with the distribution.
        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
        IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE
        LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE
        GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
        LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH
        DAMAGE.""",
    "GPL-3.0-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
        the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
        This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
        FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
        You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "ISC-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above
        copyright notice and this permission notice appear in all copies.
        THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
        MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
        WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN
        CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "MIT-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
        "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute,
        sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
        FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
        LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN
        THE SOFTWARE.""",
}
THRESHOLD = 0.8


def bigrams(text: str) -> list[str]:
    words = re.findall(r"[^\W_]+", text.lower())
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}) or words[:1]


def _bigram_set(words: Column) -> Column:
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.when(F.size(words) < 2, words).otherwise(F.array_distinct(pairs))


def _let(x: Column, f) -> Column:
    """f of x, which is evaluated once."""
    return F.transform(F.array(x), f)[0]


class _Group:
    """Templates that are compared together: their bigram sets and what follows from their sizes."""

    def __init__(self, templates: dict[str, str], threshold: float):
        self.threshold, self.share = threshold, threshold / (2 - threshold)
        self.sets = {k: bigrams(v) for k, v in sorted(templates.items())}
        self.reach = {k: (self.share * len(b), len(b) / self.share) for k, b in self.sets.items()}
        self.low, self.high = min(lo for lo, _ in self.reach.values()), max(hi for _, hi in self.reach.values())
        self.most = int(self.high) + 1  # words of a block
        self.vocabulary = self.literal({w for b in self.sets.values() for x in b for w in x.split()})
        self.known = self.literal({g for b in self.sets.values() for g in b})

    @staticmethod
    def literal(words) -> Column:
        return F.array(*[F.lit(w) for w in sorted(words)])

    def best(self, s: Column) -> Column:
        """The best template of a segment: struct<dice, licence>."""

        def dice(name: str) -> Column:
            b, (lo, hi) = self.sets[name], self.reach[name]
            score = 2.0 * F.size(F.array_intersect(s["grams"], self.literal(b))) / (F.size(s["grams"]) + len(b))
            return F.when(F.size(s["grams"]).between(lo, hi), F.struct(F.round(score, 6).alias("dice"), F.lit(name).alias("licence")))

        options = F.array_compact(F.array(*[dice(k) for k in self.sets]))
        return F.aggregate(options, F.struct(F.lit(-1.0).alias("dice"), F.lit("").alias("licence")), lambda a, x: F.when(x["dice"] > a["dice"], x).otherwise(a))

    def of_document(self, text: Column) -> Column:
        """Bigrams of the templates in a whole document."""
        return _let(_words(text), lambda w: F.size(F.array_intersect(_bigram_set(w), self.known)))

    def blocks(self, rows: Column) -> Column:
        """rows: array of struct<line, words>. Blocks that match: array of struct<less, line, last, licence>."""
        marked = F.transform(rows, lambda s: F.struct(s["line"].alias("line"), s["words"].alias("words"), F.arrays_overlap(s["words"], self.vocabulary).alias("near")))
        return _let(marked, self._blocks)

    def _from_line(self, r: Column, s: Column, i: Column) -> Column:
        fits = F.aggregate(F.slice(r, i + 1, self.most), F.struct(F.lit(0).alias("n"), F.lit(0).alias("words")), lambda a, x: F.struct((a["n"] + F.when(a["words"] + F.size(x["words"]) <= self.most, 1).otherwise(0)).alias("n"), (a["words"] + F.size(x["words"])).alias("words")))["n"]
        runs = _let(F.when(s["near"], fits).otherwise(0), lambda n: F.when(n >= 2, F.transform(F.sequence(F.lit(2), F.greatest(n, F.lit(2))), lambda k: F.slice(r, i + 1, k))))
        ends = F.filter(F.coalesce(runs, F.slice(F.array(r), 1, 0)), lambda w: F.element_at(w, -1)["near"] & self._enough(w))
        return F.transform(ends, lambda w: F.struct(w[0]["line"].alias("line"), F.element_at(w, -1)["line"].alias("last"), _let(F.flatten(F.transform(w, lambda x: x["words"])), _bigram_set).alias("grams")))

    def _enough(self, block: Column) -> Column:
        return F.lit(True)

    def _blocks(self, r: Column) -> Column:
        sized = F.filter(F.flatten(F.transform(r, lambda s, i: self._from_line(r, s, i))), lambda s: F.size(s["grams"]).between(self.low, self.high))
        likely = F.filter(sized, lambda s: F.size(F.array_intersect(s["grams"], self.known)) >= self.share * F.size(s["grams"]) - 1e-9)
        found = F.transform(likely, lambda s: _let(self.best(s), lambda x: F.struct((-x["dice"]).alias("less"), s["line"].alias("line"), s["last"].alias("last"), x["licence"].alias("licence"))))
        return F.array_sort(F.filter(found, lambda s: s["less"] <= -self.threshold))


class _Texts(_Group):
    """Whole texts: every line first learns how many bigrams of the texts end in it, and a block needs enough of them."""

    def blocks(self, rows: Column) -> Column:
        def mark(r: Column) -> Column:
            def ending(s: Column, i: Column) -> Column:  # the line with the last word before it
                before = F.when(i > 0, F.slice(r[F.greatest(i - 1, F.lit(0))]["words"], -1, 1)).otherwise(F.slice(s["words"], 1, 0))
                return F.size(F.array_intersect(_bigram_set(F.concat(before, s["words"])), self.known))

            counted = F.transform(r, lambda s, i: F.struct(s["line"].alias("line"), s["words"].alias("words"), ending(s, i).alias("hits")))
            return F.transform(counted, lambda s: F.struct(s["line"].alias("line"), s["words"].alias("words"), s["hits"].alias("hits"), F.arrays_overlap(s["words"], self.vocabulary).alias("near")))

        return _let(_let(rows, mark), self._blocks)

    def _enough(self, block: Column) -> Column:
        return F.aggregate(block, F.lit(0), lambda a, x: a + x["hits"]) >= self.low


def _words(line: Column) -> Column:
    return F.filter(F.split(F.lower(line), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _chosen(first: Column, blocks: Column, last: str = "line") -> Column:
    """``first`` (struct<line, last, licence, dice>) and the blocks that share no line with it or with a better block."""
    free = F.filter(blocks, lambda s: ~F.exists(first, lambda x: (x["line"] <= s["last"]) & (s["line"] <= x["last"])))
    kept = F.aggregate(free, F.slice(free, 1, 0), lambda a, x: F.when(F.exists(a, lambda y: (y["line"] <= x["last"]) & (x["line"] <= y["last"])), a).otherwise(F.concat(a, F.array(x))))
    return F.concat(first, F.transform(kept, lambda s: F.struct(s["line"].alias("line"), s["last"].alias("last"), s["licence"].alias("licence"), (-s["less"]).alias("dice"))))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD, texts: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, licences (array of struct<line, licence, dice> of the best template of every
    matching line or block, by its first line), n_lines and n_matches. A whole text goes before the notices in it."""
    short, whole = _Group(templates, threshold), _Texts(TEXTS if texts is None else texts, threshold)
    text = F.col(text_col)

    # size bounds on words first: a line with n words has n - 1 bigrams at most, repeated ones fewer
    numbered = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("line"), _words(x).alias("words")))
    lines = F.filter(numbered, lambda s: (F.size(s["words"]) > 0) & (F.size(s["words"]) >= short.low) & F.arrays_overlap(s["words"], short.vocabulary))
    grams = F.filter(F.transform(lines, lambda s: F.struct(s["line"].alias("line"), _bigram_set(s["words"]).alias("grams"))), lambda s: F.size(s["grams"]).between(short.low, short.high))
    hits = F.filter(F.transform(grams, lambda s: F.struct(s["line"].alias("line"), short.best(s).alias("best"))), lambda s: s["best"]["dice"] >= threshold)
    alone = F.transform(hits, lambda s: F.struct(s["line"].alias("line"), s["line"].alias("last"), s["best"]["licence"].alias("licence"), s["best"]["dice"].alias("dice")))

    rows = F.filter(numbered, lambda s: F.size(s["words"]) > 0)
    # a document with a block that matches has so many bigrams of the templates at least
    of_notices = F.when(short.of_document(text) >= short.low, short.blocks(rows))
    of_texts = F.when(whole.of_document(text) >= whole.low, whole.blocks(rows))
    none = F.array().cast("array<struct<line:int,last:int,licence:string,dice:double>>")

    def merged(x: Column) -> Column:
        long = F.when(F.size(x["texts"]) > 0, _chosen(none, x["texts"])).otherwise(none)
        outside = _let(long, lambda t: F.concat(t, F.filter(x["alone"], lambda s: ~F.exists(t, lambda y: s["line"].between(y["line"], y["last"])))))
        return F.when(F.size(x["blocks"]) > 0, _let(outside, lambda f: _chosen(f, x["blocks"]))).otherwise(outside)

    matches = _let(F.struct(alone.alias("alone"), of_notices.alias("blocks"), of_texts.alias("texts")), merged)
    matches = F.transform(F.array_sort(matches), lambda s: F.struct(s["line"].alias("line"), s["licence"].alias("licence"), s["dice"].alias("dice")))
    out = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.size(F.split(text, "\n")), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(matches, F.array().cast("array<struct<line:int,licence:string,dice:double>>")).alias("licences"))
    return out.select("doc_id", "licences", "n_lines", F.size("licences").cast("long").alias("n_matches"))
