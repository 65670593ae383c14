"""Licence scans: Dice similarity of word bigrams to licence templates. DataFrame functions only.

A text's lines and paragraphs are normalised (ASCII letters and digits, lower case, single spaces) and turned into sets of
word bigrams. Dice(a, b) = 2 |a & b| / (|a| + |b|) >= t needs |b| between |a| t/(2-t) and |a| (2-t)/t, so only templates
of fitting size are compared. Everything happens inside the row by array functions: no shuffle, and the templates are a
literal of fixed size.

Notices inside longer text, or broken over lines in other places, are found by windows: the words of all parts that do not
match as a whole, in order, are compared to every template and whole notice by windows of that template's number of
words, beginning at one of its bigrams. Of overlapping windows the best stays (then the longer, then the first). A window
reaches the threshold only with |a| t/(2-t) bigrams of the template, so texts without so many are left out before.

Candidates are looked up by keywords first: some words are in more of each template's bigrams than a match may lack, so
every part or window that matches holds one of them (`keywords`, chosen rare). One regular expression over the text tells
documents without any; their lines are never taken apart, whatever the number of templates.

Defined cases: null and empty texts have no licence; a null doc_id is kept; repeated rows are each returned; among equal
scores the first line, then the first template wins; a table without rows gives no rows; only doc_id and text are read.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Common notices (fixed values).
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]

#: Whole notices, compared by windows.
NOTICES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
]

#: Words to avoid as keywords.
COMMON = frozenset("the and for this that with any from can you are not under work use source code all have has been its may one other file person either without but see found following form free action 4 copy other such provided shall version subject conditions rights binary arising long use".split())


def bigrams(text: str) -> list[str]:
    words = re.sub(r"[^A-Za-z0-9]+", " ", text).lower().split()
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


def _hits(grams: int, threshold: float) -> int:
    """How many of a template's bigrams a window must hold at least."""
    return math.ceil(grams * threshold / (2 - threshold) - 1e-9)


def keywords(threshold: float) -> list[str]:
    """Words of which every text with a match has one: they are in too many bigrams of each template to be all missing."""
    known = [bigrams(text) for _, text in TEMPLATES + NOTICES]
    lacking = {i: len(g) - _hits(len(g), threshold) + 1 for i, g in enumerate(known)}
    left, chosen = {i: set(g) for i, g in enumerate(known)}, []
    while lacking:
        words = {w for i in lacking for g in left[i] for w in g.split() if w not in chosen}
        score = lambda w: sum(min(lacking[i], sum(w in g.split() for g in left[i])) for i in lacking) * (0.01 if len(w) < 3 or w in COMMON else 1)  # noqa: B023, E731
        word = max(sorted(words), key=score)
        chosen.append(word)
        for i in list(lacking):
            covered = {g for g in left[i] if word in g.split()}
            left[i] -= covered
            lacking[i] -= len(covered)
            if lacking[i] <= 0:
                del lacking[i]
    return chosen


def _templates(threshold: float) -> Column:
    shrink = threshold / (2 - threshold)
    cells = []
    for rank, (name, text) in enumerate(TEMPLATES):
        grams = bigrams(text)
        cells.append(F.struct(F.lit(name).alias("license"), F.lit(-rank).alias("rank"), F.lit(len(grams) * shrink - 1e-9).alias("least"), F.lit(len(grams) / shrink + 1e-9).alias("most"), F.array(*map(F.lit, grams)).alias("grams")))
    return F.array(*cells)


def _words(text: Column) -> Column:
    return F.split(F.trim(F.lower(F.regexp_replace(text, "[^A-Za-z0-9]+", " "))), " ")


def _sequence(w: Column) -> Column:
    """The bigrams of an array of words, repeats included."""
    return F.when(F.size(w) > 1, F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))


def _window_matches(grams: Column, threshold: float) -> Column:
    """(dice, size, start, rank, license) of windows over the bigrams at or above the threshold, without overlap."""

    def of(rank: int, name: str, text: str) -> Column:
        known = bigrams(text)
        width, hits = len(re.sub(r"[^A-Za-z0-9]+", " ", text).split()) - 1, _hits(len(known), threshold)
        template = F.array(*map(F.lit, known))

        def scored(at: Column) -> Column:
            window = F.array_distinct(F.slice(grams, at + 1, width))
            dice = 2.0 * F.size(F.array_intersect(window, template)) / (F.size(window) + F.size(template))
            return F.struct(dice.alias("dice"), F.lit(width).alias("size"), (-at).alias("start"), F.lit(-rank).alias("rank"), F.lit(name).alias("license"))

        places = F.filter(F.transform(grams, lambda g, i: F.when(F.array_contains(template, g), i)), lambda i: i.isNotNull())
        near = F.transform(F.array(places), lambda p: F.transform(F.filter(p, lambda at, k: F.coalesce(F.get(p, k + (hits - 1)) - at < width, F.lit(False))), scored))
        enough = F.size(F.array_intersect(grams, template)) >= hits
        return F.when(enough, F.get(near, F.lit(0))).otherwise(F.array().cast(MATCHES))

    per_template = [of(rank, *known) for rank, known in enumerate(TEMPLATES + NOTICES)]
    every = F.filter(F.concat(*per_template), lambda m: m["dice"] >= threshold - 1e-12)
    best_first = F.reverse(F.array_sort(every))
    apart = lambda m, o: (m["start"] - m["size"] >= o["start"]) | (o["start"] - o["size"] >= m["start"])
    # starts are negated: a window takes up (start - size, start]
    return F.aggregate(best_first, F.array().cast(MATCHES), lambda kept, m: F.when(F.forall(kept, lambda o: apart(m, o)), F.concat(kept, F.array(m))).otherwise(kept))


MATCHES = "array<struct<dice:double,size:int,start:int,rank:int,license:string>>"


def license_matches(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id, matches: array of (dice, rank, line, license) with dice >= threshold: the best template per line or
    paragraph, then windows over the rest of the text.

    A paragraph (lines between blank lines) counts by the number of lines before it, plus the number of lines; a window by
    its first word, plus the number of lines and paragraphs. A notice of which a line matches as a whole and the rest by a
    window counts twice, as one does that matches by line and by paragraph."""
    text = F.coalesce("text", F.lit(""))
    hint = rf"(?i)(?<![A-Za-z0-9])(?:{'|'.join(keywords(threshold))})(?![A-Za-z0-9])"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(text.rlike(hint), text).otherwise(F.lit("")).alias("text"))
    blank = r"\n[\x20\x09-\x0D]*\n"
    paragraphs = F.filter(F.split("text", blank), lambda p: F.contains(p, F.lit("\n")))
    rows = rows.select("doc_id", "text", F.concat(F.split("text", "\n"), paragraphs).alias("parts"))
    none = F.array().cast("array<string>")
    words = lambda part: F.when(part.rlike(hint), _words(part)).otherwise(none)
    rows = rows.select("doc_id", "text", "parts", F.transform("parts", words).alias("words"))
    pairs = lambda w: F.array_distinct(_sequence(w))
    rows = rows.select("doc_id", "text", "parts", (F.col("text") != "").alias("hinted"), F.transform("words", pairs).alias("grams"))
    known = _templates(threshold)

    def best(part: Column, line: Column) -> Column:
        fitting = F.filter(known, lambda t: (F.size(part) >= t["least"]) & (F.size(part) <= t["most"]) & F.arrays_overlap(part, t["grams"]))
        scored = F.transform(fitting, lambda t: F.struct((2.0 * F.size(F.array_intersect(part, t["grams"])) / (F.size(part) + F.size(t["grams"]))).alias("dice"), t["rank"].alias("rank"), line.alias("line"), t["license"].alias("license")))
        return F.array_max(scored)

    rows = rows.select("doc_id", "text", "parts", "hinted", F.transform("grams", best).alias("found"))
    rows = rows.select("doc_id", "text", "parts", "hinted", F.filter("found", lambda m: F.coalesce(m["dice"] >= threshold - 1e-12, F.lit(False))).alias("matches"))

    # what is left for windows: a part that matches as a whole becomes a barrier that no template holds
    rows = rows.select("doc_id", "text", "hinted", "matches", F.size("parts").alias("n_parts"), F.transform("matches", lambda m: F.get("parts", m["line"])).alias("whole"))
    left = lambda part, inner: F.when(F.array_contains("whole", part), F.array(F.lit("\n"))).otherwise(inner)
    by_line = lambda p: F.flatten(F.transform(F.split(p, "\n"), lambda x: left(x, F.filter(_words(x), lambda w: w != ""))))
    words = F.flatten(F.transform(F.split("text", blank), lambda p: left(p, by_line(p))))
    every = F.array(*map(F.lit, dict.fromkeys(g for _, t in TEMPLATES + NOTICES for g in bigrams(t))))
    fewest = min(_hits(len(bigrams(t)), threshold) for _, t in TEMPLATES + NOTICES)
    rows = rows.select("doc_id", "n_parts", "matches", F.when(F.col("hinted"), words).otherwise(none).alias("rest"))
    rows = rows.select("doc_id", "n_parts", "matches", _sequence(F.col("rest")).alias("rest"))
    rows = rows.select("doc_id", "n_parts", "matches", F.when(F.size(F.array_intersect("rest", every)) >= fewest, F.col("rest")).otherwise(none).alias("rest"))
    rows = rows.select("doc_id", "n_parts", "matches", F.when(F.size("rest") > 0, _window_matches(F.col("rest"), threshold)).otherwise(F.array().cast(MATCHES)).alias("inside"))
    inside = F.transform("inside", lambda m: F.struct(m["dice"].alias("dice"), m["rank"].alias("rank"), (F.col("n_parts") - m["start"]).alias("line"), m["license"].alias("license")))
    return rows.select("doc_id", F.concat("matches", inside).alias("matches"))


def license_of(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id, n_matches, license (of the best match, null if none), dice (rounded to 6 digits)."""
    found = license_matches(docs, threshold)
    top = F.array_max(F.transform("matches", lambda m: F.struct(m["dice"].alias("dice"), (-m["line"]).alias("line"), m["rank"].alias("rank"), m["license"].alias("license"))))
    rows = found.select("doc_id", F.size("matches").cast("long").alias("n_matches"), top.alias("top"))
    return rows.select("doc_id", "n_matches", F.col("top.license").alias("license"), F.round("top.dice", 6).alias("dice"))
