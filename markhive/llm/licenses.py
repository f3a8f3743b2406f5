"""License notices and texts by Dice coefficient over word bigrams.

Texts are normalised (A-Z lower-cased, everything but a-z and 0-9 a separator)
and compared with templates by the Dice coefficient of the sets of word bigrams,
``2 * |A & B| / (|A| + |B|)``, in three kinds of passages:

* each line, and the whole text (units), with every template;
* windows: as many consecutive words as a template has (fewer at the text's end),
  wherever lines break, from every word that begins a bigram of the template.

With a least coefficient t, |A| must lie between ``t / (2 - t)`` and ``(2 - t) / t``
times |B|: units outside these bounds for all templates are dropped before their
bigrams are made, and each template is only compared with units inside its own
bounds.  By the same bound a match shares ``t / (2 - t) * |B|`` bigrams: windows
are opened only in texts that share as many, and only where as many lie in reach.
All steps are Spark SQL expressions in one pass over the texts.

Cases: null and empty texts, and units of one word, have no bigrams and match
nothing; with equal coefficients the first template by name (then by text) wins;
repeated rows get the same result; a very long line or text is treated like any
other, with all its windows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least Dice coefficient of a match.
LEAST = 0.8
#: Notices by SPDX name (fixed values).
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
_FREE = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0}General Public License for more details."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. {0}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
#: Licence texts, and the notices that licences ask to be put into files, by SPDX name (fixed values).
TEXTS = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD-2-Clause": _BSD.format(""),
    "BSD-3-Clause": _BSD.format("3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "),
    "GPL-2.0": _FREE.format("", "2"),
    "GPL-3.0": _FREE.format("", "3"),
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "LGPL-3.0": _FREE.format("Lesser ", "3"),
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}
KNOWN = sorted([*TEMPLATES.items(), *TEXTS.items()])
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), "[^a-z0-9]+", " "))


def pairs(words: Column) -> Column:
    """Bigrams of an array of at least two words, in order."""
    return F.transform(F.slice(words, 1, F.size(words) - 1), lambda w, i: F.concat(w, F.lit(" "), F.element_at(words, i + 2)))


def template_words(text: str) -> list[str]:
    return "".join(c if c.isascii() and c.isalnum() else " " for c in text.translate(str.maketrans(UPPER, LOWER))).split()


def template_bigrams(text: str) -> list[str]:
    plain = template_words(text)
    return sorted({f"{a} {b}" for a, b in zip(plain, plain[1:], strict=False)})


def shared_at_least(n: int, least: float) -> int:
    """Bigrams that a match shares with a template of n bigrams at least (one less is allowed for rounding)."""
    return max(1, int(least / (2 - least) * n))


def scan(df: DataFrame, templates: list[tuple[str, str]] = KNOWN, least: float = LEAST) -> DataFrame:
    """doc_id, license, dice, n_units, n_windows of each row of ``df`` (doc_id, text).

    license: the template of the best passage, null without a match; dice: its
    coefficient; n_units: units that match a template (lines, and the text if it
    has more than one); n_windows: places from which a window matches its template,
    added over templates.
    """
    known = [(template_bigrams(t), len(template_words(t))) for _, t in templates]
    low = min(least / (2 - least) * len(b) for b, _ in known)
    text = F.coalesce("text", F.lit(""))
    lines = F.split(text, "\n", -1)
    units = F.when(F.size(lines) > 1, F.concat(lines, F.array(text))).otherwise(lines)
    # |A| is at most the number of words less one; the whole text, if long enough, is last
    words = F.transform(units, lambda u: F.split(normalised(u), " "))
    words = F.filter(words, lambda w: (F.size(w) - 1) >= low)
    made = df.select("doc_id", F.transform(words, pairs).alias("pairs"))
    # each unit's bigrams are made once, then bound for all templates
    found = F.filter(F.transform(F.transform("pairs", F.array_distinct), lambda u: _best(u, known, least)), lambda m: m["dice"].isNotNull())
    every = _literal(sorted({b for own, _ in known for b in own}))
    whole = F.when(F.size("pairs") > 0, F.slice("pairs", -1, 1)).otherwise(F.slice("pairs", 1, 0))
    inside = F.flatten(F.transform(whole, lambda p: _bound(F.array_intersect(p, every), lambda shared: _windows(p, shared, known, least))))
    out = made.select("doc_id", found.alias("found"), F.filter(inside, lambda m: m["n"] > 0).alias("inside"))
    both = F.concat("found", F.transform("inside", lambda m: F.struct(m["dice"].alias("dice"), m["place"].alias("place"))))
    out = out.select("doc_id", F.array_max(both).alias("best"), F.size("found").cast("long").alias("n_units"), F.aggregate("inside", F.lit(0).cast("long"), lambda n, m: n + m["n"]).alias("n_windows"))
    name = F.element_at(F.array(*(F.lit(n) for n, _ in templates)), -F.col("best.place"))
    return out.select("doc_id", F.when(F.col("best").isNotNull(), name).alias("license"), F.col("best.dice").alias("dice"), "n_units", "n_windows")


def _literal(words: list[str]) -> Column:
    return F.array(*map(F.lit, words))


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _best(unit: Column, known: list[tuple[list[str], int]], least: float) -> Column:
    """(dice, place): the best template of a unit; place counts down, so that of equal ones the first is greatest."""
    tried = []
    for place, (own, _) in enumerate(known):
        n = len(own)
        inside = (F.size(unit) * (2 - least) >= least * n) & (F.size(unit) * least <= (2 - least) * n)
        both = F.size(F.array_intersect(unit, _literal(own)))
        dice = F.when(inside, 2.0 * both / (F.size(unit) + n))
        tried.append(F.struct(F.when(dice >= least, dice).alias("dice"), F.lit(-1 - place).alias("place")))
    return F.array_max(F.array(*tried))


def _windows(text: Column, shared: Column, known: list[tuple[list[str], int]], least: float) -> Column:
    """For each template (dice, place, n): its best window in a text's bigrams, and the number of windows that match.

    shared: the text's bigrams that any template has.
    """
    return F.array(*(_windows_of(text, shared, *template, place, least) for place, template in enumerate(known)))


def _windows_of(text: Column, shared: Column, own: list[str], n_words: int, place: int, least: float) -> Column:
    need, template = shared_at_least(len(own), least), _literal(own)

    def opened(at: Column) -> Column:
        # the need-th template bigram from here on still lies in the window
        near = F.filter(at, lambda i, k: F.get(at, k + (need - 1)) <= i + (n_words - 2))
        # one window's bigrams at a time, so that memory follows the text and not its windows
        window = lambda i: F.array_distinct(F.slice(text, i, n_words - 1))
        dice = F.transform(near, lambda i: _bound(window(i), lambda u: 2.0 * F.size(F.array_intersect(u, template)) / (F.size(u) + len(own))))
        return F.filter(dice, lambda d: d >= least)

    begins = F.filter(F.sequence(F.lit(1), F.size(text)), lambda i: F.array_contains(template, F.element_at(text, i)))
    matches = F.when(F.size(F.array_intersect(shared, template)) >= need, _bound(begins, opened)).otherwise(F.array().cast("array<double>"))
    return _bound(matches, lambda m: F.struct(F.array_max(m).alias("dice"), F.lit(-1 - place).alias("place"), F.size(m).alias("n")))


def oracle_sql(templates: list[tuple[str, str]] = KNOWN, least: float = LEAST) -> str:
    """DuckDB SQL for scan() over documents."""
    rows = ", ".join(f"({k}, '{name}', {template_bigrams(t)!r}, {len(template_words(t))})" for k, (name, t) in enumerate(templates))
    return rf"""
WITH t(place, license, b, n_words) AS (VALUES {rows}),
d AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS lines, coalesce(text, '') AS text FROM documents),
u AS (SELECT r, unnest(CASE WHEN len(lines) > 1 THEN list_append(lines, text) ELSE lines END) AS unit FROM d),
w AS (SELECT r, row_number() OVER () AS k, string_split(trim(regexp_replace(translate(unit, '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ', 'g')), ' ') AS words FROM u),
a AS (SELECT r, k, list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS b FROM w WHERE len(words) > 1),
m AS (SELECT r, k, place, license, 2.0 * len(list_intersect(a.b, t.b)) / (len(a.b) + len(t.b)) AS dice FROM a, t
      WHERE len(a.b) * {2 - least} >= {least} * len(t.b) AND len(a.b) * {least} <= {2 - least} * len(t.b)),
x AS (SELECT r, string_split(trim(regexp_replace(translate(text, '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ', 'g')), ' ') AS words FROM d),
p AS (SELECT r, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) AS p FROM x WHERE len(words) > 1),
o AS (SELECT r, unnest(range(1, len(p) + 1)) AS i, unnest(p) AS bigram FROM p),
s AS (SELECT r, i, place FROM o JOIN (SELECT place, unnest(b) AS bigram FROM t) USING (bigram)),
v AS (SELECT r, place, license, list_distinct(p[i : i + n_words - 2]) AS own, b FROM s JOIN p USING (r) JOIN t USING (place)),
n AS (SELECT r, place, license, 2.0 * len(list_intersect(own, b)) / (len(own) + len(b)) AS dice FROM v),
e AS (SELECT r, k, place, license, dice FROM m WHERE dice >= {least} UNION ALL SELECT r, NULL, place, license, dice FROM n WHERE dice >= {least}),
g AS (SELECT r, count(DISTINCT k) AS n_units, count(*) FILTER (k IS NULL) AS n_windows, arg_max(license, (dice, -place)) AS license, max(dice) AS dice FROM e GROUP BY r)
SELECT doc_id, license, dice::DOUBLE AS dice, coalesce(n_units, 0) AS n_units, coalesce(n_windows, 0) AS n_windows FROM d LEFT JOIN g USING (r)
"""
