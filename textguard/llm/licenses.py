"""Licence scan: normalised text against licence templates by Dice coefficient of word bigrams.

Units of a document are its lines, its blocks (runs of lines between blank ones, where there are
several) and the whole text. A unit's bigrams are a set; the coefficient with a template is
2|A and B| / (|A| + |B|). It can reach ``threshold`` only if the sizes are close enough, so
templates are pruned by size before any bigram is compared. It also needs a fixed part of a
template's bigrams, so texts and units without any of a few words are passed over unread.

A notice need not fill a unit: windows of words over the whole normalised text are compared too,
with more templates (``NOTICES`` and the full texts beside this file). For each template the best
window is found exactly: it begins and ends on a bigram of the template. It decides where no unit
matches (and counts as one unit) and where it is better than the best unit and names another licence.

Defined results: null, empty and blank texts and units of one word match nothing (null licence, 0
units); ties go to the alphabetically first licence; rows with equal ids share their matches; an
empty table gives no rows; other columns are ignored.

Scale: units are compared by built-in functions, windows in one Arrow pass without a shuffle;
templates are fixed. Units without a bigram of any template drop out before a coefficient is
computed; only matches are shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce
from operator import or_
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MIT_BODY = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_CONDITIONS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_THIRD = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)

#: Public licence texts and the usual notices that name a licence.
TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "BSD-2-Clause": ["Released under the BSD 2-Clause License.", _BSD_CONDITIONS + _BSD_END],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License.", _BSD_CONDITIONS + _BSD_THIRD + _BSD_END],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ],
    "ISC": [
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ],
    "MIT": ["Released under the MIT License.", _MIT_BODY],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
}

_GNU = (
    "This {0} is free software{5} you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software Foundation; either version {2} of the License, or (at your option) any later version. "
    "This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1} for more details. "
    "You should have received a copy of the GNU {1} along with this {3}{4}"
)
_POSTAL = "; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."
_ONLINE = ". If not, see <https://www.gnu.org/licenses/>."


def _gnu(program: str, name: str, versions: str) -> list[str]:
    """A GNU licence's usual sentences and its notice with either ending."""
    sentences = [f"This work is licensed under the GNU {name}, version {v}." for v in versions.split()]
    return sentences + [_GNU.format(program, name, v, program, end, ":") for v in versions.split() for end in (_POSTAL, _ONLINE)]


#: Further notices, for windows only.
NOTICES: dict[str, list[str]] = {
    "AGPL-3.0": _gnu("program", "Affero General Public License", "3"),
    "GPL-2.0": _gnu("program", "General Public License", "2"),
    "LGPL-2.1": _gnu("library", "Lesser General Public License", "2.1"),
    "LGPL-3.0": _gnu("library", "Lesser General Public License", "3"),
}
#: Folder of full licence texts, a file for each licence.
TEXTS = Path(__file__).with_name("license_texts")

THRESHOLD = 0.8
#: Bigrams from which a template counts as large: it needs no fixed word, but a long text.
LARGE = 500


def window_templates(templates: dict[str, list[str]] = TEMPLATES) -> dict[str, list[str]]:
    """``templates``, the further notices and the full texts."""
    out = {name: list(texts) for name, texts in templates.items()}
    for name, texts in [*NOTICES.items(), *((f.stem, [f.read_text("utf-8")]) for f in sorted(TEXTS.glob("*.txt")))]:
        out.setdefault(name, []).extend(texts)
    return out


def template_bigrams(text: str) -> list[str]:
    words = re.sub("[^a-z0-9]+", " ", text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def template_rows(templates: dict[str, list[str]] = TEMPLATES) -> list[tuple[str, list[str]]]:
    """(licence, bigrams) of every template that has a bigram."""
    return [(name, grams) for name, texts in sorted(templates.items()) for text in texts if (grams := template_bigrams(text))]


def needed_words(rows: list[tuple[str, list[str]]], threshold: float) -> list[str]:
    """Words of which every matching unit holds one.

    A match shares more than a fixed part of a template's bigrams, so it meets any set of words
    that touches all but fewer of them. Chosen greedily: most templates served, then longest.
    """
    part = threshold / (2 - threshold)
    left = [set(grams) for _, grams in rows]
    missing = lambda i: len(left[i]) >= part * len(rows[i][1])
    chosen: list[str] = []
    while any(map(missing, range(len(rows)))):
        gain: dict[str, list[int]] = {}
        for i in filter(missing, range(len(rows))):
            for word, n in Counter(w for g in left[i] for w in set(g.split())).items():
                entry = gain.setdefault(word, [0, 0])
                entry[0] += len(word) >= 6
                entry[1] += n
        best = max(gain, key=lambda w: (gain[w][0] > 0, *gain[w], w))
        chosen.append(best)
        left = [{g for g in grams if best not in g.split()} for grams in left]
    return sorted(chosen)


class Windows:
    """Best window of a text for any template."""

    def __init__(self, rows: list[tuple[str, list[str]]], threshold: float):
        self.names, self.sizes, self.threshold = [name for name, _ in rows], [len(grams) for _, grams in rows], threshold
        self.known: dict[tuple[str, str], list[int]] = {}
        for i, (_, grams) in enumerate(rows):
            for g in grams:
                self.known.setdefault(tuple(g.split()), []).append(i)

    def best(self, text: str | None) -> tuple[str, float] | None:
        """(licence, coefficient) of the best window that reaches the threshold; ties go to the first name."""
        words = re.sub("[^a-z0-9]+", " ", (text or "").lower()).split()
        grams = list(zip(words, words[1:]))
        places: dict[int, list[int]] = {}
        for at, g in enumerate(grams):
            for i in self.known.get(g, ()):
                places.setdefault(i, []).append(at)
        top, name = 0.0, None
        for i in sorted(places, key=lambda i: self.names[i]):
            dice = self._of(grams, places[i], self.sizes[i], top)
            if dice > top:
                top, name = dice, self.names[i]
        return None if name is None else (name, top)

    def _of(self, grams: list[tuple[str, str]], places: list[int], n: int, top: float) -> float:
        """Best coefficient of a window with a template of ``n`` bigrams if it beats ``top``, else ``top``."""
        floor = self.threshold
        hit = {grams[p] for p in places}
        if len(hit) < floor / (2 - floor) * n:
            return top
        most = n * (2 - floor) / floor
        # a window that holds its first bigram once more is no better without it, so a start serves up to its bigram's
        # next place only: all starts together take each place at most once for each of the template's bigrams
        again, latest = [len(grams)] * len(places), {}
        for k in range(len(places) - 1, -1, -1):
            again[k] = latest.get(grams[places[k]], len(grams))
            latest[grams[places[k]]] = places[k]
        for k, start in enumerate(places):
            # with all that is left the coefficient is 2h / (h + n) at most
            left = min(n, len(places) - k)
            if 2 * left / (left + n) < max(floor, top):
                break
            # distinct bigrams are at most so many, so a window may only be longer where they repeat
            seen: set[tuple[str, str]] = set()
            shared, at = 0, start
            for j in range(k, len(places)):
                stop = places[j]
                if stop >= again[k]:
                    break
                for g in grams[at : stop + 1]:
                    if g not in seen:
                        seen.add(g)
                        shared += g in hit
                at = stop + 1
                if len(seen) > most:
                    break
                dice = 2.0 * shared / (len(seen) + n)
                if dice >= floor and dice > top:
                    top = dice
                if shared == len(hit):
                    break
        return top


def bigrams(unit: Column) -> Column:
    """Distinct word bigrams of a normalised unit."""
    words = F.filter(F.split(unit, " "), lambda w: w != "")
    pairs = F.zip_with(words, F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(F.filter(pairs, lambda p: p.isNotNull()))


def units(text: Column) -> Column:
    """Normalised lines, blocks of several lines, and the whole text if it has several lines."""
    clean = F.regexp_replace(F.lower(text), "[^a-z0-9\n]+", " ")
    flat = lambda u: F.replace(u, F.lit("\n"), F.lit(" "))
    named = lambda kind, of: F.transform(of, lambda u, i: F.struct(F.lit(kind).alias("kind"), i.alias("at"), flat(u).alias("unit")))
    blocks = F.split(clean, "\n *\n[ \n]*")
    blocks = F.when(F.size(blocks) > 1, F.filter(blocks, lambda b: F.contains(b, F.lit("\n")))).otherwise(F.array().cast("array<string>"))
    whole = F.when(F.contains(clean, F.lit("\n")), F.array(clean)).otherwise(F.array().cast("array<string>"))
    return F.concat(named("line", F.split(clean, "\n")), named("block", blocks), named("document", whole))


def scan_licenses(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD, templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """Per document: doc_id, license_id and dice of its best unit, n_units that match any template."""
    rows = template_rows(templates)
    known = sorted({g for _, grams in rows for g in grams})
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    literal = F.array(*[F.struct(F.lit(name).alias("id"), F.lit(len(grams)).alias("n"), F.array(*map(F.lit, grams)).alias("grams")) for name, grams in rows])
    words = needed_words(rows, threshold)
    held = lambda where: reduce(or_, [F.contains(where, F.lit(w)) for w in words])
    likely = docs.where(held(F.lower(F.col(text))))
    cut = likely.select(F.col(doc_id).alias("doc_id"), F.explode(F.filter(units(F.col(text)), lambda u: held(u["unit"]))).alias("u")).select("doc_id", bigrams(F.col("u.unit")).alias("grams"))
    least, most = min(len(g) for _, g in rows) * low, max(len(g) for _, g in rows) * high
    sized = cut.where(F.size("grams").between(least, most))
    hits = sized.withColumn("hits", F.size(F.filter("grams", lambda g: g.isin(known)))).where(2 * F.col("hits") >= threshold * (F.col("hits") + least))
    size = F.size("grams")
    fitting = F.filter(literal, lambda t: (size >= t["n"] * low) & (size <= t["n"] * high))
    scored = F.transform(fitting, lambda t: F.struct((F.lit(2.0) * F.size(F.array_intersect("grams", t["grams"])) / (size + t["n"])).alias("dice"), t["id"].alias("id")))
    # largest coefficient first, then the smallest name
    best = F.array_min(F.transform(scored, lambda s: F.struct((-s["dice"]).alias("minus"), s["id"].alias("id"))))
    matched = hits.select("doc_id", best.alias("best")).where(-F.col("best.minus") >= threshold)
    wide = template_rows(window_templates(templates))
    windows = Windows(wide, threshold)

    @F.pandas_udf("id string, dice double")
    def best_window(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([windows.best(t) or (None, None) for t in texts], columns=["id", "dice"]).astype({"id": object, "dice": "float64"})

    # texts long enough for the shortest large template are all read, as those have no few needed words
    small, large = ([r for r in wide if (len(r[1]) >= LARGE) == big] for big in (False, True))
    needed = [F.contains(F.lower(F.col(text)), F.lit(w)) for w in needed_words(small, threshold)]
    room = [F.char_length(text) > 2 * low * min(len(g) for _, g in large)] if large else []
    served = docs.where(reduce(or_, room + needed))
    # explode_outer keeps the optimiser from computing the windows again in a filter
    seen = served.select(F.col(doc_id).alias("doc_id"), F.explode_outer(F.array(best_window(F.col(text)))).alias("w")).where("w.id is not null")
    better = F.struct((-F.col("w.dice")).alias("minus"), F.col("w.id").alias("id"))
    every = matched.select("doc_id", "best", F.lit(None).cast("struct<minus: double, id: string>").alias("window")).unionByName(seen.select("doc_id", F.lit(None).cast("struct<minus: double, id: string>").alias("best"), better.alias("window")))
    found = every.groupBy("doc_id").agg(F.min("best").alias("unit"), F.min("window").alias("window"), F.count("best").alias("n"))
    wins = F.col("unit").isNull() | ((F.col("window.minus") < F.col("unit.minus")) & (F.col("window.id") != F.col("unit.id")))
    found = found.select("doc_id", F.when(wins, F.col("window")).otherwise(F.col("unit")).alias("best"), F.greatest("n", F.lit(1)).alias("n_units"))
    ids = docs.select(F.col(doc_id).alias("doc_id"))
    return ids.join(found, "doc_id", "left").select("doc_id", F.col("best.id").alias("license_id"), (-F.col("best.minus")).alias("dice"), F.coalesce("n_units", F.lit(0)).cast("long").alias("n_units"))


def oracle_sql(threshold: float = THRESHOLD, templates: dict[str, list[str]] = TEMPLATES) -> str:
    """DuckDB SQL with the rows of scan_licenses over the table ``documents``."""
    values = ", ".join(f"('{name}', [{', '.join(repr(g) for g in grams)}])" for name, grams in template_rows(templates))
    return rf"""
WITH templates(id, grams) AS (VALUES {values}),
cleaned AS (SELECT doc_id, regexp_replace(lower(text), '[^a-z0-9\n]+', ' ', 'g') AS clean FROM documents WHERE text IS NOT NULL),
units AS (
  SELECT doc_id, unnest(string_split(clean, chr(10))) AS unit FROM cleaned
  UNION ALL SELECT doc_id, unit FROM (SELECT doc_id, regexp_split_to_array(clean, '\n *\n[ \n]*') AS b FROM cleaned), unnest(b) AS x(unit) WHERE len(b) > 1 AND contains(unit, chr(10))
  UNION ALL SELECT doc_id, clean FROM cleaned WHERE contains(clean, chr(10))
),
worded AS (SELECT doc_id, list_filter(string_split(replace(unit, chr(10), ' '), ' '), lambda w: w <> '') AS w FROM units),
paired AS (SELECT doc_id, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS grams FROM worded WHERE len(w) > 1),
scored AS (
  SELECT doc_id, 2.0::DOUBLE * len(list_intersect(p.grams, t.grams)) / (len(p.grams) + len(t.grams)) AS dice, id,
    row_number() OVER (PARTITION BY p.rowid_ ORDER BY 2.0::DOUBLE * len(list_intersect(p.grams, t.grams)) / (len(p.grams) + len(t.grams)) DESC, id) AS k
  FROM (SELECT *, row_number() OVER () AS rowid_ FROM paired) p, templates t
  WHERE len(p.grams) BETWEEN len(t.grams) * {threshold / (2 - threshold)!r} AND len(t.grams) * {(2 - threshold) / threshold!r}
),
matched AS (SELECT doc_id, dice, id, row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, id) AS k, count(*) OVER (PARTITION BY doc_id) AS n_units FROM scored WHERE k = 1 AND dice >= {threshold})
SELECT d.doc_id, m.id AS license_id, m.dice, coalesce(m.n_units, 0)::BIGINT AS n_units
FROM documents d LEFT JOIN matched m ON d.doc_id = m.doc_id AND m.k = 1
"""
