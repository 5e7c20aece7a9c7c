"""License scans by sentence rules, in DataFrame functions alone.

A text is normalised: ASCII letters in lower case and digits stay, line ends and the marks that end sentences become one
``|``, anything else one space. A sentence is what stands between two marks; as licence texts are wrapped and punctuated in
many ways, it may hold marks itself. Known sentences are looked up from left to right, the longest first, and give their
identifiers; stretches of unknown sentences give one ``x``. Ordered rules are matched against this sequence, and what a
rule matches is used up before the next rule is tried. Identifiers that no rule used are reported as leftovers.

All work on a text happens within its row: no shuffle, no key that could be hot. Texts without any of ``HINTS`` are passed
over; each known sentence holds one of these single words, so nothing is lost by it, however a text is wrapped.

Defined cases: null and empty texts give empty lists; texts of any length are scanned as a whole; repeated rows repeat;
columns other than the id and the text are left alone, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gnu_grant(family: str, version: str) -> list[str]:
    """The sentence by which a GNU licence of this version or a later one is granted."""
    return [f"This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {family}General Public License as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version." for what in ("program", "library", "software", "file")]


def gnu_only(family: str, version: str) -> list[str]:
    """Sentences that grant this version of a GNU licence alone."""
    name = f"GNU {family}General Public License"
    grants = [f"This {what} is free software: you can redistribute it and/or modify it under the terms of the {name} {how}" for what in ("program", "library", "software", "file") for how in (f"version {version} as published by the Free Software Foundation.", f"as published by the Free Software Foundation, version {version}.", f"as published by the Free Software Foundation, version {version} of the License.")]
    return [*named(name, version), *grants]


def named(name: str, version: str) -> list[str]:
    """Mentions of a licence by its name and version."""
    return [f"{start}{name}, version {version}" for start in ("", "This work is licensed under the ", "This project is licensed under the ", "Licensed under the ", "Released under the ", "Distributed under the ")]


def creative(short: str, long: str) -> list[str]:
    return [f"{start} {short} 4.0" for start in ("Licensed under", "This work is licensed under")] + [f"This work is licensed under {a} Creative Commons {long} 4.0 International License" for a in ("a", "the")]


#: Known licence sentences by identifier. Case, marks and line ends don't matter.
SENTENCES = {
    "MITRELEASE": ["Released under the MIT License", "Licensed under the MIT License", "This project is licensed under the MIT License", "This work is licensed under the MIT License", "Distributed under the MIT License", "The MIT License", "MIT License", "The MIT License (MIT)"],
    "MITGRANT": ['Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'],
    "MITNOTICE": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software."],
    "ASIS": ['THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'],
    "NOLIABILITY": ["IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."],
    "ISCGRANT": [f"Permission to use, copy, modify, and{x} distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies." for x in ("", "/or")],
    "ZEROGRANT": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."],
    "ISCASIS": ['THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.'],
    "ISCNAME": ["ISC License", "Licensed under the ISC License", "Released under the ISC License"],
    "APACHE2": ['Licensed under the Apache License, Version 2.0 (the "License")', 'The ASF licenses this file to You under the Apache License, Version 2.0 (the "License")', *named("Apache License", "2.0"), "Licensed under the Apache License 2.0", "Licensed under Apache License 2.0"],
    "APACHETERMS": ["you may not use this file except in compliance with the License."],
    "APACHECOPY": [f"You may obtain a copy of the License at {x}://www.apache.org/licenses/LICENSE-2.0" for x in ("http", "https")] + ["You may obtain a copy of the License at"],
    "APACHEASIS": ['Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'],
    "APACHESEE": ["See the License for the specific language governing permissions and limitations under the License."],
    "GPL3PLUS": gnu_grant("", "3"),
    "GPL2PLUS": gnu_grant("", "2"),
    "LGPL21PLUS": gnu_grant("Lesser ", "2.1"),
    "LGPL3PLUS": gnu_grant("Lesser ", "3"),
    "AGPL3PLUS": gnu_grant("Affero ", "3"),
    "GPL3": [*gnu_only("", "3"), "Licensed under the GNU GPL, version 3"],
    "GPL2": [*gnu_only("", "2"), "Licensed under the GNU GPL, version 2"],
    "LGPL21": gnu_only("Lesser ", "2.1"),
    "LGPL3": gnu_only("Lesser ", "3"),
    "AGPL3": gnu_only("Affero ", "3"),
    "GNUHOPE": [f"This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE." for what in ("program", "library", "software", "file")],
    "GNUSEE": [f"See the GNU {family}General Public License for more details." for family in ("", "Lesser ", "Affero ")],
    "GNUCOPY": [f"You should have received a copy of the GNU {family}General Public License along with this {what}" for family in ("", "Lesser ", "Affero ") for what in ("program", "library", "software", "file")],
    "BSDGRANT": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "BSDSOURCE": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "BSDBINARY": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "BSDENDORSE": [f"Neither the name of {who} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission." for who in ("the copyright holder", "the copyright holders", "the author", "the project", "the organization", "the University")],
    "BSDASIS": [f'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE {x} DISCLAIMED.' for x in ("ARE", "IS")],
    "BSDLIABLE": [f"IN NO EVENT SHALL THE COPYRIGHT {x} OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE." for x in ("HOLDER", "HOLDERS", "OWNER")],
    "BSD2": ["Licensed under the BSD 2-Clause License", "BSD 2-Clause License", "Released under the BSD 2-Clause License"],
    "BSD3": ["Licensed under the BSD 3-Clause License", "BSD 3-Clause License", "Released under the BSD 3-Clause License"],
    "MPL2": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", *named("Mozilla Public License", "2.0")],
    "MPLCOPY": [f"If a copy of the MPL was not distributed with this file, You can obtain one at {x}://mozilla.org/MPL/2.0/." for x in ("http", "https")],
    "EPL2": [f"This program and the accompanying materials are made available under the terms of the Eclipse Public License {v}2.0" for v in ("", "v", "v. ")] + named("Eclipse Public License", "2.0"),
    "BSL1": ["Boost Software License - Version 1.0", "Distributed under the Boost Software License, Version 1.0.", "Licensed under the Boost Software License, Version 1.0."],
    "ZLIBGRANT": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
    "ZLIBORIGIN": ["The origin of this software must not be misrepresented; you must not claim that you wrote the original software."],
    "ZLIBALTERED": ["Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software."],
    "ZLIBNOTICE": ["This notice may not be removed or altered from any source distribution."],
    "CCBY4": creative("CC BY", "Attribution"),
    "CCBYSA4": creative("CC BY-SA", "Attribution-ShareAlike"),
    "CCBYNC4": creative("CC BY-NC", "Attribution-NonCommercial"),
    "CCBYND4": creative("CC BY-ND", "Attribution-NoDerivatives"),
    "CC0": ["Licensed under CC0 1.0", "Dedicated to the public domain under CC0 1.0", "CC0 1.0 Universal"],
    "UNLICENSE": ["This is free and unencumbered software released into the public domain."],
    "RESERVED": ["All rights reserved."],
}

#: Rules in the order they are tried: licence, identifiers; ? marks those that may be missing, x is a run of
#: unknown sentences.
RULES = [
    ("MIT", "MITRELEASE? x? RESERVED? x? MITGRANT x? MITNOTICE x? ASIS? x? NOLIABILITY?"),
    ("ISC", "ISCNAME? x? RESERVED? x? ISCGRANT x? ISCASIS?"),
    ("0BSD", "x? ZEROGRANT x? ISCASIS"),
    ("BSD-3-Clause", "BSD3? x? RESERVED? x? BSDGRANT x? BSDSOURCE x? BSDBINARY x? BSDENDORSE x? BSDASIS? x? BSDLIABLE?"),
    ("BSD-2-Clause", "BSD2? x? RESERVED? x? BSDGRANT x? BSDSOURCE x? BSDBINARY x? BSDASIS? x? BSDLIABLE?"),
    ("Zlib", "x? ZLIBGRANT x? ZLIBORIGIN x? ZLIBALTERED x? ZLIBNOTICE?"),
    ("Apache-2.0", "APACHE2 x? APACHETERMS x? APACHECOPY? x? APACHEASIS? x? APACHESEE?"),
    ("GPL-3.0-or-later", "GPL3PLUS x? GNUHOPE? x? GNUSEE? x? GNUCOPY?"),
    ("GPL-2.0-or-later", "GPL2PLUS x? GNUHOPE? x? GNUSEE? x? GNUCOPY?"),
    ("LGPL-3.0-or-later", "LGPL3PLUS x? GNUHOPE? x? GNUSEE? x? GNUCOPY?"),
    ("LGPL-2.1-or-later", "LGPL21PLUS x? GNUHOPE? x? GNUSEE? x? GNUCOPY?"),
    ("AGPL-3.0-or-later", "AGPL3PLUS x? GNUHOPE? x? GNUSEE? x? GNUCOPY?"),
    ("GPL-3.0-only", "GPL3 x? GNUHOPE x? GNUSEE? x? GNUCOPY?"),
    ("GPL-2.0-only", "GPL2 x? GNUHOPE x? GNUSEE? x? GNUCOPY?"),
    ("LGPL-3.0-only", "LGPL3 x? GNUHOPE x? GNUSEE? x? GNUCOPY?"),
    ("LGPL-2.1-only", "LGPL21 x? GNUHOPE x? GNUSEE? x? GNUCOPY?"),
    ("AGPL-3.0-only", "AGPL3 x? GNUHOPE x? GNUSEE? x? GNUCOPY?"),
    ("MPL-2.0", "MPL2 x? MPLCOPY"),
    ("MIT", "MITRELEASE"),
    ("ISC", "ISCNAME"),
    ("Apache-2.0", "APACHE2"),
    ("GPL-3.0-only", "GPL3"),
    ("GPL-2.0-only", "GPL2"),
    ("LGPL-2.1-only", "LGPL21"),
    ("LGPL-3.0-only", "LGPL3"),
    ("AGPL-3.0-only", "AGPL3"),
    ("BSD-3-Clause", "BSD3"),
    ("BSD-2-Clause", "BSD2"),
    ("MPL-2.0", "MPL2"),
    ("EPL-2.0", "EPL2"),
    ("BSL-1.0", "BSL1"),
    ("CC-BY-4.0", "CCBY4"),
    ("CC-BY-SA-4.0", "CCBYSA4"),
    ("CC-BY-NC-4.0", "CCBYNC4"),
    ("CC-BY-ND-4.0", "CCBYND4"),
    ("CC0-1.0", "CC0"),
    ("Unlicense", "UNLICENSE"),
    ("All-Rights-Reserved", "RESERVED"),
]

#: A known sentence holds one of these at least.
HINTS = ("licens", "permission", "warrant", "redistribution", "copyright", "liable", "reserved", "unencumbered", "cc0", "misrepresented", "altered", "mozilla")

#: Steps from a text in lower case, enclosed by line ends, to words and marks: a mark after the numbers of list items, full
#: stops before anything but a letter or digit, other marks, other characters, marks that meet.
STEPS = [(r"(\n[^a-z0-9\n]*[0-9a-z]{1,2}\))[ \t]", "$1|"), (r"\.+([^a-z0-9]|\z)", " | "), (r"[\n\r;:!?|]+", " | "), (r"[^a-z0-9|]+", " "), (r"[ |]*\|[ |]*", " | ")]


def known() -> dict[str, str]:
    """Normalised sentence, without marks -> identifier; longest first."""
    found = {" ".join(re.findall("[a-z0-9]+", s.lower())): k for k, group in SENTENCES.items() for s in group}
    return dict(sorted(found.items(), key=lambda x: (-len(x[0]), x[0])))


def marked(text: Column) -> Column:
    out = F.concat(F.lit("\n"), text, F.lit("\n"))
    for pattern, by in STEPS:
        out = F.regexp_replace(out, pattern, by)
    return out


def sentence_pattern() -> str:
    """Any known sentence between two marks. Marks inside a sentence are passed over."""
    return r"(?<=\| )(?:" + "|".join(s.replace(" ", r"(?: \|)? ") for s in known()) + r")(?= \|)"


def rule_pattern(rule: str) -> str:
    """A rule as a regular expression over tokens that are each enclosed by spaces."""
    return "".join(f"( {t[:-1]} )?" if t.endswith("?") else f" {t} " for t in rule.split())


def identifiers(text: Column) -> Column:
    """Identifiers of a marked text's known sentences in order, each enclosed by spaces; unknown ones between are one x."""
    pattern = F.lit(sentence_pattern())
    table = F.create_map(*(F.lit(x) for pair in known().items() for x in pair))
    found = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda s: F.element_at(table, F.replace(s, F.lit(" |"), F.lit(""))))
    unknown = F.transform(F.split(text, sentence_pattern(), -1), lambda s: F.when(s.rlike("[a-z0-9]"), " x ").otherwise(""))
    tokens = F.zip_with(unknown, found, lambda x, k: F.concat(x, F.coalesce(F.concat(F.lit(" "), k, F.lit(" ")), F.lit(""))))
    return F.array_join(tokens, "")


def scan(df: DataFrame, text_col: str = "text", id_cols: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """id_cols, sequence, licenses, n_matches, leftover: one row for each input row."""
    rows = df.select(*id_cols, F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("__low"))
    hint = F.lit(False)
    for word in HINTS:
        hint = hint | F.contains("__low", F.lit(word))
    rows = rows.select(*id_cols, F.when(hint, marked(F.col("__low"))).otherwise(" | ").alias("__marked"))
    rows = rows.select(*id_cols, F.when(F.col("__marked") != " | ", identifiers(F.col("__marked"))).otherwise("").alias("__found"))
    return matched(rows.select(*id_cols, F.when(F.col("__found").rlike("[A-Z]"), F.col("__found")).otherwise("").alias("sequence")), id_cols)


def matched(seen: DataFrame, id_cols: tuple[str, ...]) -> DataFrame:
    """The rules, one after another, over all sequences that hold an identifier; each marks what it used by its number."""
    left = F.col("sequence")
    for k, (_, rule) in enumerate(RULES):
        left = F.regexp_replace(left, rule_pattern(rule), f" #{k} ")
    seen = seen.withColumn("__left", F.when(F.col("sequence") != "", left).otherwise(""))
    names = F.create_map(*(F.lit(x) for k, (name, _) in enumerate(RULES) for x in (str(k), name)))
    used = F.regexp_extract_all("__left", F.lit("#([0-9]+)"), 1)
    licenses = F.array_sort(F.array_distinct(F.transform(used, lambda k: F.element_at(names, k))))
    leftover = F.array_sort(F.array_distinct(F.regexp_extract_all("__left", F.lit("[A-Z][A-Z0-9]+"), 0)))
    return seen.select(*id_cols, F.regexp_replace(F.btrim("sequence"), " +", " ").alias("sequence"), licenses.alias("licenses"), F.size(used).cast("long").alias("n_matches"), leftover.alias("leftover"))


def duckdb_sql(table: str = "documents") -> str:
    """The same scan for DuckDB, by other means: no hints; each stretch of pieces between marks is joined with the table of
    sentences. Arrays are joined by commas."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    pairs = known()
    values = ", ".join(f"({quote(s)}, {quote(k)})" for s, k in pairs.items())
    most = max(s.count(" ") + 1 for s in pairs)
    left = "sequence"
    for k, (_, rule) in enumerate(RULES):
        left = f"regexp_replace({left}, {quote(rule_pattern(rule))}, ' #{k} ', 'g')"
    names = ", ".join(f"'{k}': {quote(name)}" for k, (name, _) in enumerate(RULES))
    return rf"""
WITH known AS (SELECT * FROM (VALUES {values}) t(s, id)),
starting AS (SELECT DISTINCT split_part(s, ' ', 1) AS w FROM known),
raw AS (SELECT row_number() OVER () AS k, doc_id, regexp_replace(chr(10) || lower(coalesce(text, '')) || chr(10), '(\n[^a-z0-9\n]*[0-9a-z]{{1,2}}\))[ \t]', '\1' || chr(10), 'g') AS t FROM {table}),
cut AS (SELECT k, doc_id, list_filter(list_transform(string_split_regex(t, '\.+[^a-z0-9]|\.+$|[\n\r;:!?|]+'), lambda p: trim(regexp_replace(p, '[^a-z0-9]+', ' ', 'g'))), lambda p: p <> '') AS ps FROM raw),
piece AS (SELECT k, unnest(range(1, len(ps) + 1)) AS i, ps FROM cut),
start AS (SELECT k, i, ps FROM piece WHERE split_part(ps[i], ' ', 1) IN (SELECT w FROM starting)),
span AS (SELECT k, i, j, array_to_string(ps[i:j], ' ') AS s FROM (SELECT k, i, ps, unnest(range(i, least(len(ps), i + {most - 1}) + 1)) AS j FROM start)),
hit AS (SELECT k, i, max(j) AS j, max_by(id, j) AS id FROM span JOIN known USING (s) GROUP BY k, i),
kept AS (SELECT * FROM hit h WHERE NOT EXISTS (SELECT 1 FROM hit o WHERE o.k = h.k AND o.i < h.i AND o.j >= h.i)),
tokens AS (SELECT k, i, id AS t FROM kept UNION ALL SELECT p.k, p.i, 'x' FROM piece p WHERE p.k IN (SELECT k FROM kept) AND NOT EXISTS (SELECT 1 FROM kept h WHERE h.k = p.k AND p.i BETWEEN h.i AND h.j)),
line AS (SELECT k, regexp_replace(string_agg(' ' || t || ' ', '' ORDER BY i), '( x )+', ' x ', 'g') AS sequence FROM tokens GROUP BY k),
seen AS (SELECT doc_id, coalesce(sequence, '') AS sequence FROM raw LEFT JOIN line USING (k)),
used AS (SELECT *, {left} AS l FROM seen)
SELECT doc_id, regexp_replace(trim(sequence), ' +', ' ', 'g') AS sequence,
       array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(l, '#([0-9]+)', 1), lambda k: map {{{names}}}[k]))), ',') AS licenses,
       len(regexp_extract_all(l, '#([0-9]+)', 1))::BIGINT AS n_matches,
       array_to_string(list_sort(list_distinct(regexp_extract_all(l, '[A-Z][A-Z0-9]+'))), ',') AS leftover
FROM used
"""
