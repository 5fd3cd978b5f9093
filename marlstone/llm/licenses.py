"""License scans: texts in a canonical form, hashed, looked up among the digests of known licences.

The canonical form is lower case, without copyright lines, with equivalent spellings made one, punctuation turned into
spaces and white space into single ones. What is looked up are entire texts: the document as a whole, and each of its
lines, as notices stand on lines of their own, both of any length. Texts are read once; digests of what may be known, by a
bitmap of the known forms' hashes, are kept as a narrow table, which is hash-joined with the table of known digests. That
table and the bitmap have the size of the list of licences.

Nulls: a null text counts as empty, a null id stays null. Empty texts match nothing. Long texts and lines are looked up
whole. Repeated rows each give a row, and a notice that repeats within a document counts once in the list and each time in
the number of lines. Of licences with equal texts the first by name counts. An empty table gives an empty result. Extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import textwrap
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm import common

#: Whole texts of two licences without their titles. Fixed values.
MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, '
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished "
    "to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND '
    "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
    "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice "
    'appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION "
    "OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
#: Notices of one line: (identifier, notice). Fixed values.
NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
)
#: Titles that stand above texts that have none of their own. Fixed values.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "BSD-3-Clause License", 'BSD 3-Clause "New" or "Revised" License', "BSD License", "The BSD License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "BSD-2-Clause License", 'BSD 2-Clause "Simplified" License', "BSD License", "The BSD License"),
}
RIGHTS = "All rights reserved."
#: Licences whose texts lie in license_texts with their own titles.
LONG = ("Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0")
ENDING = "END OF TERMS AND CONDITIONS"
#: Spellings that count as the same: (pattern over lower-case text, one spelling). Fixed values; Java and RE2 read them alike.
SPELLINGS = (("licence", "license"), ("licensing", "license"), ("sub-license", "sublicense"), ("merchantibility", "merchantability"), ("non-infringement", "noninfringement"), ("https?://", ""), ("creative commons attribution", "cc by"), ("&", " and "))
COPYRIGHT_LINE = r"(?m)^[ \t]*(?:copyright|\(c\)|©)[^\n]*$"
#: Slots of the bitmap of known forms.
SLOTS = 1 << 16
PUNCTUATION = r"[^\pL\pN]+"
PUNCTUATION_IN_LINE = r"[^\pL\pN\n]+"


def wrappings(text: str, widths: range = range(0)) -> list[str]:
    """text, its paragraphs as lines, and wrapped: a wrapped line that begins with "copyright" is left out like a copyright line."""
    paragraphs = [" ".join(p.split()) for p in re.split(r"\n[ \t]*\n", text)]
    out = {}
    for made in [text, "\n".join(paragraphs), *("\n".join(textwrap.fill(p, w) for p in paragraphs) for w in widths)]:
        out.setdefault(" ".join(re.sub(COPYRIGHT_LINE, "", made.lower()).split()), made)
    return list(out.values())


def full_texts() -> list[tuple[str, str]]:
    """(identifier, text) of whole licences with their usual titles, endings and wrappings."""
    stored = lambda name: (Path(__file__).parent / "license_texts" / f"{name}.txt").read_text(encoding="utf-8")
    paragraph = lambda text: re.sub(r" (?=Permission|The above|THE SOFTWARE)", "\n\n", text)
    short = [("MIT", MIT), ("MIT", paragraph(MIT)), ("ISC", ISC), ("ISC", paragraph(ISC)), ("ISC", paragraph(ISC).replace("modify, and/or", "modify, and"))]
    for name in ("BSD-3-Clause", "BSD-2-Clause"):
        text = stored(name)
        short += [(name, text), (name, re.sub(r"(?m)^(?:\d\.|\*) +", "* ", text)), (name, re.sub(r"(?m)^(?:\* +)", lambda m, n=iter("123"): f"{next(n)}. ", text))]
    out = []
    for name, text in short:
        for body in wrappings(text, range(45, 101)):
            for title in ("", *TITLES[name]):
                out += [(name, f"{title}\n\n{body}"), (name, f"{title}\n\n{RIGHTS}\n\n{body}")]
    for name in LONG:
        text = stored(name)
        terms = text.split(ENDING)[0]
        for part in dict.fromkeys((text, terms + ENDING if ENDING in text else text, terms)):
            out += [(name, x) for x in wrappings(part)]
    plain = {}
    for name, text in out:
        plain.setdefault((name, re.sub(r"[\W_]+", " ", re.sub(COPYRIGHT_LINE, "", text.lower())).strip()), text)
    return [(name, text) for (name, _), text in plain.items()]


#: Known licences: (identifier, text or notice).
KNOWN = (*full_texts(), *NOTICES)


def canonical(text: Column, whole: bool = True) -> Column:
    """A text's canonical form; a single line that isn't whole keeps what looks like a copyright line."""
    out = F.lower(text)
    if whole:
        out = F.regexp_replace(out, COPYRIGHT_LINE, "")
    for pattern, spelling in SPELLINGS:
        out = F.regexp_replace(out, pattern, spelling)
    return F.trim(F.regexp_replace(out, PUNCTUATION, " "))


def lines_of(text: Column) -> Column:
    """The canonical forms of all lines of a text: what canonical(line, whole=False) gives for each, in one pass over the text."""
    out = F.lower(text)
    for pattern, spelling in SPELLINGS:
        out = F.regexp_replace(out, pattern, spelling)
    return F.transform(F.split(F.regexp_replace(out, PUNCTUATION_IN_LINE, " "), "\n"), lambda x: F.trim(x))


def scan(docs: DataFrame, licences=KNOWN) -> DataFrame:
    """doc_id, whether the whole text is a known licence, the licences found, and on how many lines."""
    slot = lambda form: F.pmod(F.xxhash64(form), F.lit(SLOTS)).cast("int")
    forms = docs.sparkSession.createDataFrame([*licences], "license string, text string").select("license", canonical(F.col("text")).alias("form"))
    bits = bytearray(SLOTS)
    for (taken,) in forms.select(slot(F.col("form"))).distinct().collect():  # at most as many as the list is long
        bits[taken] = 1
    held = F.lit(bytes(bits))
    maybe = lambda form: F.substr(held, slot(form) + 1, F.lit(1)) == F.lit(b"\x01")
    table = common.stored(forms.groupBy(F.md5("form").alias("digest")).agg(F.min("license").alias("license")).coalesce(1))
    text = common.clean_text()
    rows = docs.select("doc_id", canonical(text).alias("__text"), lines_of(text).alias("__lines"))
    rows = rows.select(
        "doc_id",
        F.monotonically_increasing_id().alias("__row"),
        F.when(maybe(F.col("__text")), F.md5("__text")).alias("digest"),
        F.transform(F.filter("__lines", maybe), F.md5).alias("__found"),
    )
    rows = common.stored(rows)  # numbers of rows are fixed from here on
    found = rows.select("__row", F.explode("__found").alias("digest")).join(table, "digest").withColumn("__line", F.lit(1))
    whole = rows.select("__row", "digest").join(table, "digest").withColumn("__line", F.lit(0))
    by_row = found.unionByName(whole).groupBy("__row").agg(F.array_sort(F.collect_set("license")).alias("names"), F.sum("__line").alias("n"), (F.min("__line") == 0).alias("whole"))  # no more names than the list has
    out = rows.select("doc_id", "__row").join(by_row, "__row", "left")
    return out.select("doc_id", F.coalesce("whole", F.lit(False)).alias("whole_text"), F.coalesce(F.array_join("names", ","), F.lit("")).alias("licenses"), F.coalesce("n", F.lit(0).cast("long")).alias("n_lines"))


def oracle(licences=KNOWN) -> str:
    """The same in DuckDB SQL."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"

    def form(text: str, whole: bool = True) -> str:
        out = f"lower({text})"
        if whole:
            out = f"regexp_replace({out}, {quoted(COPYRIGHT_LINE)}, '', 'g')"
        for pattern, spelling in SPELLINGS:
            out = f"regexp_replace({out}, {quoted(pattern)}, {quoted(spelling)}, 'g')"
        return f"trim(regexp_replace({out}, {quoted(PUNCTUATION)}, ' ', 'g'))"

    values = ", ".join(f"({quoted(a)}, {quoted(t)})" for a, t in licences)
    return f"""
    WITH known AS (SELECT min(license) AS license, digest FROM (SELECT license, md5({form("t")}) AS digest FROM (VALUES {values}) v(license, t)) GROUP BY digest),
    texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
    lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM texts),
    found AS (SELECT r, license FROM (SELECT r, md5({form("line", False)}) AS digest FROM lines) JOIN known USING (digest)),
    whole AS (SELECT r, license FROM (SELECT r, md5({form("text")}) AS digest FROM texts) JOIN known USING (digest)),
    names AS (SELECT r, string_agg(license, ',' ORDER BY license) AS licenses FROM (SELECT * FROM found UNION SELECT * FROM whole) GROUP BY r),
    counts AS (SELECT r, count(*) AS n FROM found GROUP BY r)
    SELECT t.doc_id, w.license IS NOT NULL AS whole_text, coalesce(n.licenses, '') AS licenses, coalesce(c.n, 0)::BIGINT AS n_lines
    FROM texts t LEFT JOIN whole w USING (r) LEFT JOIN names n USING (r) LEFT JOIN counts c USING (r)
    """
