"""Licence scan by canonical digests, in DataFrame operations only.

A text is brought to a canonical form (case, punctuation, copyright lines and
equivalent spellings are levelled) and its digest is hash-joined to the digests of
known licences. The same lookup is made for each line, which finds notices.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

#: Spellings that licence matching counts as equal, on canonical words.
SPELLINGS = [
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("licencing", "licensing"), ("sub license", "sublicense"),
    ("non commercial", "noncommercial"), ("organisation", "organization"), ("favour", "favor"), ("copyright owner", "copyright holder"),
    ("whilst", "while"), ("per cent", "percent"), ("https", "http"), ("acknowledgement", "acknowledgment"), ("merchantibility", "merchantability"),
]
#: Fixed value: lines that only say who holds the copyright, in canonical form.
COPYRIGHT_LINE = r"^(portions )?(copyright|c)( c)? ([0-9]{4}|year|yyyy)( .*)?$|^all rights reserved$"

#: Short licences and the notices that stand for longer ones.
KNOWN = [
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("Apache-2.0", "This work is licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]

#: Fixed value: lines in front of a licence's text, in canonical form, that give its title or who holds the copyright.
HEAD_LINE = (
    r"(?:the )?(?:mit|isc|zlib|(?:new |modified |simplified |revised )?(?:bsd )?(?:[23] clause )?(?:bsd )?(?:new or revised |simplified )?|apache|mozilla public|gnu (?:lesser |affero )?general public|cc0 1 0 universal|creative commons legal code)"
    r"(?: license)(?: mit| isc| zlib| expat)?(?: version [0-9][^\n]*| [0-9] 0)?|version [0-9][^\n]*|http www apache org licenses|=*|creative commons legal code|cc0 1 0 universal"
    r"|(?:portions )?(?:copyright|c)(?: [^\n]*)?|all rights reserved[^\n]*"
)
#: Fixed value: lines behind a licence's text, in canonical form, that say who holds the copyright, with or without a year.
TAIL_LINE = r"(?:portions )?(?:copyright|c)(?: [^\n]*)?|all rights reserved[^\n]*"
#: Digests (of _body) of entire licences that are too long to hold here.
FULL: list[tuple[str, str]] = [
    ("Apache-2.0", "d849700f6ffe2241c4de5c4f77cc6ee7a152ddfbb1ec7385106677e743be07a7"),
    ("BSD-2-Clause", "986c3c3199a93b916c8f2e0aeed57819bcbdcb2cd9d99902dcc9d74b53f93a74"),
    ("BSD-2-Clause", "a56fee4b2f66331ed54da4950ef9c9391453fd1490b4d8ea202bc29683bcbd30"),
    ("BSD-3-Clause", "53075742228962c7ea381b8242c64602fa32e7b8f52facb6d13ee4f9c596ddfa"),
    ("BSD-3-Clause", "9b83d3dee0616d07b82a272dd9bf5134a9f402b750f5ee6188458073b0a32ff2"),
    ("CC-BY-SA-4.0", "4dd2d8faa991a43111f73718974d1a9133ba1453cd76d174da75d163e35fa974"),
    ("CC0-1.0", "e3ba2aff64372f535373996fe68b166f9e97dc1ead5b471981213ebb8f310ad6"),
    ("GPL-2.0", "1209c79257248b7161d3c22428c175f32857474796d44175e2dd7f52c5a2b757"),
    ("GPL-2.0", "4767c85efb312bbe244abef9b752be38b44e810f05ed9bfae182caf068d13fd3"),
    ("GPL-3.0", "04a10e711844fe517f9ffba9481db6a825f2f268002c49184ecb8c942911bff3"),
    ("LGPL-3.0", "13980739d6423be0921994d8ce3ce547437735b0e6733161f70b19c962f194b7"),
    ("MPL-2.0", "c0f855aacb6ac1c86bcdd1334db61014d14898798ae14888fea5446cbb9d32e3"),
    ("Unlicense", "e2380bdfe57ca73b01d0b1848a4ee630998d729b260e63082b9267100b4a7229"),
]

#: Known texts are broadcast and notices are literals: a bound on their number.
MOST_TEXTS = 10_000


def canonical_lines(text):
    """Array of the text's lines in canonical form, without empty and copyright lines."""
    flat = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}\n]+", " ")
    # two blanks between words, so that neighbours share none
    flat = F.replace(F.replace(flat, F.lit("\n"), F.lit(" \n ")), F.lit(" "), F.lit("  "))
    flat = F.concat(F.lit(" "), flat, F.lit(" "))
    for one, other in SPELLINGS:
        flat = F.replace(flat, F.lit(f" {one.replace(' ', '  ')} "), F.lit(f" {other.replace(' ', '  ')} "))
    lines = F.transform(F.split(F.replace(flat, F.lit("  "), F.lit(" ")), "\n"), lambda x: F.trim(x))
    return F.filter(lines, lambda x: (x != "") & ~(x.startswith("copyright") & x.rlike(COPYRIGHT_LINE) | (x.startswith("c ") | x.startswith("portions ") | x.startswith("all ")) & x.rlike(COPYRIGHT_LINE)))


def _is_tail(line):
    return (line.startswith("c") | line.startswith("portions") | line.startswith("all rights")) & line.rlike(rf"^(?:{TAIL_LINE})$")


def _body(text, lines):
    """Digest of the canonical text without title and copyright lines in front and copyright lines behind; ``lines`` are the text's canonical lines.

    Lines go one by one, by the end of the last match and by their places, so that no number of them is too deep for a pattern.
    """
    lines = F.when(F.contains(text, F.lit("©")), canonical_lines(F.replace(text, F.lit("©"), F.lit("(c) ")))).otherwise(lines)
    last = F.array_max(F.transform(lines, lambda x, i: F.when(_is_tail(x), F.lit(-1)).otherwise(i)))
    lines = F.slice(lines, F.lit(1), F.coalesce(last, F.lit(-1)) + 1)
    body = F.regexp_replace(F.concat(F.array_join(lines, "\n"), F.lit("\n")), rf"\G(?:{HEAD_LINE})\n", "")
    return F.sha2(F.trim(F.replace(body, F.lit("\n"), F.lit(" "))), 256)


def known_bodies(spark: SparkSession, known: Iterable[tuple[str, str]], full: Iterable[tuple[str, str]]) -> DataFrame:
    """_body, _license: one row per digest of a known text without what stands in front of it."""
    df = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(known)], "i int, license string, text string")
    both = df.select("i", "license", _body(F.col("text"), canonical_lines(F.col("text"))).alias("_body"))
    both = both.union(spark.createDataFrame([(MOST_TEXTS + i, name, digest) for i, (name, digest) in enumerate(full)], "i int, license string, _body string"))
    empty = hashlib.sha256(b"").hexdigest()
    return both.where(F.col("_body") != empty).groupBy("_body").agg(F.min_by("license", "i").alias("_license"))


def known_digests(spark: SparkSession, known: Iterable[tuple[str, str]]) -> DataFrame:
    """digest, license: one row per canonical text; the first licence wins where two have the same."""
    rows = [(i, name, text) for i, (name, text) in enumerate(known)]
    df = spark.createDataFrame(rows, "i int, license string, text string")
    return df.withColumn("digest", F.sha2(F.array_join(canonical_lines(F.col("text")), " "), 256)).groupBy("digest").agg(F.min_by("license", "i").alias("license"))


def scan(spark: SparkSession, docs: DataFrame, known: Iterable[tuple[str, str]] = tuple(KNOWN), text_col: str = "text", full: Iterable[tuple[str, str]] = tuple(FULL)) -> DataFrame:
    """The rows of ``docs`` with canonical_sha256, text_license (of the entire text, or null) and notice_licenses (of its lines; sorted array).

    Null and empty texts, and texts of copyright lines alone, have the digest of
    the empty text and no licence. A line is compared as a whole too: a
    licence's name inside a sentence is no notice. Rows are kept as they are,
    repeated ones too. For text_license, title and copyright lines in front of a licence's text and copyright lines behind it count for nothing, and ``full`` has
    digests of further texts; canonical_sha256 stays that of all lines but plain copyright lines. Columns of ``docs`` that have one of the three names are replaced.

    ``known`` is a configuration list, which is broadcast; its size doesn't
    follow the documents'. There is no exchange.
    """
    known = list(known)
    if len(known) > MOST_TEXTS:
        raise ValueError(f"the list of known licences is meant to be broadcast: {MOST_TEXTS} texts at most")
    lookup = known_digests(spark, known)
    # single-line texts are the notices: few, so that their digests can be literals
    notices = known_digests(spark, [x for x in known if "\n" not in x[1]]).collect()
    docs = docs.drop("canonical_sha256", "text_license", "notice_licenses")
    # the caller's columns go in one struct, so that no name clashes
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), canonical_lines(F.col(text_col)).alias("_lines"))
    out = out.withColumn("canonical_sha256", F.sha2(F.array_join("_lines", " "), 256)).withColumn("_b", _body(F.col("_row")[text_col], F.col("_lines")))
    out = out.join(F.broadcast(lookup.select(F.col("digest").alias("_digest"), F.col("license").alias("_exact"))), F.col("canonical_sha256") == F.col("_digest"), "left")
    out = out.join(F.broadcast(known_bodies(spark, known, full)), F.col("_b") == F.col("_body"), "left")
    if notices:
        names = F.create_map(*[F.lit(x) for r in notices for x in (r.digest, r.license)])
        found = F.transform("_lines", lambda x: F.try_element_at(names, F.sha2(x, 256)))
    else:
        found = F.array().cast("array<string>")
    found = F.array_sort(F.array_distinct(F.filter(found, lambda x: x.isNotNull())))
    return out.select("_row.*", "canonical_sha256", F.coalesce("_exact", "_license").alias("text_license"), found.alias("notice_licenses"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, canonical_sha256, text_license, notice_licenses. Nulls, ties and repeated rows: see scan."""
    out = scan(spark, read(spark, sf_dir, "documents"))
    return out.select("doc_id", "canonical_sha256", "text_license", F.array_join("notice_licenses", ",").alias("notice_licenses"))


def _sql() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"

    def lines(text: str) -> str:
        flat = f"' ' || replace(replace(regexp_replace(lower(coalesce({text}, '')), '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g'), chr(10), ' ' || chr(10) || ' '), ' ', '  ') || ' '"
        for one, other in SPELLINGS:
            flat = f"replace({flat}, {quote(' ' + one.replace(' ', '  ') + ' ')}, {quote(' ' + other.replace(' ', '  ') + ' ')})"
        return f"list_filter(list_transform(string_split(replace({flat}, '  ', ' '), chr(10)), lambda x: trim(x)), lambda x: x <> '' AND NOT regexp_matches(x, {quote(COPYRIGHT_LINE)}))"

    def body(text: str) -> str:
        head, tail = quote(f"^(?:(?:{HEAD_LINE})\n)+"), quote(f"\n(?:(?:{TAIL_LINE})\n)+$")
        flat = f"chr(10) || array_to_string({lines(f'replace({text}, chr(169), {quote("(c) ")})')}, chr(10)) || chr(10)"
        return f"sha256(trim(replace(regexp_replace(ltrim(regexp_replace({flat}, {tail}, chr(10)), chr(10)), {head}, ''), chr(10), ' ')))"

    values = ", ".join(f"({i}, {quote(name)}, {quote(text)})" for i, (name, text) in enumerate(KNOWN))
    full = ", ".join(f"({MOST_TEXTS + i}, {quote(name)}, {quote(digest)})" for i, (name, digest) in enumerate(FULL))
    return f"""
WITH v AS (SELECT * FROM (VALUES {values}) AS v(i, name, text)),
k AS (SELECT sha256(array_to_string({lines('text')}, ' ')) AS digest, arg_min(name, i) AS license, bool_or(text NOT LIKE '%' || chr(10) || '%') AS single FROM v GROUP BY 1),
b AS (SELECT body, arg_min(name, i) AS license FROM (SELECT i, name, {body('text')} AS body FROM v UNION ALL SELECT * FROM (VALUES {full}) AS f(i, name, body)) WHERE body <> sha256('') GROUP BY body),
d AS (SELECT row_number() OVER () AS r, doc_id, {lines('text')} AS ls, {body("coalesce(text, '')")} AS body FROM documents),
n AS (SELECT r, string_agg(DISTINCT license, ',' ORDER BY license) AS found FROM (SELECT r, sha256(unnest(ls)) AS digest FROM d) JOIN k USING (digest) WHERE single GROUP BY r)
SELECT d.doc_id, sha256(array_to_string(ls, ' ')) AS canonical_sha256, coalesce(k.license, b.license) AS text_license, coalesce(n.found, '') AS notice_licenses
FROM d LEFT JOIN k ON k.digest = sha256(array_to_string(ls, ' ')) LEFT JOIN b USING (body) LEFT JOIN n USING (r)
"""


SQL = _sql()
