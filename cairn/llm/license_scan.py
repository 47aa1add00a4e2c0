"""Licence scan: canonical digests of whole texts, looked up in a table of known licence texts.

A text's canonical form drops copyright lines, lower-cases, spells variants alike, and keeps letters and digits
with single spaces between. Its SHA-256 is hash-joined to the digests of known texts. Two kinds of entire texts are looked up:
the document itself, and each of its lines. A known text of BODY_WORDS words or more, which seldom stands on one line, is also
found inside a longer document, word for word and however it is wrapped. DataFrame functions only.

Known texts are few (a table of fixed size), so their side is broadcast; a table above spark.sql.autoBroadcastJoinThreshold
is joined by shuffled digests instead, which is spread evenly but for a much-used line; digests are made distinct
per document before the join. Known bodies go to every task, and each document is searched for each of them.

Edge cases: null and empty texts match nothing; a document has each licence once, sorted; repeated rows are scanned each;
with no known texts nothing matches; further columns are not read.
"""

from __future__ import annotations

import pkgutil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import texts, written

BODY_WORDS = 60

_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
    "{} OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED "
    "TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY "
    "OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_TWO = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "{}Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "{}Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. "
)
_THIRD = (
    "{}Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission. "
)
_MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS "
    "IN THE SOFTWARE."
)
# Two ways to wrap it: a line that begins with "copyright" is dropped.
_ISC = [
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above"
    + cut
    + 'copyright notice and this permission notice appear in all copies.\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH '
    "REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
    "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
    "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    for cut in " \n"
]
_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives"} | {
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
    "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}


def _titled(license_id: str, titles: list[str], body: str) -> list[tuple[str, str]]:
    """A body, alone and under each title: as a whole text it has either form."""
    return [(license_id, f"{t}\n{body}") for t in ["", *titles]]


def _bsd() -> list[tuple[str, str]]:
    out = []
    for holder in ("HOLDER", "OWNER", "HOLDERS"):
        for a, b, c in (("1. ", "2. ", "3. "), ("* ", "* ", "* ")):
            for rights in ("", "All rights reserved.\n"):
                two, warranty = rights + _TWO.format(a, b), _WARRANTY.format(holder)
                out += _titled("BSD-2-Clause", ["BSD 2-Clause License"], two + warranty)
                out += _titled("BSD-3-Clause", ["BSD 3-Clause License"], two + _THIRD.format(c) + warranty)
    return out


# Short notices of public licences, and whole texts.
KNOWN = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("BSD-3-Clause", "Distributed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Distributed under the BSD 2-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("ISC", "Released under the ISC License."),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    *((f"CC-{k}-4.0", f"{start} CC {k} 4.0.") for k in _CC for start in ("Licensed under", "This work is licensed under")),
    *((f"CC-{k}-4.0", f"This work is licensed under a Creative Commons {name} 4.0 International License.") for k, name in _CC.items() if k not in ("BY", "BY-SA")),
    *_titled("MIT", ["MIT License", "The MIT License", "The MIT License (MIT)"], _MIT),
    *_bsd(),
    *(x for body in _ISC for x in _titled("ISC", ["ISC License"], body)),
    *((k, pkgutil.get_data(__package__, f"known_texts/{k}.txt").decode()) for k in ("Apache-2.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0")),
]
# Spellings that mean the same.
SPELLINGS = [("licence", "license"), ("licenced", "licensed"), ("sub license", "sublicense"), ("noncommercial", "non commercial"), ("organisation", "organization")]


def _spelled(text: Column) -> Column:
    for old, new in SPELLINGS:
        text = F.replace(text, F.lit(f" {old} "), F.lit(f" {new} "))
    return text


def _without_copyright(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"(?m)^\s*(copyright|©|\(c\))[^\n]*$", "")


def canonical(text: Column) -> Column:
    """Lower case, no copyright lines, no punctuation, one spelling, single spaces."""
    x = F.trim(F.regexp_replace(_without_copyright(text), r"[^\p{L}\p{N}]+", " "))
    return F.trim(_spelled(F.concat(F.lit(" "), x, F.lit(" "))))


def words_in_lines(text: Column) -> Column:
    """The text without copyright lines and punctuation, its lines kept: what canonical and canonical_lines are made from."""
    return F.regexp_replace(_without_copyright(text), r"[^\p{L}\p{N}\n]+", " ")


def canonical_of(x: Column) -> Column:
    """canonical of a text from its words_in_lines."""
    return F.trim(_spelled(F.concat(F.lit(" "), F.trim(F.regexp_replace(x, r"[ \n]+", " ")), F.lit(" "))))


def canonical_lines(x: Column) -> Column:
    """The distinct canonical forms of a text's lines, from its words_in_lines: gone through once, not line by line."""
    x = _spelled(F.concat(F.lit(" "), F.replace(x, F.lit("\n"), F.lit(" \n ")), F.lit(" ")))
    return F.filter(F.array_distinct(F.transform(F.split(x, "\n", -1), lambda y: F.trim(y))), lambda y: y != "")


def canonical_texts(known: DataFrame) -> DataFrame:
    """license_id and c, the canonical form, of each distinct known text with a word."""
    return known.select("license_id", canonical(F.coalesce("text", F.lit(""))).alias("c")).where("c != ''").distinct()


def known_licenses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(KNOWN, "license_id string, text string")


def license_scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """doc_id, licenses (comma-joined, sorted), n_licenses and whole_text of each row.

    whole_text: the document as a whole is a known text.
    """
    known = canonical_texts(known_licenses(docs.sparkSession) if known is None else known)
    long = known.where(F.size(F.split("c", " ")) >= BODY_WORDS)
    every = long.agg(F.collect_set(F.struct("license_id", F.concat(F.lit(" "), "c", F.lit(" ")).alias("c"))).alias("every"))
    # A body that holds another of its licence (under a title) need not be looked for: the other is found as well.
    holds = lambda b: F.exists("every", lambda o: (o["license_id"] == b["license_id"]) & (o["c"] != b["c"]) & F.contains(b["c"], o["c"]))
    bodies = every.select(F.array_distinct(F.transform(F.filter("every", lambda b: ~holds(b)), lambda b: b["c"])).alias("bodies"))
    # Rows get their keys in a written table: computed twice, keys need not be the same where rows come by a shuffle.
    keyed = written(texts(docs).select(F.monotonically_increasing_id().alias("row"), "*"), "rows")
    # Made below the join: above it they would be made again for every body.
    row = keyed.select("row", words_in_lines(F.col("text")).alias("x")).withColumn("c", canonical_of(F.col("x")))
    row = row.withColumn("padded", F.concat(F.lit(" "), "c", F.lit(" "))).crossJoin(F.broadcast(bodies))
    unit_of = lambda c, whole: F.struct(F.sha2(c, 256).alias("digest"), F.lit(whole).alias("whole"))
    inside = F.transform(F.filter("bodies", lambda b: (F.octet_length(b) <= F.octet_length("padded")) & F.contains(F.col("padded"), b)), lambda b: F.trim(b))
    # Each line, each body inside, and the whole text, marked.
    units = F.concat(F.transform(F.concat(canonical_lines(F.col("x")), inside), lambda x: unit_of(x, False)), F.array(unit_of(F.col("c"), True)))
    # Outer: a plain explode would test the array first, and so make it again.
    unit = row.select("row", F.explode_outer(units).alias("u")).select("row", "u.digest", "u.whole")
    found = unit.join(known.select("license_id", F.sha2("c", 256).alias("digest")), "digest").groupBy("row").agg(F.array_sort(F.collect_set("license_id")).alias("ids"), F.max("whole").alias("whole"))
    return keyed.select("row", "doc_id").join(found, "row", "left").select(
        "doc_id",
        F.coalesce(F.array_join("ids", ","), F.lit("")).alias("licenses"),
        F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_licenses"),
        F.coalesce("whole", F.lit(False)).alias("whole_text"),
    )
