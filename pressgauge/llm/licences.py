"""License scans by canonical digest: texts that are a known licence, whatever their case, punctuation or spelling.

The canonical form of a text: lower case; lines that state a copyright dropped; everything but letters and digits turned
into single spaces; equivalent spellings made one. Its SHA-256 is looked up by a hash join with the digests of known
licences. Whole documents are looked up, and each of their lines and paragraphs, which is how notices and embedded
licences stand in larger texts. Known texts pass through the same canonical form.

A known text of several paragraphs is known without its leading titles too, with the titles of TITLES, and without what
follows its end mark. It is part of a text that has all its paragraphs (titles aside), in whatever order and company.

Null and empty texts match nothing; a text that is nothing but copyright lines matches nothing; two known texts with one
digest both match. Each text is one row in ``canonical``'s input and is joined by its own number, so repeated rows and
ids stay apart.
"""

from __future__ import annotations

import pkgutil
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Published notices and short licences, with their SPDX names, as plain text.
KNOWN = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "Released under CC0 1.0."),
]
# Entire texts, as published, in the folder licence_texts: one file for each SPDX name.
ENTIRE = ("Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0")
# Other titles that licences go by.
TITLES = {
    "MIT": ("The MIT License", "The MIT License (MIT)", "MIT License (MIT)"), "ISC": ("The ISC License", "ISC License (ISC)"),
    "BSD-2-Clause": ("The BSD 2-Clause License", "Simplified BSD License"), "BSD-3-Clause": ("The BSD 3-Clause License", "New BSD License"),
}
END = re.compile(r"end of (?:the )?terms and conditions", re.I)
TITLE_WORDS = 12
# Spellings that the matching guidelines for licences treat as one (left becomes right).
SAME = [
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sub license", "sublicense"),
    ("non infringement", "noninfringement"), ("organisation", "organization"), ("favour", "favor"), ("honour", "honor"),
    ("colour", "color"), ("judgement", "judgment"), ("per cent", "percent"), ("copyright owner", "copyright holder"),
    ("copyright owners", "copyright holders"), ("https", "http"),
]


def canonical_lines(text: Column) -> Column:
    """Canonical lines, each with a space before and after; copyright lines are gone, blank lines are a single space."""
    t = F.lower(F.coalesce(text, F.lit("")))
    t = F.regexp_replace(t, r"(?m)^[^\p{L}\p{N}\n]*(?:copyright\b|\(c\)|©|all rights reserved)[^\n]*$", "\u0001")
    t = F.regexp_replace(t, r"[^\p{L}\p{N}\n\x01]+", " ")
    t = F.concat(F.lit(" "), F.replace(t, F.lit("\n"), F.lit(" \n ")), F.lit(" "))
    for spelling, one in SAME:
        t = F.replace(t, F.lit(f" {spelling} "), F.lit(f" {one} "))
    return F.filter(F.split(t, "\n"), lambda line: ~F.contains(line, F.lit("\u0001")))


def joined(lines: Column) -> Column:
    return F.trim(F.regexp_replace(F.array_join(lines, " "), " +", " "))


def digest(canonical: Column) -> Column:
    return F.sha2(F.trim(F.regexp_replace(canonical, " +", " ")), 256)


def entire() -> list[tuple[str, str]]:
    return [(name, pkgutil.get_data(__package__, f"licence_texts/{name}.txt").decode()) for name in ENTIRE]


def forms(licence: str, text: str) -> Iterator[tuple[str, bool]]:
    """The forms one text is known by, as (text, whether it is also known by its paragraphs)."""
    yield text, False
    ends = [m.end() for m in END.finditer(text)]
    for body in {text, *(text[:e] for e in ends)}:
        paragraphs = [p for p in re.split(r"\n\s*\n", body.strip()) if re.search(r"\w", p)]
        lead = next((i for i, p in enumerate(paragraphs) if len(p.split()) > TITLE_WORDS), 0)
        if len(paragraphs) - lead < 2:
            continue
        for first in range(lead + 1):
            yield "\n\n".join(paragraphs[first:]), first == lead
        for title in TITLES.get(licence, ()):
            yield "\n\n".join([title, *paragraphs[lead:]]), False


def known(spark: SparkSession, texts: list[tuple[str, str]] | DataFrame | None = None) -> DataFrame:
    """Digests of the known texts: digest, licence; for paragraphs also form, the text they are of, and its number of them.

    ``texts`` is a table (or list) of licence and text, to be known instead of KNOWN and ``entire``. Known texts pass through
    the driver: there are hundreds of licences, not millions.
    """
    if isinstance(texts, DataFrame):
        texts = [(r["licence"], r["text"]) for r in texts.select("licence", "text").collect()]
    spread = [(name, t, pieces) for name, text in (KNOWN + entire() if texts is None else texts) if text for t, pieces in forms(name, text)]
    rows = spark.createDataFrame(spread, "licence string, text string, pieces boolean")
    rows = rows.select("licence", "pieces", canonical_lines(F.col("text")).alias("lines"))
    none = F.lit(None)
    whole = rows.select(F.sha2(joined(F.col("lines")), 256).alias("digest"), "licence", none.cast("string").alias("form"), none.cast("int").alias("of"))
    blocks = F.transform(F.split(F.array_join("lines", "\n"), r"\n\s*\n"), lambda b: digest(F.replace(b, F.lit("\n"), F.lit(" "))))
    pieces = F.array_remove(F.array_distinct(blocks), F.sha2(F.lit(""), 256))
    parts = rows.where("pieces").select(F.sha2(joined(F.col("lines")), 256).alias("form"), "licence", pieces.alias("pieces"))
    parts = parts.select(F.explode("pieces").alias("digest"), "licence", "form", F.size("pieces").alias("of"))
    return whole.unionByName(parts).distinct()


def scan(docs: DataFrame, licences: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` of each text, ``whole`` (licences that the whole text is) and ``parts`` (those of its lines
    and paragraphs), both sorted arrays.

    Texts stay where they are. Only digests meet the table of licences: a join that Spark broadcasts while that table is
    small, and shuffles otherwise. Then one row for each text is gathered.
    """
    kept = [F.col(c).alias(f"kept {i}") for i, c in enumerate(keep)]
    names = [f"kept {i}" for i in range(len(keep))]
    lines = docs.select(*kept, F.monotonically_increasing_id().alias("row"), canonical_lines(F.col(text)).alias("lines"))
    blocks = F.split(F.array_join("lines", "\n"), r"\n\s*\n")  # paragraphs
    paragraphs = F.transform(F.filter(blocks, lambda b: F.contains(b, F.lit("\n"))), lambda b: F.replace(b, F.lit("\n"), F.lit(" ")))
    units = F.concat(
        F.array(F.struct(F.lit(True).alias("whole"), F.sha2(joined(F.col("lines")), 256).alias("digest"))),
        F.transform(F.concat(F.filter("lines", lambda x: F.trim(x) != ""), paragraphs), lambda x: F.struct(F.lit(False).alias("whole"), digest(x).alias("digest"))),
    )
    found = lines.select(*names, "row", F.explode(units).alias("unit")).select(*names, "row", "unit.*").join(licences.where(F.col("digest") != F.sha2(F.lit(""), 256)), "digest", "left")
    text_itself, piece = F.col("form").isNull(), F.struct("form", "of", "licence", "digest")
    gathered = found.groupBy(*names, "row").agg(
        F.sort_array(F.collect_set(F.when(F.col("whole") & text_itself, F.col("licence")))).alias("whole"),
        F.collect_set(F.when(~F.col("whole") & text_itself, F.col("licence"))).alias("parts"),
        F.collect_set(F.when(~F.col("whole") & ~text_itself, piece)).alias("pieces"),
    )
    complete = F.filter("pieces", lambda x: F.size(F.filter("pieces", lambda y: (y["form"] == x["form"]) & (y["licence"] == x["licence"]))) == x["of"])
    parts = F.sort_array(F.array_union("parts", F.transform(complete, lambda x: x["licence"])))
    return gathered.select(*[F.col(f"kept {i}").alias(c) for i, c in enumerate(keep)], "whole", parts.alias("parts"))
