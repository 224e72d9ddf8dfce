"""Operator 9: licence texts by canonical digest, in DataFrame operations only."""

from __future__ import annotations

import re
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words that count as equal (the usual list of equivalent words), replaced in canonical texts.
WORDS = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact", "authoris": "authoriz",
    "calibre": "caliber", "cancelled": "canceled", "capitalis": "capitaliz", "catalogue": "catalog", "categoris": "categoriz",
    "centre": "center", "copyright owner": "copyright holder", "emphasis": "emphasiz", "favour": "favor", "fulfill": "fulfil",
    "initialis": "initializ", "judgement": "judgment", "labelling": "labeling", "labour": "labor", "licence": "license",
    "maximis": "maximiz", "modelled": "modeled", "modelling": "modeling", "non commercial": "noncommercial", "offence": "offense",
    "optimis": "optimiz", "organis": "organiz", "per cent": "percent", "practise": "practice", "programme": "program",
    "realis": "realiz", "recognis": "recogniz", "signalling": "signaling", "sub license": "sublicense", "utilis": "utiliz",
    "whilst": "while", "wilful": "willful",
}
#: Patterns and replacements that make equal licence texts equal, in this order. They
#: are written so that Java's and RE2's expressions agree. A line goes as a copyright line only if it
#: has a year, its placeholder or (c): the word may begin a line of a wrapped licence text.
RULES = [
    ("\r\n?", "\n"),
    ("(?m)^[^a-z0-9\n(©]*(copyright[^\n]*([0-9]{4}|\\(c\\)|©|[\\[<{]y)|\\(c\\)[^\n]*[0-9]{4}|©)[^\n]*$", " "),
    ("all rights reserved\\.?", " "),
    ("https?://", " "),
    ("[^a-z0-9à-ɏ]+", " "),
    ("neither the names? of .{1,100}? nor the names of (its|their|any) contributors", "neither the name of holder nor contributors"),
    ("software is provided by .{1,100}? as is", "software is provided by holders as is"),
    ("in no event shall .{1,100}? be liable", "in no event shall holders be liable"),
    *WORDS.items(),
]

#: Short public notices and full texts, by name.
MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
    "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
    "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
    "notice and this permission notice shall be included in all copies or substantial portions of the Software. THE "
    "SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS "
    "OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
ISC_GRANT = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS "
    "PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
    "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, "
    "OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION "
    "OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS "
    "SOFTWARE."
)
KNOWN = {
    "MIT": [MIT_GRANT, "MIT License\n\n" + MIT_GRANT, "The MIT License (MIT)\n\n" + MIT_GRANT, "Released under the MIT License."],
    "ISC": [ISC_GRANT, "ISC License\n\n" + ISC_GRANT],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
}
#: Names of the whole texts in license_texts; those of the first list end in notes on how to apply them.
NOTED = ["Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1"]
WHOLE = [*NOTED, "LGPL-3.0", "MPL-2.0", "CC0-1.0", "BSD-2-Clause", "BSD-3-Clause"]
TERMS_END = "END OF TERMS AND CONDITIONS"


def _whole(name: str) -> list[str]:
    """A whole text, also without its notes, and with list marks or a title where texts have them."""
    text = resources.files("optrace.llm").joinpath(f"license_texts/{name}.txt").read_text("utf-8")
    if name in NOTED:
        terms = text[: text.index(TERMS_END)]
        return [text, terms + TERMS_END, terms]
    if name.startswith("BSD"):
        forms = [text, re.sub(r"(?m)^[1-3]\. ", "* ", text)]
        n = name[4]
        titles = ["", f"BSD {n}-Clause License\n\n", f"The BSD {n}-Clause License\n\n", {"2": 'Simplified BSD License\n\n', "3": "New BSD License\n\n"}[n]]
        return [title + form for title in titles for form in forms]
    return [text]


for _name in WHOLE:
    KNOWN[_name] = KNOWN.get(_name, []) + _whole(_name)


def canonical(text: Column) -> Column:
    text = F.lower(text)
    for pattern, replacement in RULES:
        plain = pattern in WORDS  # nothing but letters and spaces
        text = F.replace(text, F.lit(pattern), F.lit(replacement)) if plain else F.regexp_replace(text, pattern, replacement)
    return F.trim(text)


def known_digests(spark: SparkSession, known: dict[str, list[str]] = KNOWN) -> DataFrame:
    """(digest, license) of texts by licence name."""
    rows = [(name, text) for name, texts in known.items() for text in texts]
    found = spark.createDataFrame(rows, "license string, text string")
    return found.select(F.sha2(canonical(F.col("text")), 256).alias("digest"), "license").groupBy("digest").agg(F.min("license").alias("license"))


def license_scan(documents: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, digest, license) of every row: digest of the canonical whole text and the licence
    with that digest in known (digest, license), null where there is none. Null texts have no
    digest; a text that is nothing but marks and copyright lines has the digest of the empty
    text and no licence. known holds a fixed list, a row per digest."""
    found = documents.select("doc_id", canonical(F.col("text")).alias("text"))
    found = found.select("doc_id", F.sha2("text", 256).alias("digest"), F.when(F.col("text") != "", F.sha2("text", 256)).alias("key"))
    known = known.select(F.col("digest").alias("key"), "license")
    return found.join(known, "key", "left").select("doc_id", "digest", "license")


def license_passages(documents: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, license, n) for each row of documents and each licence of which it, one of its blocks
    (between blank lines) or one of its lines is a whole text; n counts the parts that are, the
    same part of the same row once. Rows without such a part give no row."""
    text = F.regexp_replace("text", "\r\n?", "\n")
    parts = F.concat(F.array(text), F.split(text, "\n[ \t]*\n\\s*"), F.split(text, "\n"))
    digests = F.array_distinct(F.transform(F.array_distinct(parts), lambda x: F.sha2(canonical(x), 256)))
    found = documents.filter("text IS NOT NULL").select("doc_id", F.monotonically_increasing_id().alias("_row"), F.explode(digests).alias("digest"))
    return found.join(known.select("digest", "license"), "digest").groupBy("_row", "doc_id", "license").agg(F.count(F.lit(1)).alias("n")).drop("_row")
