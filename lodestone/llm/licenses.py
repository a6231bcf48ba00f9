"""License scans by diagonal voting, with DataFrame operations only.

Templates and documents are words (runs of letters, digits and non-ASCII characters, A-Z in lower case).  Every rolling
k-gram of a document's words is hashed and joined to the templates' k-gram positions; the tables of those are built from
the templates below, so their size is fixed and they are broadcast.  Short templates, phrases and notices, have grams of
SHORT words; license texts have grams of LONG words.  A hit is verified word by word at once, so equal hashes of
different words never vote, and votes for a diagonal: the document's position less the template's.  Votes are summed by
document, template and diagonal in the scan's own tasks before they are exchanged.

Each diagonal with every vote of a short template is a place where its words stand consecutively.  For license texts,
diagonals at most GAP apart, as insertions and deletions make them, are merged, and a merged span counts as its
template's license if enough of the template's grams voted for it within a span not much longer than the template.

The work for a text grows with its length: a gram carries its own words, never the whole text's.

Null text has no words; documents under SHORT words have no hits; repeated rows are kept, each with its own result; an
empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SHORT, LONG, GAP = 3, 5, 3
#: Share of a template's grams that must vote, and words of span allowed for each of the template's.
COVERAGE, STRETCH = 0.6, 1.5
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Phrases that count wherever they stand, and their labels.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
# Notices that name a license where their words stand consecutively, and their labels.
NOTICES = (
    ("licensed under the gnu general public license version 3", "gpl-3"),
    ("licensed under cc by", "cc-by"),
    ("licensed under cc by sa", "cc-by-sa"),
    ("subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("creative commons attribution 4 0 international license", "cc-by"),
    ("creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("all rights reserved", "all-rights-reserved"),
)
# Texts of public licenses, and their labels.
TEXTS = (
    (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
        "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The "
        "above copyright notice and this permission notice shall be included in all copies or substantial portions of "
        "the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT "
        "NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO "
        "EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN "
        "AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE "
        "OR OTHER DEALINGS IN THE SOFTWARE.",
        "mit",
    ),
    (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, "
        "this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the "
        "above copyright notice, this list of conditions and the following disclaimer in the documentation and/or "
        "other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND "
        "CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED "
        "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
        "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR "
        "CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF "
        "USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN "
        "CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
        "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
        "bsd",
    ),
    (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE "
        "SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL "
        "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
        "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR "
        "PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
        "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
        "isc",
    ),
    (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on "
        "an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for "
        "the specific language governing permissions and limitations under the License.",
        "apache-2",
    ),
    (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
        "GNU General Public License for more details. You should have received a copy of the GNU General Public "
        "License along with this program. If not, see https://www.gnu.org/licenses/.",
        "gpl-3",
    ),
    (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
        "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
        "for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright "
        "laws, the author or authors of this software dedicate any and all copyright interest in the software to the "
        "public domain. We make this dedication for the benefit of the public at large and to the detriment of our "
        "heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all "
        "present and future rights to this software under copyright law.",
        "unlicense",
    ),
)
CANDIDATES = "array<struct<template:int,at:int,gram:array<string>>>"


def words(text: Column) -> Column:
    """Words in order.  Only two characters have an ASCII letter in their lower case; texts with those are spelled out."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    folded = F.when(text.contains("\u212a") | text.contains("\u0130"), F.translate(text, upper, lower)).otherwise(F.lower(text))
    return F.regexp_extract_all(folded, F.lit(WORDS), F.lit(0))


def template_words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def template_table(spark: SparkSession, every: Sequence[tuple[list[str], str, int]]) -> DataFrame:
    """(template, kind, label, w): templates as literals of the plan."""
    rows = F.array(*[F.struct(F.lit(i).alias("template"), F.lit(kind).alias("kind"), F.lit(label).alias("label"), F.lit(" ".join(w)).alias("text")) for i, (w, label, kind) in enumerate(every)])
    return spark.range(1, numPartitions=1).select(F.explode(rows).alias("t")).select("t.template", "t.kind", "t.label", F.split("t.text", " ").alias("w"))


def known_grams(templates: DataFrame, k: int, name: str) -> DataFrame:
    """(name, <name>_known): a row for each hash of a k-gram of the templates, with where they stand."""
    grams = F.transform(F.sequence(F.lit(0), F.size("w") - k), lambda i: F.slice("w", i + 1, F.lit(k)))
    made = templates.select("template", F.posexplode(grams).alias("at", "gram"))
    hashed = made.select(F.xxhash64(*[F.get("gram", j) for j in range(k)]).alias(name), F.struct("template", "at", "gram").alias("known"))
    return hashed.groupBy(name).agg(F.collect_list("known").alias(f"{name}_known"))


def scan(docs: DataFrame, phrases=PHRASES, notices=NOTICES, texts=TEXTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, and spans (label, first, last word).

    score is the greatest share of a license text's grams that voted for one place, and 1 where a short template stands.
    """
    spark = docs.sparkSession
    every = [(template_words(t), label, kind) for kind, given in enumerate((phrases, notices, texts)) for t, label in given]
    if any(len(w) < (LONG if kind == 2 else SHORT) for w, _, kind in every):
        raise ValueError(f"phrases and notices have {SHORT} words or more, license texts {LONG}")
    made = template_table(spark, every)
    short = F.broadcast(known_grams(made.where("kind < 2"), SHORT, "short"))
    long = F.broadcast(known_grams(made.where("kind = 2"), LONG, "long"))
    grams = F.size("w") - F.when(F.col("kind") == 2, LONG).otherwise(SHORT) + 1
    about = F.broadcast(made.select("template", "kind", "label", grams.alias("grams"), F.size("w").alias("size")))

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), words(text).alias("w"))
    # the words' number is a column of its own before they are exploded, so that the words themselves don't go along
    rows = rows.select("doc_id", "row", F.size("w").alias("n_words"), "w")
    word = lambda i, j: F.get("w", i + j)
    gram = lambda i: F.struct(
        F.xxhash64(*[word(i, j) for j in range(SHORT)]).alias("short"), F.xxhash64(*[word(i, j) for j in range(LONG)]).alias("long"), F.slice("w", i + 1, F.lit(LONG)).alias("gram")
    )
    # the row at position -1 stands for the document, whatever it holds
    none = F.struct(F.lit(None).cast("long").alias("short"), F.lit(None).cast("long").alias("long"), F.lit(None).cast("array<string>").alias("gram"))
    grams = F.concat(F.array(none), F.when(F.size("w") >= SHORT, F.transform(F.sequence(F.lit(0), F.size("w") - SHORT), gram)).otherwise(F.array().cast("array<struct<short:bigint,long:bigint,gram:array<string>>>")))
    each = rows.select("doc_id", "row", "n_words", F.posexplode(grams).alias("pos", "g"))
    each = each.select("doc_id", "row", "n_words", (F.col("pos") - 1).alias("pos"), "g.short", "g.long", "g.gram")
    met = each.join(short, "short", "left").join(long, "long", "left").where((F.col("pos") < 0) | F.col("short_known").isNotNull() | F.col("long_known").isNotNull())
    nothing = F.array().cast(CANDIDATES)
    same = F.filter(F.concat(F.coalesce("short_known", nothing), F.coalesce("long_known", nothing)), lambda c: c["gram"] == F.slice("gram", F.lit(1), F.size(c["gram"])))
    key = ["row", "doc_id", "n_words"]
    hits = met.select(*key, "pos", F.explode_outer(same).alias("c")).where((F.col("pos") < 0) | F.col("c").isNotNull())
    hits = hits.select(*key, "pos", F.col("c.template").alias("template"), (F.col("pos") - F.col("c.at")).alias("diagonal"))
    votes = hits.groupBy(*key, "template", "diagonal").agg(F.count("template").alias("votes"), F.min("pos").alias("low"), F.max("pos").alias("high"))
    votes = votes.join(about, "template", "left")

    near = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(near)
    # a short template's diagonals stay apart, and so does one with all votes of its template: each is a place of its own
    whole = F.col("votes") == F.col("grams")
    begins = F.when(F.col("template").isNull() | (F.col("kind") < 2) | apart.isNull() | (apart > GAP) | whole | F.lag(whole).over(near), 1).otherwise(0)
    grouped = votes.withColumn("begins", begins).withColumn("cluster", F.sum("begins").over(near))
    spans = grouped.groupBy(*key, "template", "kind", "label", "grams", "size", "cluster").agg(F.sum("votes").alias("votes"), F.min("low").alias("low"), F.max("high").alias("high"))
    last = F.col("high") + F.when(F.col("kind") == 2, LONG).otherwise(SHORT) - 1
    share = F.least(F.col("votes") / F.col("grams"), F.lit(1.0))
    fits = last - F.col("low") + 1 <= STRETCH * F.col("size")
    placed = (F.col("kind") < 2) & (F.col("votes") == F.col("grams"))
    good = F.coalesce(placed | ((F.col("kind") == 2) & (share >= COVERAGE) & fits), F.lit(False))
    base = F.coalesce(placed & (F.col("kind") == 0), F.lit(False))
    marked = spans.withColumns({"base": base, "good": good, "share": share, "last": last})
    span = F.struct(F.col("low").cast("long").alias("first"), F.col("last").cast("long").alias("last"), "label")
    labels = lambda when, name: F.array_join(F.array_sort(F.collect_set(F.when(when, F.col("label")))), ",").alias(name)
    return marked.groupBy("row", "doc_id", "n_words").agg(
        F.count_if("base").alias("n_base"),
        F.min(F.when(F.col("base"), F.col("low"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("base"), F.col("low"))).cast("long").alias("last_word"),
        labels(F.col("base"), "base_labels"),
        labels(F.col("good"), "labels"),
        F.coalesce(F.max(F.when(F.col("good") | (F.col("kind") == 2), F.col("share"))), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_list(F.when(F.col("good"), span))).alias("spans"),
    ).drop("row").withColumn("n_words", F.col("n_words").cast("long"))
