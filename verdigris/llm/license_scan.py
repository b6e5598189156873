"""License scans by diagonal voting.

Templates are short phrases and longer notices. Every rolling k-gram of a document's words is hashed and joined, by Spark, with
the positions at which templates hold that gram (k is ``GRAM`` for notices, two for phrases). A hit is compared word for
word and votes for the diagonal of its template on which it lies: document position less template position. A phrase
stands wherever all its grams vote for one diagonal. For a notice, votes of the diagonals up to ``SLACK`` words away are
merged, as inserted and lost words shift them, and the span is verified if they cover at least ``LEAST`` of its words;
verified diagonals less than half a notice apart are one span, told by the best of them.

The task that reads a document makes its grams, in stretches of ``STRETCH`` words that carry their own text, so that
hits are compared where they are found and no text is shuffled. Votes are grouped by document and input partition: rows alike
in id and text share a result, and no group holds more of them than one task has read.

A null text counts as empty; texts without words have no places, no labels and score 0. Repeated rows get equal results; an empty
table gives an empty result; columns other than doc_id and text are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from verdigris.functions.session import ship_code, short_batches, written
from verdigris.llm.common import sliced, texts_of
from verdigris.llm.decontaminate import words_of

GRAM, PHRASE_GRAM, SLACK, LEAST, STRETCH = 5, 2, 8, 0.8, 256
#: Template grams up to so many are sent to every task; beyond, they are joined by shuffle.
MOST_SENT = 1_000_000
#: A hash that stands for no gram: every document hits it once, so that none is lost.
_DOCUMENT = 0

# The phrases and their labels.
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]
# Published notices and their labels.
NOTICES = [
    (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the "
        "License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is "
        "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License.",
        "apache",
    ),
    (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of "
        "source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above "
        "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "bsd",
    ),
    (
        "This work is licensed under a Creative Commons Attribution 4.0 International License. To view a copy of this license, visit "
        "http://creativecommons.org/licenses/by/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA.",
        "cc-by",
    ),
    (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software "
        "Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "gpl",
    ),
    (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice "
        "and this permission notice appear in all copies.",
        "isc",
    ),
    (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the "
        "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission "
        "notice shall be included in all copies or substantial portions of the Software.",
        "mit",
    ),
    (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one "
        "at https://mozilla.org/MPL/2.0/.",
        "mpl",
    ),
]


class WordHashes(dict):
    """64-bit hashes of words, kept for as many words as ``most``."""

    def __init__(self, most: int = 200_000) -> None:
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        made = self[word] = xxhash.xxh64_intdigest(word)
        return made


def gram_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Rolling hashes of every ``size`` consecutive words, of the words' hashes."""
    count = max(0, len(hashes) - size + 1)
    made = np.zeros(count, dtype=np.uint64)
    for j in range(size):
        made = made * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + count]
    return made.view(np.int64)


def template_words(text: str) -> list[str]:
    return [w.decode() for w in words_of(text)]


def gram_size(words: list[str], size: int = GRAM) -> int:
    """Grams of a template: of ``size`` words, or of two (one) where it has fewer than two such grams."""
    return size if len(words) > size else min(PHRASE_GRAM, len(words))


def template_grams(spark: SparkSession, templates: list[list[str]], size: int) -> DataFrame:
    """hash, template (its number), at, size and gram of every template position, and the hash that stands for a document."""
    rows, hashes = [(_DOCUMENT, -1, 0, 0, "")], WordHashes()
    for t, words in enumerate(templates):
        k = gram_size(words, size)
        codes = gram_hashes(np.array([hashes[w.encode()] for w in words], dtype=np.uint64), k)
        rows += [(int(h), t, i, k, " ".join(words[i : i + k])) for i, h in enumerate(codes)]
    return spark.createDataFrame(rows, "hash long, template int, at int, size int, gram string")


def stretches(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """doc_id, digest (of the text), n_words, begin, words and hashes of each stretch of a document; one at least.

    hashes holds those of all grams that begin in the stretch, size after size; words is its text, with the words that
    its last grams need. The first stretch begins with the hash that stands for the document.
    """
    schema = StructType(docs.select("doc_id").schema.fields + StructType.fromDDL("digest binary, n_words bigint, begin int, words string, hashes array<bigint>").fields)
    arrow, more = to_arrow_schema(schema), max(sizes) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            for part in sliced(batch, most=250_000):
                row, digest, count, begin, words, grams = [], [], [], [], [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    found = words_of(text)
                    codes = np.array([known[w] for w in found], dtype=np.uint64)
                    by_size, seal = [gram_hashes(codes, k) for k in sizes], xxhash.xxh128_digest(text.encode("utf-8", "surrogatepass"))
                    for s in range(0, max(1, len(found)), STRETCH):
                        row.append(i)
                        digest.append(seal)
                        count.append(len(found))
                        begin.append(s)
                        words.append(b" ".join(found[s : s + STRETCH + more]))
                        grams.append(np.concatenate([np.full(int(s == 0), _DOCUMENT), *(x[s : s + STRETCH] for x in by_size)]))
                ends = np.cumsum([0, *map(len, grams)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(grams) if grams else [], pa.int64()))
                arrays = [part.column(0).take(pa.array(row, pa.int32())), pa.array(digest, pa.binary()), pa.array(count, pa.int64()), pa.array(begin, pa.int32()), pa.array(words, pa.binary()).cast(pa.string()), lists]
                yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, arrow)], schema=arrow)

    return docs.mapInArrow(run, schema)


def votes(docs: DataFrame, templates: list[list[str]], size: int = GRAM) -> DataFrame:
    """task, doc_id, digest, n_words, template, diagonal, ats (template positions that vote for it) and n.

    The row of template -1 stands for the document, n being the number of rows alike in the task.
    """
    spark = docs.sparkSession
    ship_code(spark)
    short_batches(spark)
    grams = template_grams(spark, templates, size)
    if sum(map(len, templates)) <= MOST_SENT:
        grams = F.broadcast(grams)
    sizes = sorted({gram_size(w, size) for w in templates} or {size})
    rows = stretches(texts_of(docs), sizes).withColumn("task", F.spark_partition_id())
    # Grams of a size fill the list up to the last word that begins one; the next size follows.
    hits = rows.select("*", F.posexplode("hashes").alias("place", "hash")).drop("hashes").join(grams, "hash")
    place, first = F.col("place") - F.when(F.col("begin") == 0, 1).otherwise(0), F.lit(0)
    at = F.lit(None).cast("long")
    for k in sizes:
        at = F.when(F.col("size") == k, place - first).otherwise(at)
        first = first + F.least(F.lit(STRETCH), F.greatest(F.col("n_words") - k + 1 - F.col("begin"), F.lit(0)))
    hits = hits.withColumn("word", F.coalesce(at, F.lit(0)).cast("int"))
    same = ((F.col("size") == 0) & (F.col("place") == 0) & (F.col("begin") == 0)) | ((F.col("size") > 0) & (F.col("word") >= 0) & (F.array_join(F.slice(F.split("words", " "), F.greatest("word", F.lit(0)) + 1, F.col("size")), " ") == F.col("gram")))
    hits = hits.where(same).withColumn("diagonal", F.when(F.col("size") == 0, 0).otherwise(F.col("begin") + F.col("word") - F.col("at")).cast("int"))
    return hits.groupBy("task", "doc_id", "digest", "n_words", "template", "diagonal").agg(F.collect_set("at").alias("ats"), F.count(F.lit(1)).alias("n"))


def _by_template(values: list, kind: str) -> Column:
    """A value of each template, by its number."""
    return F.get(F.array(*map(F.lit, values)).cast(f"array<{kind}>"), F.col("template"))


def scan_licenses(
    docs: DataFrame, phrases: list[tuple[str, str]] = PHRASES, notices: list[tuple[str, str]] = NOTICES, size: int = GRAM, slack: int = SLACK, least: float = LEAST
) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and spans of every document.

    n_base counts the places of phrases; first_word and last_word are their smallest and largest start. spans lists
    the verified notices as label:first:last (word numbers). score is 1 with a phrase, else the largest share of a notice covered.
    Templates without a word are left out.
    """
    told = [(words, label, base) for group, base in ((phrases, True), (notices, False)) for text, label in group if (words := template_words(text))]
    templates, document = [w for w, _, _ in told], ["task", "doc_id", "digest"]
    found = written(votes(docs, templates, size))
    length, labelled = _by_template([len(w) for w in templates], "int"), _by_template([x for _, x, _ in told], "string")
    grams, phrase = _by_template([len(w) - gram_size(w, size) + 1 for w in templates], "int"), _by_template([b for _, _, b in told], "boolean")
    k = _by_template([gram_size(w, size) for w in templates], "int")
    whole = found.where((F.col("template") >= 0) & phrase & (F.size("ats") == grams)).select(*document, F.col("diagonal").alias("start"), labelled.alias("base_label"))

    rows = found.where((F.col("template") >= 0) & ~phrase).select(*document, "template", "diagonal", "ats", length.alias("length"), k.alias("k"), labelled.alias("label"))
    around = Window.partitionBy(*document, "template").orderBy("diagonal").rangeBetween(-slack, slack)
    begins = F.transform("ats", lambda a: F.col("diagonal") + a)
    rows = rows.select("*", F.flatten(F.collect_list("ats").over(around)).alias("all"), F.min(F.array_min(begins)).over(around).alias("first"), (F.max(F.array_max(begins)).over(around) + F.col("k") - 1).alias("last"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("all", lambda a: F.sequence(a, a + F.col("k") - 1)))))
    rows = rows.select(*document, "template", "diagonal", "label", "length", "first", "last", (covered / F.col("length")).alias("share"))
    before = Window.partitionBy(*document, "template").orderBy("diagonal")
    apart = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(before)) * 2 >= F.col("length"), F.lit(True))
    sure = rows.where(F.col("share") >= least).withColumn("span", F.sum(apart.cast("int")).over(before))
    best = F.max_by(F.struct("first", "last", "label"), F.struct("share", -F.col("diagonal"))).alias("b")
    spans = sure.groupBy(*document, "template", "span").agg(best).select(*document, F.col("b.label").alias("label"), F.struct("b.first", "b.last", "b.label").alias("place"))

    seen = found.where("template = -1").select(*document, "n_words", "n")
    parts = seen.unionByName(whole, True).unionByName(rows.select(*document, "share"), True).unionByName(spans, True)
    by_document = parts.groupBy(*document).agg(
        F.max("n_words").alias("n_words"), F.max("n").alias("n"), F.count("start").alias("n_base"), F.min("start").cast("long").alias("first_word"), F.max("start").cast("long").alias("last_word"),
        F.collect_set("base_label").alias("base_labels"), F.collect_set("label").alias("labels"), F.max("share").alias("share"), F.array_sort(F.collect_list("place")).alias("places"),
    )
    joined = lambda labels: F.array_join(F.array_sort(labels), ",")
    result = by_document.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", joined(F.col("base_labels")).alias("base_labels"), joined(F.array_union("base_labels", "labels")).alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
        F.array_join(F.transform("places", lambda p: F.concat_ws(":", p["label"], p["first"].cast("string"), p["last"].cast("string"))), ",").alias("spans"), "n",
    )
    return result.withColumn("n", F.explode(F.sequence(F.lit(1), F.col("n")))).drop("n")
