"""License scans by diagonal voting of word k-grams against notice templates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colinear.llm.words import alnum, column
from colinear.session import stored, table

# The phrases of the contract and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Public notice texts.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "Released under the MIT License."),
    ("mit", "This project is licensed under the terms of the MIT license"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-2", "Licensed under the Apache License, Version 2.0."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl", "licensed under the GNU General Public License, version 3"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("apache-2", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsl-1", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software"),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("gpl", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("epl-2", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("cc-by-nd", "This work is licensed under a Creative Commons Attribution NoDerivatives 4.0 International License"),
    ("ofl-1", "This Font Software is licensed under the SIL Open Font License, Version 1.1"),
    ("all-rights-reserved", "all rights reserved no part of this publication may be reproduced"),
]

GRAM = 4
#: Diagonals this close, with hits this near in the text, are one span.
SLACK, REACH = 3, 12
#: Share of a template's words that a span covers at least, up to SHORT words and beyond.
COVER_SHORT, COVER_LONG, SHORT = 0.8, 0.5, 24


def _gram_hashes(values: np.ndarray) -> np.ndarray:
    """Rolling hashes of GRAM words, from the words' hashes."""
    n = max(0, len(values) - GRAM + 1)
    out = np.full(n, GRAM, np.uint64)
    for i in range(GRAM):
        out = (out ^ values[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("doc_id").cast("long"), F.col("text")).alias("row_key"), F.col("text").cast("binary").alias("text"))


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """(doc_id, text) -> a row for each document with its phrase counts."""
    needles = [(b" " + p.encode() + b" ", label) for p, label in phrases.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, row_key, text in zip(column(batch, "doc_id"), column(batch, "row_key"), column(batch, "text")):
                words = alnum(text)
                joined = b" " + b" ".join(words) + b" "
                places = []
                for needle, label in needles:
                    at, read, word = joined.find(needle), 0, 0
                    while at >= 0:
                        word += joined.count(b" ", read, at)
                        read = at
                        places.append((word, label))
                        at = joined.find(needle, at + 1)
                starts = [p for p, _ in places]
                rows.append({"doc_id": doc_id, "row_key": row_key, "n_words": len(words), "n_base": len(places), "first_word": min(starts, default=None), "last_word": max(starts, default=None), "base": sorted({x for _, x in places})})
            yield pa.RecordBatch.from_pylist(rows, schema=_SCANNED)

    return _keyed(docs).mapInArrow(run, "doc_id long, row_key long, n_words long, n_base long, first_word long, last_word long, base array<string>")


_SCANNED = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base", pa.list_(pa.string()))])
_CACHED = 500_000


def rolling_grams(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (row_key, grams): the hash of every run of GRAM words of the whole text, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            keys, grams = column(batch, "row_key"), []
            for text in column(batch, "text"):
                words = alnum(text)
                if len(known) > _CACHED:
                    known.clear()
                for w in words:
                    if w not in known:
                        known[w] = xxhash.xxh64_intdigest(w)
                grams.append(_gram_hashes(np.fromiter(map(known.__getitem__, words), np.uint64, len(words))))
            offsets = np.cumsum([0, *map(len, grams)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *grams])))], ["row_key", "grams"])

    return _keyed(docs).select("row_key", "text").mapInArrow(run, "row_key long, grams array<long>")


def template_positions(spark: SparkSession, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(template, label, size, at, h): every k-gram of every template with its word position."""
    rows = []
    for k, (label, t) in enumerate(templates):
        words = alnum(t.encode())
        hashes = _gram_hashes(np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64))
        rows += [(k, label, len(words), i, h) for i, h in enumerate(hashes.tolist())]
    return spark.createDataFrame(rows, "template int, label string, size int, at int, h long")


def spans(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """Verified spans: (row_key, label, template, start, stop, cover). All rolling k-grams join the templates' positions."""
    positions = template_positions(docs.sparkSession, templates)
    hits = stored(rolling_grams(docs).select("row_key", F.posexplode("grams").alias("pos", "h")).join(F.broadcast(positions), "h").drop("h"))  # constants: some hundred rows
    votes = (
        hits
        .groupBy("row_key", "template", "label", "size", (F.col("pos") - F.col("at")).alias("diagonal"))
        .agg(F.collect_set("at").alias("ats"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    )
    ordered = Window.partitionBy("row_key", "template").orderBy("diagonal", "lo")
    apart = (F.col("diagonal") - F.lag("diagonal").over(ordered) > SLACK) | (F.col("lo") - F.lag("hi").over(ordered) > REACH) | (F.lag("lo").over(ordered) - F.col("hi") > REACH)
    merged = votes.withColumn("span", F.sum(F.coalesce(apart.cast("int"), F.lit(1))).over(ordered)).groupBy("row_key", "template", "label", "size", "span").agg(F.array_distinct(F.flatten(F.collect_list("ats"))).alias("ats"), F.min("lo").alias("start"), F.max("hi").alias("hi"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("ats", lambda a: F.sequence(a, a + GRAM - 1)))))
    cover = covered / F.greatest("size", F.col("hi") + GRAM - F.col("start") - SLACK)
    least = F.when(F.col("size") <= SHORT, COVER_SHORT).otherwise(COVER_LONG)
    return merged.withColumn("cover", F.least(F.lit(1.0), cover)).where(F.col("cover") >= least).select("row_key", "label", "template", "start", (F.col("hi") + GRAM).alias("stop"), "cover")


def license_labels(docs: DataFrame) -> DataFrame:
    """documents -> doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score; a row for each row.

    Null and empty texts have no words, empty label strings and score 0. Repeated rows each give their row;
    extra columns are ignored. score: 1 with a base phrase, else the best cover of a verified span, else 0.
    """
    scanned = stored(scan(docs))
    found = spans(docs).groupBy("row_key").agg(F.collect_set("label").alias("more"), F.max("cover").alias("cover"))
    joined = scanned.join(found, "row_key", "left")
    labels = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    return joined.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("cover", F.lit(0.0))).alias("score"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_labels(table(spark, sf_dir, "documents"))
