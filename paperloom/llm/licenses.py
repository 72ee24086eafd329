"""License scans: an exact set-similarity join of text blocks with license templates, in DataFrame functions only.

Tokens are runs of RUN words, read across lines, punctuation and comment marks, so it doesn't matter where a text is wrapped. For a
template of up to L words (L a power of two) the blocks of a text are the windows of 2L run places, L apart: a text that holds the
template holds it whole in one of them. A block meets a template if it holds at least the fraction `containment` of the template's
distinct runs; runs of no template play no part. The join is exact:

- tokens are ordered by their number of places in all texts, rarest first, and sets are kept as sorted ranks;
- prefix filter: a block that holds o of a template's n runs shares one of the template's first n - o + 1;
- length filter: a block with fewer than o runs of templates can't;
- positional filter: after the first run that they share, at place i of the template and j of the block's m runs, at most
  min(n - i, m - j) can be common, that one included.

What is left is verified on the whole sets. Runs are compared by 64-bit hashes. All that is broadcast comes from the templates, of
which there are at most MAX_TEMPLATES with MAX_RUNS runs.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm._store import written
from paperloom.llm.decontam import let

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = 3
MAX_TEMPLATES, MAX_RUNS = 1_000, 20_000
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_GNU = """you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0}General Public License for more details."""

#: Notices, headers and texts that licenses are given by, copyright lines left out; the method's labels are their keys.
TEMPLATES: dict[str, str] = {
    "agpl-header": _GNU.format("Affero ", "3"),
    "apache-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "apache-notice": "Licensed under the Apache License, Version 2.0",
    "bsd-conditions": _BSD,
    "bsl-text": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:""",
    "cc-by-nc-notice": "Licensed under CC BY-NC 4.0",
    "cc-by-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "gpl-header": _GNU.format("", "3"),
    "gpl-notice": "This work is licensed under the GNU General Public License, version 3",
    "gpl-preamble": "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
    "isc-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "lgpl-header": _GNU.format("Lesser ", "2.1"),
    "mit-notice": "Released under the MIT License",
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.""",
    "mpl-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "unlicense-text": """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    "zlib-text": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:""",
}
PHRASES: dict[str, str] = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


def spaced(text: Column) -> Column:
    """The words of a text, each with one space before it, and a space at the end; ASCII letters lower-cased; null: no word."""
    return F.concat(F.rtrim(F.concat(F.lit(" "), F.ltrim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NOT_WORD, " ")))), F.lit(" "))


def n_spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" ")))


def places(s: Column, phrase: str) -> tuple[Column, Column, Column]:
    """Of a phrase in spaced words: number of places, overlapping ones each, and the word index of the first and the last; null if none."""
    needle = f" {phrase} "
    has = s.contains(needle)
    n = F.when(has, F.regexp_count(s, F.lit(f"(?={needle})"))).otherwise(0)
    first = F.when(has, n_spaces(F.substring_index(F.concat(F.lit("\x01"), s), needle, 1)))
    # the last place: in the reversed text the first one
    last = F.when(has, n_spaces(s) - 1 - n_spaces(F.substring_index(F.concat(F.lit("\x01"), F.reverse(s)), needle[::-1], 1)) - phrase.count(" ") - 1)
    return n.cast("long"), first.cast("long"), last.cast("long")


def phrase_labels(docs: DataFrame, phrases: Mapping[str, str], text: str) -> DataFrame:
    """Adds n_words, n_base, first_word, last_word and base (array of labels) to the columns of `docs`."""
    docs = docs.withColumn("__s", spaced(F.col(text)))
    found = [(label, *places(F.col("__s"), p)) for p, label in phrases.items()]
    out = docs.withColumns({f"__n{i}": x[1] for i, x in enumerate(found)} | {f"__f{i}": x[2] for i, x in enumerate(found)} | {f"__l{i}": x[3] for i, x in enumerate(found)})
    ids = range(len(found))
    least = (lambda c: F.least(*c)) if len(found) > 1 else (lambda c: c[0])
    most = (lambda c: F.greatest(*c)) if len(found) > 1 else (lambda c: c[0])
    base = F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(F.col(f"__n{i}") > 0, F.lit(found[i][0])) for i in ids]))))
    return out.select(
        *docs.drop("__s").columns,
        F.greatest(F.lit(0), n_spaces(F.col("__s")) - 1).cast("long").alias("n_words"),
        sum((F.col(f"__n{i}") for i in ids), F.lit(0)).cast("long").alias("n_base"),
        least([F.col(f"__f{i}") for i in ids]).alias("first_word"),
        most([F.col(f"__l{i}") for i in ids]).alias("last_word"),
        base.alias("base"),
    )


def words_of(text: str) -> list[str]:
    """Words, by the same rule as those of texts."""
    return [w for w in re.split(NOT_WORD, text.translate(str.maketrans(UPPER, LOWER))) if w]


def parsed_templates(templates: Mapping[str, str], containment: float) -> list[tuple[str, list[str], int, int]]:
    """(label, runs, number of runs that a block must hold, L)."""
    if len(templates) > MAX_TEMPLATES:
        raise ValueError(f"more than {MAX_TEMPLATES} templates")
    out = []
    for label, t in sorted(templates.items()):
        words = words_of(t)
        if len(words) < RUN:
            raise ValueError(f"the template {label} has fewer than {RUN} words")
        runs = sorted({" ".join(words[i : i + RUN]) for i in range(len(words) - RUN + 1)})
        out.append((label, runs, max(1, math.ceil(containment * len(runs) - 1e-9)), 1 << (len(words) - 1).bit_length()))
    if sum(len(r) for _, r, _, _ in out) > MAX_RUNS:
        raise ValueError(f"more than {MAX_RUNS} runs of templates")
    return out


def run_hashes(text: Column) -> Column:
    """Hashes of all runs of RUN words, in order; empty for a shorter text."""
    codes = F.transform(F.split(F.trim(spaced(text)), " "), lambda w: F.xxhash64(w))
    runs = lambda c: F.transform(F.sequence(F.lit(0), F.greatest(F.size(c) - RUN, F.lit(0))), lambda i: F.xxhash64(*[F.get(c, i + k) for k in range(RUN)]))
    return let(codes, lambda c: F.when(F.size(c) >= RUN, runs(c)).otherwise(F.array().cast("array<bigint>")))


def ranked_templates(hits: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """label, size, n, need, x: each template's runs as sorted ranks; a rank is the place in the order of number of places in all
    texts, then hash. From the templates' own, bounded rows."""
    counts = hits.groupBy("h").agg(F.count("*").alias("places"))
    order = vocabulary.select("h").distinct().join(counts, "h", "left").select("h", F.row_number().over(Window.orderBy(F.coalesce("places", F.lit(0)), "h")).alias("rank"))
    return vocabulary.join(order, "h").groupBy("label", "size", "need").agg(F.array_sort(F.collect_list("rank")).alias("x"), F.map_from_entries(F.collect_list(F.struct("rank", "h"))).alias("runs")).withColumn("n", F.size("x"))


def candidates(blocks: DataFrame, index: DataFrame, positional: bool = True) -> DataFrame:
    """From blocks (..., size, y: sorted ranks) and prefixes (size, rank, i, label, n, need, x): the pairs that pass the filters by
    length and position, once each, with `common`, the runs that they share."""
    x = blocks.withColumn("m", F.size("y")).select("*", F.posexplode("y").alias("j", "rank")).join(F.broadcast(index), ["size", "rank"])
    x = x.where(F.col("m") >= F.col("need"))
    if positional:
        x = x.where(F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j")) >= F.col("need"))
    # of the runs that a block shares with a template only the first makes the pair; only what is left is intersected, once
    return x.withColumn("common", F.array_intersect("y", "x")).where(F.get("common", 0) == F.col("rank"))


def block_sets(docs: DataFrame, templates: Mapping[str, str], containment: float, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Blocks (key, t, size, block, y) that hold a template's run, and the templates' prefix index."""
    spark = docs.sparkSession
    parsed = [(label, templates[label], need, size) for label, _, need, size in parsed_templates(templates, containment)]
    vocabulary = spark.createDataFrame(parsed, "label string, text string, need int, size int")
    vocabulary = written(vocabulary.select("label", "need", "size", F.explode(F.array_distinct(run_hashes(F.col("text")))).alias("h")), "license-runs")
    x = docs.select(F.col(key).alias("__key"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("__t"), F.posexplode(run_hashes(F.col(text))).alias("at", "h"))
    hits = written(x.join(F.broadcast(vocabulary.select("h").distinct()), "h", "left_semi"), "license-hits")
    ranked = written(ranked_templates(hits, vocabulary), "license-templates")
    tokens = ranked.select("size", F.explode("runs").alias("rank", "h")).distinct()
    x = hits.join(F.broadcast(tokens), "h").withColumn("place", F.floor(F.col("at") / F.col("size")).cast("int"))
    x = x.select("__key", "__t", "size", "rank", F.explode(F.array(F.col("place") - 1, F.col("place"))).alias("block")).where("block >= 0")
    blocks = x.groupBy("__key", "__t", "size", "block").agg(F.array_sort(F.collect_set("rank")).alias("y"))
    prefix = F.posexplode(F.slice(F.col("x"), 1, F.col("n") - F.col("need") + 1)).alias("i", "rank")
    return blocks, ranked.select("size", "label", "n", "need", "x", prefix)


def meeting_blocks(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, containment: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per (text, block, template) that meet: key, text_hash, label, start and stop (word places of the block), n_shared, n_runs, score.

    text_hash (of the text, a null one as empty) tells apart texts of one key. Kindred templates may meet one block together; score
    (the containment) tells them apart. Null and empty texts and those of fewer than RUN words have no blocks; rows that repeat key
    and text give one result; a null key is a key like others; an empty table or no template gives none; other columns are not read.
    """
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, text_hash long, label string, start long, stop long, n_shared long, n_runs long, score double"
    if not templates:
        return docs.sparkSession.createDataFrame([], schema)
    blocks, index = block_sets(docs, templates, containment, key, text)
    met = candidates(blocks, index).withColumn("shared", F.size("common")).where(F.col("shared") >= F.col("need"))
    start = F.col("block").cast("long") * F.col("size")
    return met.select(
        F.col("__key").alias(key), F.col("__t").alias("text_hash"), "label", start.alias("start"), (start + 2 * F.col("size") + RUN - 1).alias("stop"),
        F.col("shared").cast("long").alias("n_shared"), F.col("n").cast("long").alias("n_runs"), (F.col("shared") / F.col("n")).alias("score"),
    )


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, phrases: Mapping[str, str] = PHRASES, containment: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Labels are those of phrases (places where a phrase's words stand consecutively) and of templates that a block meets; score
    is the largest containment of a met template, 1 if a phrase stands in the text, else 0. A null or empty text has no words
    and no labels; each row has the labels of its own text, also where keys repeat or are null; other columns are not read; an
    empty table gives an empty result.
    """
    slim = docs.select(F.col(key).alias("__key"), F.col(text).cast("string").alias("__text"))
    base = phrase_labels(slim.withColumn("__hash", F.xxhash64(F.coalesce("__text", F.lit("")))), phrases, "__text").drop("__text")
    met = meeting_blocks(slim, templates, containment, "__key", "__text")
    met = met.groupBy(F.col("__key").alias("__k"), "text_hash").agg(F.collect_set("label").alias("more"), F.max("score").alias("best"))
    out = base.join(met, F.col("__key").eqNullSafe(F.col("__k")) & (F.col("__hash") == F.col("text_hash")), "left")
    both = F.array_sort(F.array_union(F.col("base"), F.coalesce("more", F.array().cast("array<string>"))))
    return out.select(
        F.col("__key").alias(key), "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(both, ",").alias("labels"),
        F.greatest(F.coalesce("best", F.lit(0.0)), F.when(F.col("n_base") > 0, 1.0).otherwise(0.0)).alias("score"),
    )
