"""License scans: an exact set-similarity join of text blocks with license templates. Native."""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.scratch import materialise

# Phrases that name a license, and paragraphs of public licenses and of the notices that they ask for.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
TEMPLATES = {
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions:",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License.",
        "distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    ],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; "
        "either version 2.1 of the License, or (at your option) any later version.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY "
        "AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
        "for any purpose, commercial or non-commercial, and by any means.",
    ],
    "zlib": [
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    ],
    "boost": ["Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)"],
    "cc": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
}
#: Share of a template's distinct words that a block must hold.
CONTAINMENT = 0.8
#: Least number of words from one block to the next.
LEAST_STEP = 8
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: str) -> list[str]:
    """The words of a fixed text, as the Spark expressions below take them."""
    return [w for w in re.split(NOT_WORD, text.translate(str.maketrans(_UPPER, _LOWER))) if w]


def step_of(words: Sequence[str]) -> int:
    """Words from one block to the next for a template: its number of words, rounded up to a power of 2.

    Blocks are twice as long, so that a quotation with up to that many words lies in one whatever its lines are.
    """
    return max(LEAST_STEP, 1 << (len(words) - 1).bit_length())


def _phrase_starts(words: Column, padded: Column, phrase: Sequence[str]) -> Column:
    """Where the words of ``phrase`` stand consecutively; only texts that hold them at all are looked through."""
    places = F.sequence(F.lit(0), F.size(words) - F.lit(len(phrase)))

    def here(i: Column) -> Column:
        same = F.get(words, i) == phrase[0]
        for k, w in enumerate(phrase[1:], 1):
            same = same & (F.get(words, i + k) == w)
        return same

    return F.when(F.contains(padded, F.lit(" " + " ".join(phrase) + " ")), F.filter(places, here)).otherwise(F.array().cast("array<int>"))


def scan_licenses(
    docs: DataFrame, phrases: Mapping[str, str] = PHRASES, templates: Mapping[str, Sequence[str]] = TEMPLATES, containment: float = CONTAINMENT, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Licenses named or quoted in every whole text of ``docs``.

    Phrases are found wherever their words stand consecutively. Templates are joined with text blocks by the share of
    the template's distinct words that a block holds. Blocks are windows of words, twice :func:`step_of` the template
    long, one beginning at each multiple of that. Words are ordered from rare to frequent over all documents; a block
    that reaches the threshold holds at least one of a template's rarest words, its prefix, so blocks meet templates on
    prefix words only; pairs whose block is too short, or whose words left after the shared one are too few, are
    dropped; the rest is counted exactly. The same filters first go over whole documents, so that only documents that
    could hold a template are cut into blocks.

    Returns for each row: doc_id, n_words, n_base (places of phrases), first_word and last_word (least and greatest
    start, else null), base_labels and labels (distinct, sorted, joined by commas), score (1 with a phrase, else the
    highest containment at or over the threshold, else 0; ties change nothing). Null and empty texts have no words.
    Very long texts only have more blocks. Null and repeated ids are rows like any other; other columns are ignored. An
    empty table gives no rows.
    """
    named = {tuple(words_of(p)): label for p, label in phrases.items()}
    sets = [(label, step_of(w), sorted(set(w))) for label, texts in templates.items() for w in map(words_of, texts)]
    needed = [max(1, math.ceil(containment * len(t) - 1e-9)) for *_, t in sets]
    terms = sorted({w for *_, t in sets for w in t})
    least = min(needed)

    low = F.translate(F.coalesce(F.col(text_col), F.lit("")), _UPPER, _LOWER)
    base = docs.select(F.col(id_col).alias("doc_id"), F.trim(F.regexp_replace(low, NOT_WORD, " ")).alias("plain"))
    base = base.select("doc_id", F.concat(F.lit(" "), "plain", F.lit(" ")).alias("padded"), F.when(F.col("plain") == "", F.array().cast("array<string>")).otherwise(F.split("plain", " ")).alias("words"))
    starts = {label: _phrase_starts(F.col("words"), F.col("padded"), p) for p, label in named.items()}
    every = F.flatten(F.array(*starts.values()))
    held = F.array_compact(F.array(*[F.when(F.size(s) > 0, F.lit(label)) for label, s in starts.items()]))
    found = base.select(
        "doc_id", "words", every.alias("starts"), F.array_sort(F.array_distinct(held)).alias("base"), F.array_intersect("words", F.array(*map(F.lit, terms))).alias("terms"),
    )
    # Words are kept of documents with enough different words of templates to hold one at all.
    table = materialise(
        found.select(
            F.monotonically_increasing_id().alias("row"), "doc_id", F.size("words").cast("long").alias("n_words"), F.size("starts").cast("long").alias("n_base"),
            F.array_min("starts").cast("long").alias("first_word"), F.array_max("starts").cast("long").alias("last_word"), "base", "terms",
            F.when(F.size("terms") >= least, F.col("words")).alias("words"),
        ),
        "license-words",
    )

    # The order of the words: as many rows at most as the fixed templates have distinct words.
    counted = {r.term: r.n for r in table.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect()}
    order = sorted(terms, key=lambda w: (counted.get(w, 0), w))
    place = {w: i for i, w in enumerate(order)}
    prefixes, whole = [], []
    for number, ((label, step, words), need) in enumerate(zip(sets, needed, strict=True)):
        ordered = sorted(words, key=place.__getitem__)
        prefix = ordered[: len(ordered) - need + 1]
        prefixes += [(w, step, number, label, i, len(ordered), need, ordered) for i, w in enumerate(prefix)]
        whole.append(F.struct(F.lit(step).alias("step"), F.lit(need).alias("need"), F.array(*map(F.lit, prefix)).alias("prefix"), F.array(*map(F.lit, ordered)).alias("words")))
    schema = T.StructType.fromDDL("word string, step int, template int, label string, at int, length int, need int, template_words array<string>")
    index = docs.sparkSession.createDataFrame(prefixes, schema)

    able = lambda t: (F.size("terms") >= t["need"]) & F.arrays_overlap("terms", t["prefix"]) & (F.size(F.array_intersect("terms", t["words"])) >= t["need"])
    steps = F.array_distinct(F.transform(F.filter(F.array(*whole), able), lambda t: t["step"]))
    cut = table.filter(F.col("words").isNotNull()).select("row", "words", F.explode(steps).alias("step"))
    begins = F.sequence(F.lit(0), F.floor((F.size("words") - 1) / F.col("step")).cast("int"))
    windows = F.transform(begins, lambda i: F.array_intersect(F.array(*map(F.lit, order)), F.slice("words", i * F.col("step") + 1, 2 * F.col("step"))))
    block = cut.select("row", "step", F.explode(windows).alias("block")).filter(F.size("block") >= least)
    meets = block.select("row", "step", "block", F.posexplode("block").alias("block_at", "word")).join(F.broadcast(index), ["word", "step"])
    left = F.least(F.col("length") - F.col("at"), F.size("block") - F.col("block_at"))
    candidates = meets.filter((F.size("block") >= F.col("need")) & (left >= F.col("need")))
    matched = candidates.withColumn("shared", F.size(F.array_intersect("block", "template_words"))).filter("shared >= need")
    quoted = matched.groupBy("row").agg(F.collect_set("label").alias("quoted"), F.max(F.col("shared") / F.col("length")).alias("share"))

    labels = F.array_sort(F.array_union("base", F.coalesce("quoted", F.array().cast("array<string>"))))
    return table.join(quoted, "row", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )
