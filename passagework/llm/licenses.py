"""Licence scan: a trained paragraph classifier in DataFrame operations only.

A sparse logistic regression over word n-grams (1 to 3) tells licence families, licence-like text
of no known family, and ordinary text apart. Its features are n-grams of the phrases below that
hold a word which is rare in ordinary lines, counted over the whole corpus. It is trained on the
phrases, cut and framed in several ways, against a bounded sample of the corpus's own lines. Its
probabilities are tempered on whole phrases held out of a first fit, a family below the calibrated
confidence is called ``unknown``, and a family counts as confirmed only if one of its phrases
overlaps the paragraph enough.

Paragraphs are lines; a notice wrapped over several lines is judged line by line. Every n-gram that
speaks for a licence more than for ordinary text has a cue, its rarest word. A line without any cue
has only n-grams that speak for ordinary text and is none of the families, so only lines with a cue
are scored, in full, and only n-grams with a weight leave their line.

Defined cases: a null or empty text has no paragraphs and gives no row; a null doc_id gives rows
with a null doc_id and is not sampled; repeated rows each give their rows; ties between families go
to the first in code point order; a very long text is one more set of lines, a very long line is
scored whole; without ordinary lines the phrases alone train the model; an empty table gives an
empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, StringIndexer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import once, written

#: Ids of documents whose paragraphs are sampled as ordinary text, at most.
BACKGROUND_DOCUMENTS = 400
BACKGROUND_PARAGRAPHS = 4000
#: Share of ordinary lines, over the whole corpus, beyond which a word is common: an n-gram of common
#: words alone is no feature. Words above CERTAIN in the sample are common without being counted.
COMMON, CERTAIN = 0.0005, 0.01
CONFIRM = 0.5
#: Share of a phrase's n-grams from which on a sampled paragraph is no ordinary text.
OVERLAP = 0.3
NONE, UNKNOWN = "none", "unknown"

# Words of which every licence phrase has one; a line with one is no ordinary line.
MARKERS = (
    "apache", "bsd", "cc", "cc0", "cc0-1.0", "confidential", "copyright", "copyrights", "creative", "gnu", "isc", "licence", "licences", "license",
    "licensed", "licenses", "mit", "mozilla", "mpl", "permission", "redistribution", "redistributions", "reserved", "spdx", "sublicense", "unencumbered", "waived", "waiving",
)

# Phrases of public licences, and licence-like phrases of none.
PHRASES = {
    "AGPL": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License",
        "Licensed under the GNU Affero General Public License version 3",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "You should have received a copy of the GNU Affero General Public License along with this program",
    ],
    "Apache": [
        "Licensed under the Apache License, Version 2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License',
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Released under the Apache License 2.0",
        "SPDX-License-Identifier: Apache-2.0",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS',
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
        "Use of this source code is governed by a BSD-style license",
        "Released under the BSD 3-Clause License",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED',
    ],
    "CC-BY": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
        "Licensed under CC BY 4.0",
        "Available under the Creative Commons Attribution License",
        "To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
        "Licensed under CC BY-NC-SA 4.0 for noncommercial use",
        "To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0",
        "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License",
        "Text is available under the Creative Commons Attribution-ShareAlike License",
        "To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/",
    ],
    "CC0": [
        "To the extent possible under law, the author has waived all copyright and related rights to this work",
        "Dedicated to the public domain under CC0 1.0 Universal",
        "This is free and unencumbered software released into the public domain",
        "SPDX-License-Identifier: CC0-1.0",
        "The person who associated a work with this deed has dedicated the work to the public domain by waiving all rights to the work worldwide under copyright law",
    ],
    "GPL": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "This work is licensed under the GNU General Public License, version 3",
        "You should have received a copy of the GNU General Public License along with this program",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; see the GNU General Public License for more details",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "Released under the ISC License",
        "SPDX-License-Identifier: ISC",
        "Licensed under the ISC License",
        "provided that the above copyright notice and this permission notice appear in all copies",
    ],
    "LGPL": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "Licensed under the GNU Lesser General Public License version 2.1",
        "SPDX-License-Identifier: LGPL-2.1-only",
        "You should have received a copy of the GNU Lesser General Public License along with this library",
    ],
    "MIT": [
        "Released under the MIT License",
        "Licensed under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
        "SPDX-License-Identifier: MIT",
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies",
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY",
    ],
    "MPL": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
        "SPDX-License-Identifier: MPL-2.0",
        'This Source Code Form is "Incompatible With Secondary Licenses", as defined by the Mozilla Public License, v. 2.0',
    ],
    UNKNOWN: [
        "Licensed under the terms of the agreement between the parties",
        "Use of this material is subject to the license terms of the publisher",
        "All rights reserved. No part of this publication may be reproduced without permission",
        "Proprietary and confidential. Unauthorized copying is prohibited",
        "Licensed for internal use only under a commercial license",
        "You may use this content under the custom licence found on the website",
    ],
    NONE: [
        "The driver must hold a license and show it on request",
        "She asked for permission to copy the letter",
        "The software was released last year and the library is free on Sundays",
        "The general public was not permitted to use the hall",
        "The terms of the loan were modified by the bank",
        "Conditions on the road are poor and copies of the map are few",
    ],
}


def words_of(line: Column) -> Column:
    """Runs of letters and digits, with inner dots, lower-cased."""
    return F.filter(F.split(F.lower(line), r"[^\p{L}\p{N}.]+|\.(?=\s|$)"), lambda w: w != "")


def grams_of(words: Column) -> Column:
    def run(k: int) -> Column:
        at = F.sequence(F.lit(1), F.size(words) - (k - 1))
        return F.when(F.size(words) >= k, F.transform(at, lambda i: F.array_join(F.slice(words, i, k), " "))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(words, run(2), run(3)))


def _lines(docs: DataFrame) -> DataFrame:
    # Outer, else the optimizer splits each text a first time to see whether it has lines.
    return docs.where(F.length("text") > 0).select("doc_id", F.posexplode_outer(F.split("text", "\n")).alias("paragraph", "line"))


def phrase_table(spark: SparkSession) -> DataFrame:
    """(family, phrase, words, fold): fold 3 of 0 to 3 is held out of the first fit, phrase by phrase."""
    rows = [(f, t, i % 4) for f, own in PHRASES.items() for i, t in enumerate(sorted(own, key=len))]
    return spark.createDataFrame(rows, "family string, phrase string, fold int").select("family", "phrase", words_of(F.col("phrase")).alias("words"), "fold")


def background(docs: DataFrame, phrases: DataFrame) -> DataFrame:
    """(words): distinct ordinary lines of the sampled documents, at most BACKGROUND_PARAGRAPHS.

    A line with a marker, or with much of a phrase, teaches nothing about ordinary text, however
    often the corpus holds it.
    """
    # Ids are chosen first, so that no task gathers the texts of every task's candidates.
    ids = docs.where("doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(BACKGROUND_DOCUMENTS)
    lines = _lines(docs.join(F.broadcast(ids), "doc_id", "left_semi")).select(words_of(F.col("line")).alias("words"))
    plain = lines.where((F.size("words") > 0) & ~F.exists("words", lambda w: w.isin(*MARKERS))).distinct()
    sample = plain.orderBy(F.xxhash64("words"), "words").limit(BACKGROUND_PARAGRAPHS).select(F.xxhash64("words").alias("line"), "words")
    known = phrases.where(F.col("family") != NONE).select("phrase", grams_of(F.col("words")).alias("grams"))
    known = known.select("phrase", F.size("grams").alias("n"), F.explode("grams").alias("gram"))
    met = sample.select("line", F.explode(grams_of(F.col("words"))).alias("gram")).join(F.broadcast(known), "gram").groupBy("line", "phrase", "n").agg(F.count("*").alias("k"))
    return sample.join(met.where(F.col("k") >= OVERLAP * F.col("n")).select("line").distinct(), "line", "left_anti").select("words")


def ordinary_counts(docs: DataFrame, asked: list[str]) -> tuple[int, dict[str, int]]:
    """Number of lines without a marker over all documents, and of those with each asked word."""
    if not asked:
        return 0, {}
    plain = lambda w: F.when(F.exists(w, lambda x: x.isin(*MARKERS)), F.array().cast("array<string>")).otherwise(
        F.concat(F.array(F.lit("")), F.array_distinct(F.filter(w, lambda x: x.isin(*asked))))
    )
    seen = _lines(docs).select(F.explode_outer(once(words_of(F.col("line")), plain)).alias("word"))
    found = {r["word"]: r["n"] for r in seen.where("word is not null").groupBy("word").agg(F.count("*").alias("n")).collect()}
    return found.pop("", 0), found


def variants(phrases: DataFrame, plain: DataFrame) -> DataFrame:
    """(family, words, fold): each phrase whole, and without up to a third of its words at either
    end, framed by ordinary words where it lost some, as a notice within a longer line."""
    w, cut = F.col("words"), F.col("cut").cast("int")
    cuts = phrases.withColumn("cut", F.explode(F.sequence(F.lit(0), F.floor(F.size("words") / 3)))).withColumn("side", F.explode(F.array(*map(F.lit, range(3)))))
    kept = F.slice(w, F.when(F.col("side") == 1, cut + 1).otherwise(F.lit(1)), F.greatest(F.size(w) - cut * F.when(F.col("side") == 2, 0).otherwise(1), F.lit(1)))
    pool = plain.where(F.size("words") > 7).orderBy(F.xxhash64("words"), "words").limit(64).agg(F.collect_list(F.slice("words", 1, 6)).alias("pool"))
    some = F.coalesce(F.try_element_at("pool", (F.pmod(F.xxhash64("family", "kept", "side"), F.greatest(F.size("pool"), F.lit(1))) + 1).cast("int")), F.array().cast("array<string>"))
    framed = F.when(F.col("side") == 2, F.when(F.col("cut") % 2 == 0, F.concat(some, "kept")).otherwise(F.concat("kept", some))).otherwise(F.col("kept"))
    made = cuts.select("family", "fold", "cut", "side", kept.alias("kept")).join(F.broadcast(pool)).select("family", framed.alias("words"), "fold")  # pool is one row
    return made.where(F.size("words") > 1).distinct()


class Classifier:
    """Weights by n-gram, with cues, temperature and least confidence."""

    def __init__(self, families: list[str], weights: dict[str, list[float]], intercepts: list[float], spark: SparkSession):
        self.families, self.intercepts, self.spark = families, intercepts, spark
        self.weights, self.cues, self.temperature, self.confidence = weights, [], 1.0, 0.5

    def logits(self, rows: DataFrame, key: list[str]) -> DataFrame:
        """``key`` and ``logits`` of the rows (``key``, ``words``) that hold an n-gram with a weight."""
        k = len(self.families)
        if not self.weights:
            return rows.limit(0).select(*key, F.array(*(F.lit(x) for x in self.intercepts)).alias("logits"))
        # Filtered within the line: as many rows leave it as it has n-grams with a weight.
        hits = rows.select(*key, F.explode_outer(F.filter(grams_of(F.col("words")), lambda g: g.isin(*self.weights))).alias("gram"))
        table = self.spark.createDataFrame(list(self.weights.items()), "gram string, w array<double>")  # at most the phrases' n-grams
        sums = hits.join(F.broadcast(table), "gram").groupBy(*key).agg(*(F.sum(F.col("w")[i]).alias(f"w{i}") for i in range(k)))
        return sums.select(*key, F.array(*(F.col(f"w{i}") + self.intercepts[i] for i in range(k))).alias("logits"))

    def rarest_words(self, counts: dict[str, int], common: set[str]) -> list[str]:
        """A cue of every n-gram that speaks for some licence more than for ordinary text."""
        none = self.families.index(NONE)
        speaking = [g for g, w in self.weights.items() if max(x - w[none] for i, x in enumerate(w) if i != none) > 0]
        return sorted({min(g.split(" "), key=lambda w: (w in common, counts.get(w, 0), -len(w), w)) for g in speaking})


def softmax(logits: Column, temperature: float | Column) -> Column:
    e = once(logits, lambda a: F.transform(a, lambda x: F.exp((x - F.array_max(a)) / temperature)))
    return once(e, lambda a: once(F.aggregate(a, F.lit(0.0), lambda t, y: t + y), lambda total: F.transform(a, lambda x: x / total)))


def _trained(rows: DataFrame, features: list[str]) -> Classifier:
    """A multinomial regression of (family, kept) rows, ``kept`` being their features."""
    index = StringIndexer(inputCol="family", outputCol="y", stringOrderType="alphabetAsc").fit(rows)
    vectors = CountVectorizerModel.from_vocabulary(features, inputCol="kept", outputCol="x").setBinary(True)
    model = LogisticRegression(featuresCol="x", labelCol="y", family="multinomial", regParam=1e-4, elasticNetParam=0.5, maxIter=40, standardization=False).fit(index.transform(vectors.transform(rows)))
    by_gram = model.coefficientMatrix.toArray().T
    weights = {g: [float(x) for x in by_gram[j]] for j, g in enumerate(features) if abs(by_gram[j]).max() > 1e-9}
    return Classifier(index.labels, weights, [float(x) for x in model.interceptVector], rows.sparkSession)


def _calibrate(c: Classifier, held: DataFrame) -> tuple[float, float]:
    """Temperature and least confidence by phrases that ``c`` has not seen."""
    names = F.array(*map(F.lit, c.families))
    rows = c.logits(held, ["id", "family"]).withColumn("at", F.array_position(names, F.col("family")).cast("int")).where("at > 0")
    steps = held.sparkSession.createDataFrame([(float(t),) for t in (0.25, 0.5, 0.75, 1, 1.5, 2, 3, 4)], "t double")
    rows = rows.join(F.broadcast(steps)).select("t", "at", softmax(F.col("logits"), F.col("t")).alias("p"))  # steps are eight rows
    best = rows.groupBy("t").agg(F.avg(-F.log(F.greatest(F.element_at("p", F.col("at")), F.lit(1e-12)))).alias("loss")).orderBy("loss", "t").first()
    if best is None:
        return 1.0, 0.5
    # The least confidence at which licences said of held-out variants are right in 98 of 100 cases.
    said = F.element_at(names, F.array_position("p", F.array_max("p")).cast("int"))
    judged = rows.where((F.col("t") == best["t"]) & (said != NONE)).select(F.array_max("p").alias("top"), (F.element_at("p", F.col("at")) == F.array_max("p")).cast("int").alias("right"))
    found = judged.groupBy(F.least(F.floor(F.col("top") * 20), F.lit(19)).alias("step")).agg(F.count("*").alias("n"), F.sum("right").alias("ok")).collect()
    for s in range(6, 16):
        above = [(r["n"], r["ok"]) for r in found if r["step"] >= s]
        if above and sum(o for _, o in above) >= 0.98 * sum(m for m, _ in above):
            return best["t"], s / 20
    return best["t"], 0.75


def fit(docs: DataFrame) -> Classifier:
    spark = docs.sparkSession
    phrases = phrase_table(spark)
    plain = written(background(docs, phrases))
    grams = sorted(r["gram"] for r in phrases.select(F.explode(grams_of(F.col("words"))).alias("gram")).distinct().collect())  # the phrases are fixed values
    words = sorted({w for g in grams for w in g.split(" ")})
    n = max(1, plain.count())
    sampled = plain.select(F.explode(F.array_distinct(F.filter("words", lambda w: w.isin(*words)))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    common = {r["word"] for r in sampled.where(F.col("n") > F.lit(CERTAIN * n)).collect() if n >= 1 / CERTAIN}
    lines, counts = ordinary_counts(docs, [w for w in words if w not in common])
    common |= {w for w, k in counts.items() if k > max(1.0, COMMON * lines)}
    features = [g for g in grams if any(w not in common for w in g.split(" "))] or grams
    rows = variants(phrases, plain).unionByName(plain.select(F.lit(NONE).alias("family"), "words", F.pmod(F.xxhash64("words"), F.lit(4)).cast("int").alias("fold")))
    held = F.filter(grams_of(F.col("words")), lambda g: g.isin(*features))
    # Bounded by phrases and sample, so few partitions do; each step of a fit is a job over them.
    rows = written(rows.repartition(4, F.xxhash64("family", "words")).withColumns({"kept": held, "id": F.monotonically_increasing_id()}))
    first = _trained(rows.where(F.col("fold") != 3), features)
    temperature, confidence = _calibrate(first, rows.where((F.col("fold") == 3) & (F.size("kept") > 0)))
    c = _trained(rows, features)
    c.temperature, c.confidence, c.cues = temperature, confidence, c.rarest_words(counts, common)
    return c


def scan(docs: DataFrame, classifier: Classifier | None = None) -> DataFrame:
    """(doc_id, paragraph, family, probability, likeness, confirmed): every licence line.

    ``paragraph`` counts lines from 0; ``likeness`` is the best share of one of the
    family's phrases that the paragraph holds.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    c = classifier or fit(docs)
    held = _lines(docs).withColumn("words", words_of(F.col("line"))).where(F.exists("words", lambda w: w.isin(*c.cues)) if c.cues else F.lit(False))
    rows = written(held.select("doc_id", "paragraph", "words").withColumn("id", F.monotonically_increasing_id()))
    names = F.array(*map(F.lit, c.families))
    p = c.logits(rows, ["id"]).withColumn("p", softmax(F.col("logits"), c.temperature)).withColumn("best", F.element_at(names, F.array_position("p", F.array_max("p")).cast("int")))
    p = p.where(F.col("best") != NONE).select("id", "best", F.array_max("p").alias("probability"))
    phrases = phrase_table(docs.sparkSession).where(F.col("family") != NONE).select(F.col("family").alias("best"), F.array_distinct("words").alias("phrase"))
    alike = rows.join(p, "id").join(F.broadcast(phrases), "best").groupBy("id", "doc_id", "paragraph", "best", "probability").agg(
        F.max(F.size(F.array_intersect("phrase", "words")) / F.size("phrase")).alias("likeness")
    )
    sure = (F.col("probability") >= c.confidence) & (F.col("likeness") >= CONFIRM)
    return alike.select(
        "doc_id", F.col("paragraph").cast("long").alias("paragraph"), F.when(sure, F.col("best")).otherwise(UNKNOWN).alias("family"),
        "probability", "likeness", (sure & (F.col("best") != UNKNOWN)).alias("confirmed"),
    )
