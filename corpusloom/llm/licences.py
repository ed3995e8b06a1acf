"""Licence notices in paragraphs: a trained n-gram classifier, calibrated against unknown text, confirmed by templates.

Everything runs on DataFrame operations. The n-grams that the model knows are those of
the templates. A document's pairs of words are first met with the templates' within its
row, so that only the paragraphs of documents that hold some are cut out, scored by one
broadcast join with the model's n-grams and compared with the templates.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.shared import materialize

# Notices by which the public licences are usually named or quoted.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "See the License for the specific language governing permissions and limitations under the License.",
    ],
    "mit": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Licensed under the BSD 3-Clause License.",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at",
    ],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0.", "Content is available under CC BY 4.0."],
    "cc-by-sa": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0."],
    "cc-by-nc": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0."],
}
UNKNOWN = "unknown"
# Phrases that templates share with ordinary text, taught as unknown.
ORDINARY = ["the terms of the", "under the terms", "version 2 of the", "this work is", "copy of the", "general public", "in the public", "all rights reserved"]
#: A paragraph is judged in windows of so many words, each half over the next; no template is longer than half a window.
WINDOW = 160
#: With fewer of the templates' word pairs a document holds no notice, and no window of it is judged.
LEAST_PAIRS = 2


def _words(column: str):
    return F.filter(F.split(F.lower(column), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _pairs(words: str):
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.xxhash64(a, b))


def with_grams(rows: DataFrame) -> DataFrame:
    """Adds ``grams``: the distinct hashes of the pairs and triples of ``words``."""
    n = F.greatest(F.size("words") - 2, F.lit(0))
    triples = F.zip_with(F.slice("pairs", F.lit(1), n), F.slice("words", F.lit(3), n), lambda a, b: F.xxhash64(a, b))
    return rows.withColumn("pairs", _pairs("words")).withColumn("grams", F.array_distinct(F.concat("pairs", triples))).drop("pairs")


def windows(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` -> doc_id, paragraph (0-based), words: the windows of each paragraph that holds a word.

    Paragraphs end at empty lines; wrapped lines, and marks of comments before them, do not matter.
    """
    parts = docs.select("doc_id", F.posexplode(F.split("text", r"(?:\r\n|\r|\n)[ \t]*(?:\r\n|\r|\n)\s*")).alias("paragraph", "body")).withColumn("all", _words("body"))
    parts = parts.where(F.size("all") > 0).withColumn("at", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.size("all") - WINDOW) / (WINDOW // 2)).cast("int")))))
    return parts.select("doc_id", "paragraph", F.slice("all", F.col("at") * (WINDOW // 2) + 1, WINDOW).alias("words"))


def _hold_pairs(docs: DataFrame, pairs: list[int]) -> DataFrame:
    """The documents that hold at least ``LEAST_PAIRS`` of the templates' word pairs; a pair over the end of a paragraph counts too."""
    rows = docs.select("doc_id", "text").withColumn("words", _words("text"))
    held = F.array_intersect(_pairs("words"), F.array(*map(F.lit, pairs)))
    return rows.where(F.size(held) >= LEAST_PAIRS).select("doc_id", "text")


@dataclass
class Model:
    """Per family an intercept, and weights by n-gram hash; a calibration of the lead over unknown; template n-grams and word pairs."""

    families: list[str]
    intercepts: list[float]
    weights: list[tuple[int, list[float]]]
    slope: float
    offset: float
    templates: list[tuple[int, str, list[int]]]
    pairs: list[int]


def _noisy(rows: DataFrame) -> DataFrame:
    """Each template whole, inside other words, and as its longer parts."""
    n = F.size("words")
    half = F.greatest(F.ceil(n * 0.7).cast("int"), F.lit(4))
    around = lambda before, after: F.concat(F.split(F.lit(before), " "), "words", F.split(F.lit(after), " "))
    extra = F.array(F.col("words"), around("zza", "zzb"), around("copyright zzf", "zzc zzd zze"), F.slice("words", F.lit(1), half), F.slice("words", F.greatest(n - half + 1, F.lit(1)), half))
    return rows.select("family", "held", F.explode(F.array_distinct(extra)).alias("words"))


def _fragments(rows: DataFrame) -> DataFrame:
    """Three words at a time of the templates of twelve words or more: too little to be a notice, so unknown."""
    at = F.explode(F.sequence(F.lit(1), F.size("words") - 2, F.lit(2)))
    own = F.concat(F.split(F.lit("zzh zzi"), " "), F.slice("words", F.col("at"), 3), F.split(F.lit("zzj zzk"), " "))
    return rows.where(F.size("words") >= 12).withColumn("at", at).select(F.lit(UNKNOWN).alias("family"), "held", own.alias("words"), F.lit(0.5).alias("weight"))


def _fit(rows: DataFrame) -> object:
    return LogisticRegression(family="multinomial", regParam=1e-4, maxIter=40, standardization=False, weightCol="weight").fit(rows)


def train(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, unlabelled_rows: int = 4_000) -> Model:
    """Fits the classifier on the templates' variants and on ordinary paragraphs.

    ``unlabelled_rows`` bounds the paragraphs of documents that stand for unknown text:
    one window of each of the documents with the smallest hashes, other than those that
    repeat a template's words, and ``ORDINARY``; so do short fragments of templates. The lead of the best family over
    unknown is calibrated on what a first fit has not seen, all variants of the last
    template of each family and a quarter of the ordinary paragraphs; the model is a
    second fit on all rows.
    """
    spark = docs.sparkSession
    known = spark.createDataFrame([(f, 0 < n == len(ts) - 1, t) for f, ts in templates.items() for n, t in enumerate(ts)], "family string, held boolean, body string")
    parts = with_grams(known.withColumn("words", _words("body"))).withColumn("own_pairs", _pairs("words")).collect()  # as many rows as templates
    vocabulary = sorted({g for r in parts for g in r["grams"]})
    place = {g: i for i, g in enumerate(vocabulary)}
    chosen = docs.select("doc_id").where("doc_id IS NOT NULL").distinct().orderBy(F.xxhash64(F.lit("licence"), "doc_id"), "doc_id").limit(unlabelled_rows)
    plain = windows(docs.join(F.broadcast(chosen), "doc_id")).groupBy("doc_id").agg(F.min_by("words", F.xxhash64("words", "paragraph")).alias("words"))
    common = spark.createDataFrame([(b,) for b in ORDINARY], "body string").select(_words("body").alias("words"))
    ordinary = plain.select("words").union(common).select(F.lit(UNKNOWN).alias("family"), (F.pmod(F.xxhash64("words"), F.lit(4)) == 0).alias("held"), "words")
    families = [UNKNOWN, *templates]
    whole = known.withColumn("words", _words("body"))
    taught = _noisy(whole).withColumn("weight", F.lit(1.0)).unionByName(ordinary.withColumn("weight", F.lit(0.05)))
    rows = with_grams(taught).withColumn("n", F.size("grams"))
    rows = rows.withColumn("grams", F.array_intersect("grams", F.array(*map(F.lit, vocabulary))))
    rows = rows.where((F.col("family") != UNKNOWN) | (F.size("grams") <= 0.5 * F.col("n"))).drop("n").unionByName(with_grams(_fragments(whole)))
    number = F.array_position(F.array(*map(F.lit, families)), F.col("family")) - 1
    rows = rows.select(number.cast("double").alias("label"), F.col("grams").cast("array<string>").alias("grams"), "held", "weight")
    sparse = CountVectorizerModel.from_vocabulary([str(g) for g in vocabulary], "grams", "features").setBinary(True).setMinTF(0.0)
    rows = sparse.transform(materialize(rows, "licence-rows")).select("label", "features", "held", "weight")
    raw = _fit(rows.where("NOT held")).transform(rows.where("held")).select("label", vector_to_array("rawPrediction").alias("raw"))
    lead = raw.select((F.col("label") > 0).cast("double").alias("label"), (F.array_max(F.slice("raw", 2, len(families))) - F.col("raw")[0]).alias("lead"))
    sure = LogisticRegression(regParam=1e-2, maxIter=50).fit(lead.select("label", array_to_vector(F.array("lead")).alias("features"))) if lead.select("label").distinct().count() == 2 else None
    slope, offset = (float(sure.coefficients[0]), float(sure.intercept)) if sure else (1.0, 0.0)
    fitted = _fit(rows)
    matrix, intercepts = fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray()
    weights = [(g, [float(matrix[k, place[g]]) for k in range(len(families))]) for g in vocabulary]
    pairs = sorted({g for r in parts for g in r["own_pairs"]})
    return Model(families, [float(x) for x in intercepts], weights, slope, offset, [(i, r["family"], list(r["grams"])) for i, r in enumerate(parts)], pairs)


def scan(docs: DataFrame, model: Model, sure: float = 0.5, alike: float = 0.6) -> DataFrame:
    """``docs(doc_id, text)`` -> doc_id, paragraph, family, probability, similarity, confirmed.

    One row for each paragraph and family that the classifier takes a window of it for,
    with a calibrated probability of at least ``sure`` that it is not unknown text.
    ``similarity`` is the largest share of a template of the family that the window
    holds, by n-grams; it confirms the prediction from ``alike`` on. Of several windows
    the surest and the most similar count. A document with fewer than ``LEAST_PAIRS`` of
    the templates' word pairs holds no notice.

    Null and empty texts have no paragraphs. Repeated rows of one document and text give
    one result; a null doc_id counts as an id. Texts of any length are read whole. Other
    columns are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    k = len(model.families)
    table = spark.createDataFrame(model.weights, "gram bigint, w array<double>")
    cut = with_grams(windows(_hold_pairs(docs, model.pairs))).select("doc_id", "paragraph", F.xxhash64("words").alias("mark"), F.explode("grams").alias("gram"))
    hits = cut.join(F.broadcast(table), "gram")
    sums = [F.sum(F.col("w")[i]).alias(f"s{i}") for i in range(k)]
    scored = hits.groupBy("doc_id", "paragraph", "mark").agg(F.count("*").alias("n"), F.collect_set("gram").alias("grams"), *sums)
    copies = F.col("n") / F.size("grams")
    logits = [F.col(f"s{i}") / copies + model.intercepts[i] for i in range(k)]
    best = F.array_max(F.array(*(F.struct(logits[i].alias("logit"), F.lit(model.families[i]).alias("family")) for i in range(1, k))))
    scored = scored.select("doc_id", "paragraph", "mark", "grams", best.alias("best"), logits[0].alias("none"))
    probability = 1 / (1 + F.exp(-(F.lit(model.slope) * (F.col("best.logit") - F.col("none")) + F.lit(model.offset))))
    found = scored.withColumn("probability", probability).where(F.col("probability") >= sure)
    shares = {f: F.array_max(F.array(*(F.size(F.array_intersect("grams", F.array(*map(F.lit, own)))) / len(own) for _, g, own in model.templates if g == f))) for f in model.families[1:]}
    similarity = reduce(lambda other, f: F.when(F.col("best.family") == f, shares[f]).otherwise(other), model.families[1:], F.lit(0.0))
    found = found.withColumn("similarity", similarity).groupBy("doc_id", "paragraph", F.col("best.family").alias("family"))
    found = found.agg(F.round(F.max("probability"), 6).alias("probability"), F.round(F.max("similarity"), 6).alias("similarity"))
    return found.withColumn("confirmed", F.col("similarity") >= alike)


def op3_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan(docs, train(docs))
