"""Licence notices in documents: a trained classifier of all text, confirmed by templates.

Texts are split into paragraphs (at blank lines; wrapped lines belong together) and these into overlapping
windows of words.  Every window is classified by a multinomial logistic regression on sparse
word n-grams, whose ``none`` class does the rejecting; its probabilities are calibrated on held-out
rows, and what is too uncertain is ``unknown``.  The windows that remain are classified once more in narrower ones, so that
notices side by side are told apart.  A family is confirmed when the words around hold most word pairs of one of its
templates.  Everything runs as DataFrame operations and Spark's own ML stages.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# How licences are named and begin.
TEMPLATES = {
    "MIT": ("Released under the MIT License", "This project is licensed under the terms of the MIT license",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0", "This project is released under the Apache 2.0 license",
                   "you may not use this file except in compliance with the License"),
    "GPL": ("This work is licensed under the GNU General Public License, version 3",
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
            "Released under the GPL version 3"),
    "LGPL": ("Licensed under the GNU Lesser General Public License", "you can redistribute it under the terms of the GNU Lesser General Public License"),
    "AGPL": ("Licensed under the GNU Affero General Public License", "you can redistribute it under the terms of the GNU Affero General Public License"),
    "BSD": ("Licensed under the BSD 3-Clause License", "Released under the BSD license",
            "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Licensed under the Mozilla Public License"),
    "CC-BY-NC": ("Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-SA": ("Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY": ("Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    "CC0": ("Released under CC0 1.0 Universal public domain dedication", "To the extent possible under law, the author has waived all copyright"),
    "ISC": ("Released under the ISC License", "Permission to use, copy, modify, and/or distribute this software for any purpose"),
    "proprietary": ("Copyright, all rights reserved", "All rights reserved. No part of this publication may be reproduced without written permission"),
}
# Short names, which stand after ``LEADS``.
SHORT = {
    "MIT": ("MIT", "MIT-Lizenz"), "Apache-2.0": ("Apache-2.0", "Apache 2.0", "Apache-Lizenz"),
    "GPL": ("GPL", "GPLv2", "GPLv3", "GPL-2.0", "GPL-3.0", "GPL 3.0"), "LGPL": ("LGPL", "LGPLv3", "LGPL 2.1", "LGPL-2.1", "LGPL-3.0"),
    "AGPL": ("AGPL", "AGPLv3", "AGPL-3.0"), "BSD": ("BSD", "BSD-3-Clause", "BSD-2-Clause", "BSD-Lizenz"), "MPL-2.0": ("MPL", "MPL-2.0", "MPL 2.0"),
    "CC-BY-NC": ("CC BY-NC", "CC-BY-NC-4.0"), "CC-BY-SA": ("CC BY-SA", "CC-BY-SA-4.0"), "CC-BY": ("CC BY", "CC-BY-4.0"),
    "CC0": ("CC0", "CC0-1.0"), "ISC": ("ISC", "ISC-Lizenz"),
}
LEADS = ("under", "under the", "unter", "unter der", "SPDX", "SPDX-License-Identifier", "license")
NAMED = {family: tuple(f"{lead} {name}" for name in names for lead in LEADS) for family, names in SHORT.items()}
NONE = "none"
UNKNOWN = "unknown"
# Words that make a window licence language even if the regression rejects it, and keep a document out of the ``none`` sample.
CUE = (r"(?i)licen[cs]|lizenz|copyright|permission|redistribut|public domain|rights reserved|GPL(?:\b|v?[23])|\bCC0\b|\bCC[ -]BY\b|\bSPDX\b"
       r"|\bApache[ -]2|under (?:the )?(?:MIT|BSD|ISC)\b")
# Words of a window, between the starts of two windows, and around a window in which templates are looked for.
STEP, AROUND = 8, 16
WINDOW = 2 * STEP
NARROW, NARROW_STEP, NARROW_AROUND = 8, 4, 4
PARAGRAPH = r"\r?\n[ \t\r\f]*\n\s*"
# N-grams in so many training rows at least are features.
MIN_ROWS = 2
VARIANTS = 24
NAMED_VARIANTS = 6
# Documents without licence language that stand for other text in training, and how many are drawn to find them.
SAMPLE_ROWS = 400
DRAWN_ROWS = 8 * SAMPLE_ROWS
CONFIRMING_SHARE = 0.6
# Slots (a power of two) of the table of words' bounds; words that share one take the greater bound.
WORD_SLOTS = 1 << 15
# Without a cue word or a confirmed family, ``none`` must be less probable than this in licence language.
NONE_AT_MOST = 0.1
TEMPERATURES = [0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0]
THRESHOLDS = [0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]
PRECISION = 0.99


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+(?:[.-][\p{L}\p{N}]+)*"), F.lit(0))


def pairs(tokens: Column) -> Column:
    """Neighbouring words, joined by a space."""
    n = F.size(tokens)
    return F.when(n > 1, F.zip_with(F.slice(tokens, F.lit(1), n - 1), F.slice(tokens, F.lit(2), n - 1),
                                    lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))


def _grams(tokens: Column) -> Column:
    return F.concat(tokens, pairs(tokens))


@dataclass(frozen=True)
class LicenceModel:
    vectorizer: CountVectorizerModel
    regression: LogisticRegressionModel
    families: list[str]
    temperature: float
    threshold: float

    def scored(self, windows: DataFrame) -> DataFrame:
        """Adds ``raw``, the scores of the families for ``tokens``, and the best ``family``."""
        grams = windows.withColumn("__grams", _grams(F.col("tokens")))
        counted = self.vectorizer.transform(grams)
        scored = self.regression.transform(counted.drop("__grams"))
        # Not deterministic by name only, so that a filter above isn't moved below and the scores computed once more for it.
        scored = scored.withColumn("raw", F.when(F.spark_partition_id() >= 0, vector_to_array(F.col("__raw")))).drop("__features", "__raw")
        family = F.element_at(F.array(*map(F.lit, self.families)), F.array_position("raw", F.array_max("raw")).cast("int"))
        return scored.withColumn("family", family)


    def word_bounds(self) -> tuple[list[float], float]:
        """How much a word can speak for some licence and against ``none``, by its hash, and how much a window needs.

        The most that a word adds to a family's lead over ``none`` is counted for it, and that of a pair for the
        word of it that adds more by itself, or half for each where neither adds anything.  The sum over a window's words
        is therefore at least the lead of any family, less the lead of the intercepts: a window below it is ``none``.
        """
        weights = self.regression.coefficientMatrix.toArray()
        intercepts = self.regression.interceptVector.toArray()
        lead = np.maximum((weights[1:] - weights[0]).max(axis=0), 0.0)
        known = dict(zip(self.vectorizer.vocabulary, lead.tolist()))
        alone = {gram: x for gram, x in known.items() if x > 0 and " " not in gram}
        paired: tuple[dict[str, float], dict[str, float]] = ({}, {})
        for gram, x in known.items():
            if x > 0 and " " in gram:
                both = gram.split(" ")
                first, second = (alone.get(w, 0.0) for w in both)
                shares = (0.5, 0.5) if first == second == 0 else (float(first > second), float(first <= second))
                for side, word, share in zip(paired, both, shares):
                    side[word] = max(side.get(word, 0.0), x * share)
        needed = float(-(intercepts[1:] - intercepts[0]).max())
        table = [0.0] * WORD_SLOTS
        for word in alone.keys() | paired[0].keys() | paired[1].keys():
            slot = xxhash.xxh64_intdigest(word.encode(), 42) % WORD_SLOTS
            table[slot] = max(table[slot], alone.get(word, 0.0) + paired[0].get(word, 0.0) + paired[1].get(word, 0.0))
        return table, needed - 1e-6


def _softmax(raw: Column, temperature: float) -> Column:
    top = F.array_max(raw)
    powers = F.transform(raw, lambda x: F.exp((x - top) / temperature))
    return F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda a, b: a + b))


def _hash(*parts) -> int:
    return zlib.crc32("\0".join(map(str, parts)).encode())


def training_rows(docs: DataFrame) -> DataFrame:
    """(tokens, label, held_out): templates with words left out and foreign words around, cut to windows, and other text.

    The other text is the first words of at most ``SAMPLE_ROWS`` documents without licence language, those with the least hash of
    doc_id.  They are looked for among some ``DRAWN_ROWS`` documents with the least hash, so that the last step orders
    no more rows in a corpus of more files.
    """
    spark = docs.sparkSession
    families = [NONE, *TEMPLATES]
    drawn = docs.where(F.shiftrightunsigned(F.xxhash64("doc_id"), 1) <= int(2 ** 63 * min(1, DRAWN_ROWS / max(1, docs.count()))) - 1)
    sample = drawn.where(~F.col("text").rlike(CUE)).select(
        "doc_id", F.slice(words(F.substring("text", 1, 1000)), 1, 40).alias("tokens"))
    sample = [r["tokens"] for r in sample.orderBy(F.xxhash64("doc_id"), "doc_id", "tokens").limit(SAMPLE_ROWS).collect() if r["tokens"]]
    listed = [(f, t, VARIANTS) for f, ts in TEMPLATES.items() for t in ts] + [(f, t, NAMED_VARIANTS) for f, ts in NAMED.items() for t in ts]
    texts = spark.createDataFrame([(i, t) for i, (_, t, _) in enumerate(listed)], "i int, text string").select("i", words(F.col("text")).alias("tokens"))
    rows = []
    for i, tokens in sorted(map(tuple, texts.collect())):
        family, text, variants = listed[i]
        for v in range(variants):
            kept = [w for k, w in enumerate(tokens) if v == 0 or variants == NAMED_VARIANTS or _hash(w, k, v) % 100 >= 12]
            first = _hash("first", text, v) % (len(kept) - WINDOW + 1) if len(kept) > WINDOW else 0
            kept = kept[first:first + WINDOW]
            # Foreign words: of other text in every second variant, else words never seen.
            spare = sample[_hash("spare", text, v) % len(sample)] if sample and v % 2 else [
                hashlib.md5(f"{k} {v} {text}".encode()).hexdigest()[:5] for k in range(8)]
            before, after = spare[:v % 5], spare[5:5 + v % 4]
            rows.append((before + kept + after, float(families.index(family)), _hash("held", v) % 4 == 0))
    for tokens in sample:
        held = _hash("held", *tokens) % 4 == 0
        rows += [(tokens[k:k + WINDOW], 0.0, held) for k in range(0, max(1, len(tokens) - STEP), WINDOW)]
        rows.append((tokens[:1 + _hash(*tokens) % NARROW], 0.0, held))
    return spark.createDataFrame(rows, "tokens array<string>, label double, held_out boolean")


def train(docs: DataFrame) -> LicenceModel:
    """Fit on three quarters of the training rows; calibrate temperature and threshold on the rest."""
    families = [NONE, *TEMPLATES]
    grams = training_rows(docs).withColumn("__grams", _grams(F.col("tokens"))).cache()
    # Known n-grams instead of hashed ones: words never seen say nothing, and the coefficients stay a dense matrix.
    vectorizer = CountVectorizer(binary=True, minDF=MIN_ROWS, vocabSize=1 << 20, inputCol="__grams", outputCol="__features").fit(grams)
    rows = vectorizer.transform(grams).cache()
    regression = LogisticRegression(featuresCol="__features", labelCol="label", rawPredictionCol="__raw", probabilityCol="",
                                    predictionCol="", family="multinomial", regParam=0.002, maxIter=40)
    fitted = regression.fit(rows.where("NOT held_out").select("__features", "label"))
    held = fitted.transform(rows.where("held_out")).select("label", vector_to_array(F.col("__raw")).alias("raw"))
    loss = held.agg(*[F.avg(-F.log(F.greatest(F.element_at(_softmax(F.col("raw"), t), (F.col("label") + 1).cast("int")), F.lit(1e-12)))).alias(str(i))
                      for i, t in enumerate(TEMPERATURES)]).first()
    temperature = TEMPERATURES[min(range(len(TEMPERATURES)), key=lambda i: loss[i] if loss[i] is not None else 0)]
    judged = held.withColumn("p", _softmax(F.col("raw"), temperature))
    best = F.array_max("p")
    right = (F.array_position("p", best) == F.col("label") + 1).cast("double")
    precision = judged.agg(*[F.avg(F.when(best >= t, right)).alias(str(i)) for i, t in enumerate(THRESHOLDS)]).first()
    threshold = next((t for i, t in enumerate(THRESHOLDS) if (precision[i] or 0) >= PRECISION), THRESHOLDS[-1])
    rows.unpersist()
    grams.unpersist()
    return LicenceModel(vectorizer, fitted, families, temperature, threshold)


def windows(docs: DataFrame, model: LicenceModel) -> DataFrame:
    """(doc_id, cue, around, at): windows of every paragraph, as the words around them and where among them they start.

    ``cue`` says that its paragraph has a word of licence language.  A window of another paragraph whose words can't lift any
    family above ``none`` has the family ``none`` (see :meth:`LicenceModel.word_bounds`) and is left out: the
    regression would say the same.  One lookup per word of the paragraph decides that for all windows that share it.
    A paragraph's words lie in one row.
    """
    table, needed = model.word_bounds()
    bounds = F.split(F.lit(",".join(f"{math.ceil(x * 1000) / 1000:g}" for x in table)), ",").cast("array<double>")

    def most(word: Column) -> Column:
        return F.get(bounds, F.xxhash64(word).bitwiseAND(F.lit(WORD_SLOTS - 1)).cast("int"))

    paragraphs = docs.where("text IS NOT NULL").select("doc_id", F.explode(F.split("text", PARAGRAPH)).alias("paragraph"))
    tokens = paragraphs.select("doc_id", F.col("paragraph").rlike(CUE).alias("cue"), words(F.col("paragraph")).alias("words"))
    # Not deterministic by name only, so that the words are not cut out again for each use.
    tokens = tokens.withColumn("words", F.when(F.spark_partition_id() >= 0, F.col("words"))).where(F.size("words") > 0)
    blocks = F.transform(F.sequence(F.lit(0), F.size("words") - 1, F.lit(STEP)), lambda i: F.aggregate(
        F.slice("words", i + 1, STEP), F.lit(0.0), lambda total, word: total + most(word)))
    weighed = tokens.withColumn("most", F.when(F.spark_partition_id() >= 0, blocks))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("words") - STEP - 1), F.lit(STEP))

    def able(i: Column) -> Column:
        """A window is two blocks."""
        block = F.floor(i / STEP).cast("int")
        return F.col("cue") | (F.get("most", block) + F.coalesce(F.get("most", block + 1), F.lit(0.0)) > needed)

    return weighed.select("doc_id", "cue", F.explode(F.transform(F.filter(starts, able), lambda i: F.struct(
        F.slice("words", F.greatest(i - AROUND, F.lit(0)) + 1, F.least(i, F.lit(AROUND)) + WINDOW + AROUND).alias("around"),
        F.least(i, F.lit(AROUND)).alias("at")))).alias("w")).select("doc_id", "cue", "w.*")


def _narrower() -> Column:
    """The window itself and the narrower ones within it, each with the words around."""
    last = F.greatest(F.lit(0), F.size("tokens") - NARROW_STEP - 1)

    def narrow(k: Column) -> Column:
        first = F.col("at") + k
        before = F.least(first, F.lit(NARROW_AROUND))
        return F.struct(F.slice("tokens", k + 1, NARROW).alias("tokens"),
                        F.slice("around", first - before + 1, before + NARROW + NARROW_AROUND).alias("around"), F.lit(False).alias("whole"))

    itself = F.struct(F.col("tokens"), F.col("around"), F.lit(True).alias("whole"))
    return F.concat(F.array(itself), F.transform(F.sequence(F.lit(0), last, F.lit(NARROW_STEP)), narrow))


def _template_pairs(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame([(f, t) for f, ts in TEMPLATES.items() for t in (*ts, *NAMED.get(f, ()))], "family string, text string")
    return rows.groupBy("family").agg(F.collect_list(pairs(words(F.col("text")))).alias("__templates"))


def scan_licences(docs: DataFrame, model: LicenceModel | None = None) -> DataFrame:
    """One row per doc_id of ``docs`` (doc_id, text): doc_id, n_passages, licence, families, probability, confirmed.

    ``licence`` is the confirmed family of the highest probability; ``unknown`` where there is
    licence language but no confirmed family; ``none`` without any.  ``families`` lists all confirmed
    ones.  ``n_passages`` counts the (overlapping) windows with licence language: those of which the regression
    is certain enough that they aren't ``none``, or that hold a word of ``CUE``.  Rows that share a doc_id are judged together; NULL and empty texts have none; other
    columns are ignored.  The model is fitted to ``docs`` unless one is given.
    """
    docs = docs.select("doc_id", "text")
    model = model or train(docs)
    seen = model.scored(windows(docs, model).withColumn("tokens", F.slice("around", F.col("at") + 1, WINDOW)))
    found = seen.where((F.col("family") != NONE) | (F.col("cue") & F.concat_ws(" ", "tokens").rlike(CUE)))
    units = model.scored(found.select("doc_id", F.explode(_narrower()).alias("u")).select("doc_id", "u.*"))
    calibrated = _softmax(F.col("raw"), model.temperature)
    units = units.withColumns({"probability": F.array_max(calibrated), "none": F.element_at(calibrated, 1)})
    # One row per family of the fixed list above, and one row of all.
    templates = _template_pairs(docs.sparkSession)
    every = templates.agg(F.flatten(F.collect_list("__templates")).alias("__every"))
    compared = units.join(F.broadcast(templates), "family", "left").crossJoin(F.broadcast(every)).withColumn("__pairs", pairs(F.col("around")))

    def best_share(lists: str) -> Column:
        return F.array_max(F.transform(lists, lambda t: F.size(F.array_intersect(t, F.col("__pairs"))) / F.size(F.array_distinct(t))))

    share = best_share("__templates")
    able = (F.col("probability") >= model.threshold) & (F.col("family") != NONE) & (share >= CONFIRMING_SHARE)
    # A narrow window may lack the word that tells two families apart: no other template may fit its surroundings better.
    confirmed = F.coalesce(F.when(able, F.col("whole") | (share >= best_share("__every"))), F.lit(False))
    sure = (F.col("none") < NONE_AT_MOST) | F.concat_ws(" ", "tokens").rlike(CUE)
    judged = compared.select("doc_id", (F.col("whole") & sure | confirmed).alias("language"), confirmed.alias("ok"), "family", "probability").groupBy("doc_id").agg(
        F.count_if("language").alias("n"), F.max_by("family", F.when(F.col("ok"), F.col("probability"))).alias("best"),
        F.max(F.when(F.col("ok"), F.col("probability"))).alias("p"),
        F.array_sort(F.collect_set(F.when(F.col("ok"), F.col("family")))).alias("all"))
    everyone = docs.select("doc_id").distinct().withColumnRenamed("doc_id", "__id")
    return everyone.join(judged, everyone["__id"].eqNullSafe(judged["doc_id"]), "left").select(
        F.col("__id").alias("doc_id"), F.coalesce("n", F.lit(0)).alias("n_passages"),
        F.when(F.coalesce("n", F.lit(0)) == 0, NONE).when(F.col("p").isNull(), UNKNOWN).otherwise(F.col("best")).alias("licence"),
        F.concat_ws(",", "all").alias("families"), F.col("p").alias("probability"), F.col("p").isNotNull().alias("confirmed"))
