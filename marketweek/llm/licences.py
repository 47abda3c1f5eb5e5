"""Licence families of paragraphs by a trained n-gram classifier and template comparison."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketweek.llm.storage import staged

NONE, UNKNOWN = "none", "unknown"
#: Short public notices of each family, the training rows and the texts to compare with.
TEMPLATES = {
    "mit": [
        "Released under the MIT License",
        "This project is licensed under the terms of the MIT license",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version",
    ],
    "lgpl": ["This library is licensed under the GNU Lesser General Public License, version 2.1"],
    "bsd": [
        "Licensed under the BSD 3-Clause License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met",
    ],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "cc-by": [
        "Licensed under CC BY 4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    ],
}
FAMILIES = sorted(TEMPLATES)
#: Bounds of the training data: paragraphs without licence, and variants of each template.
NEGATIVES, VARIANTS = 4000, 24
FEATURES = 1 << 16
#: Share of a template's word pairs that confirms it, and that makes a licence unknown.
CONFIRM = 0.6
TEMPERATURES = (0.5, 0.75, 1.0, 1.5, 2.0, 3.0)
LEAST_PRECISION = 0.98


def words_of(text: Column) -> Column:
    """Lower-case runs of letters, digits, dots and dashes, without final dots."""
    clean = F.btrim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}.\-]+|\.(?=\s|$)", " "))
    return F.array_remove(F.split(clean, " +"), "")


def evaluated(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed once a row, however often later columns and filters use it.

    Spark copies a plain column's expression into every filter on top of it; it doesn't look
    through a generator, so the value is the one element of an array.
    """
    return df.select("*", F.explode_outer(F.array(value)).alias(name))


def grams(words: Column) -> Column:
    """Words and pairs of neighbouring words."""
    n = F.size(words)
    pairs = F.zip_with(F.slice(words, 1, n - 1), F.slice(words, 2, n), lambda a, b: F.concat_ws(" ", a, b))
    return F.when(n > 1, F.concat(words, F.slice(pairs, 1, n - 1))).otherwise(words)


def paragraphs(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(doc_id, paragraph, body)``: the lines of every text that hold a word."""
    lines = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.posexplode(F.split(F.col(text).cast("string"), "\n")).alias("paragraph", "body"),
    )
    return lines.where(F.btrim("body", F.lit(" \t\n\x0b\f\r")) != "")


def variants(spark: SparkSession) -> DataFrame:
    """Labelled rows from the templates: each with words left out or put before and after."""
    rows = [(k, i, t) for k, family in enumerate(FAMILIES) for i, t in enumerate(TEMPLATES[family])]
    base = spark.createDataFrame(rows, "label int, template int, body string")
    spread = base.withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(VARIANTS - 1))))
    spread = spread.withColumn("words", words_of(F.col("body")))
    chance = lambda w, i: F.pmod(F.xxhash64(w, i, F.col("variant")), F.lit(100))
    kept = F.filter(F.transform("words", lambda w, i: F.when((chance(w, i) >= 8) | (F.col("variant") == 0), w)),
                    lambda w: w.isNotNull())
    extra = F.when(F.col("variant") % 3 == 1, F.array(F.lit("copyright"), F.concat(F.lit("20"), F.lpad("variant", 2, "0"))))
    return spread.select(F.col("label").cast("double").alias("label"), "variant",
                         F.concat(F.coalesce(extra, F.array().cast("array<string>")), kept).alias("words"))


def template_score(words: Column, family: Column) -> Column:
    """Largest share of the word pairs of one of the family's templates found in ``words``."""
    pairs = F.array_distinct(F.filter(grams(words), lambda g: g.contains(" ")))

    def bigrams(t: str) -> Column:
        return F.array_distinct(F.filter(grams(words_of(F.lit(t))), lambda g: g.contains(" ")))

    table = F.create_map(*[x for f in FAMILIES for x in (F.lit(f), F.array(*map(bigrams, TEMPLATES[f])))])
    shares = F.transform(table[family], lambda t: F.size(F.array_intersect(t, pairs)) / F.size(t))
    return F.coalesce(F.array_max(shares), F.lit(0.0))


class LicenceModel:
    """The fitted classifier, its temperature and the threshold below which it is unsure."""

    def __init__(self, model: PipelineModel, temperature: float, threshold: float):
        self.model, self.temperature, self.threshold = model, temperature, threshold

    def scored(self, rows: DataFrame) -> DataFrame:
        """Add ``family`` and its calibrated ``probability``; needs ``words``."""
        raw = self.model.transform(evaluated(rows, "grams", grams(F.col("words"))))
        return self.judged(evaluated(raw, "_margin", vector_to_array("rawPrediction")), rows.columns)

    def judged(self, margins: DataFrame, columns: list[str]) -> DataFrame:
        """``columns``, the family with the largest ``_margin`` and its probability."""
        best = F.array_max("_margin")
        total = F.aggregate(
            F.transform("_margin", lambda x: F.exp((x - best) / self.temperature)), F.lit(0.0), lambda s, x: s + x
        )
        names = F.array(*[F.lit(f) for f in [*FAMILIES, NONE]])
        return margins.select(
            *columns, F.element_at(names, F.array_position("_margin", best).cast("int")).alias("family"),
            (1 / total).alias("probability"),
        )


def train(docs: DataFrame, text: str = "text") -> LicenceModel:
    """Fit on the template variants and a bounded sample of paragraphs without licence.

    The sample holds the ``NEGATIVES`` different paragraphs with the smallest hashes among those
    that no template resembles. A fifth of all rows is held out: the temperature minimises their log
    loss, the threshold keeps their precision at ``LEAST_PRECISION``.
    """
    spark = docs.sparkSession
    plain = paragraphs(docs, text).select("body").where("not lower(body) rlike 'licen[sc]e|copyright|redistribut'")
    some = plain.select("body", F.xxhash64("body").alias("h"))
    # Hashes below a bound that about twice as many paragraphs meet, so that only few bodies move;
    # the sketch is a few kilobytes a task. Equal paragraphs count once.
    n = max(1, some.agg(F.approx_count_distinct("h")).first()[0])
    bound = min(2**63 - 1, -(2**63) + 2**64 * 2 * NEGATIVES // n)
    sample = some.where(F.col("h") <= bound).distinct().orderBy("h", "body").limit(NEGATIVES)
    negative = sample.select(F.lit(float(len(FAMILIES))).alias("label"), F.pmod(F.xxhash64("body"), F.lit(VARIANTS)).cast("int").alias("variant"),
                             words_of(F.col("body")).alias("words"))
    rows = staged(variants(spark).unionByName(negative).withColumn("grams", grams(F.col("words"))), "licence-rows")
    fit, held = rows.where("variant % 5 <> 4"), rows.where("variant % 5 = 4")
    model = Pipeline(stages=[
        HashingTF(inputCol="grams", outputCol="counts", numFeatures=FEATURES, binary=True),
        IDF(inputCol="counts", outputCol="features"),
        LogisticRegression(family="multinomial", regParam=1e-4, maxIter=40),
    ]).fit(fit)
    scored = model.transform(held).select("label", vector_to_array("rawPrediction").alias("m"))
    loss = lambda t: F.avg(
        F.log(F.aggregate("m", F.lit(0.0), lambda s, x: s + F.exp((x - F.array_max(F.col("m"))) / t)))
        - (F.element_at("m", (F.col("label") + 1).cast("int")) - F.array_max("m")) / t
    )
    losses = scored.agg(*[loss(t).alias(f"t{k}") for k, t in enumerate(TEMPERATURES)]).first()
    temperature = min(zip(TEMPERATURES, losses), key=lambda x: x[1] if x[1] is not None else 0.0)[0]
    fitted = LicenceModel(model, temperature, 0.5)
    names = F.array(*[F.lit(f) for f in [*FAMILIES, NONE]])
    judged = fitted.judged(scored.withColumnRenamed("m", "_margin"), ["label"]).where(F.col("family") != NONE).select(
        "probability", (F.element_at(names, (F.col("label") + 1).cast("int")) == F.col("family")).alias("right"))
    steps = [0.5, 0.6, 0.7, 0.8, 0.9, 0.95]
    precision = judged.agg(*[
        F.avg(F.when(F.col("probability") >= s, F.col("right").cast("double"))).alias(f"s{k}") for k, s in enumerate(steps)
    ]).first()
    fitted.threshold = next((s for s, p in zip(steps, precision) if p is not None and p >= LEAST_PRECISION), steps[-1])
    return fitted


def scan(docs: DataFrame, text: str = "text", model: LicenceModel | None = None) -> DataFrame:
    """Paragraphs with a licence: ``(doc_id, paragraph, family, probability, template_score)``.

    Every paragraph is classified. One whose family is sure and confirmed by a template of the
    family keeps it; one that the classifier takes for a licence but is unsure of, or that no
    template confirms, is ``unknown`` when it names a licence at all, and no licence otherwise.

    Null and empty texts have no paragraphs; repeated rows and null doc_ids stay; a table
    without paragraphs is classified by the templates alone; other columns are ignored.
    """
    model = model or train(docs, text)
    rows = evaluated(paragraphs(docs, text), "words", words_of(F.col("body")))
    scored = model.scored(rows).where(F.col("family") != NONE)
    score = template_score(F.col("words"), F.col("family"))
    sure = (F.col("probability") >= model.threshold) & (F.col("template_score") >= CONFIRM)
    named = F.exists("words", lambda w: w.rlike("licen[sc]|copyright|redistribut"))
    return (
        scored.withColumn("template_score", score)
        .withColumn("family", F.when(sure, F.col("family")).when(named, F.lit(UNKNOWN)))
        .where("family is not null")
        .select("doc_id", "paragraph", "family", "probability", "template_score")
    )
