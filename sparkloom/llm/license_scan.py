"""License scan by a trained paragraph classifier. DataFrame functions and pyspark.ml on the JVM only.

Paragraphs (lines, neighbouring lines and whole blocks of lines) become sparse binary vectors of hashed
words and word pairs; a multinomial logistic regression with an L1 share, fitted on notices made from
the families' names and texts and on a bounded sample of paragraphs of the corpus, gives a family,
"unknown" (a notice of no listed family) or "none". The scores of every paragraph are calibrated by a temperature, fitted on training rows and licences that were set aside. What is
probably not "none" is a notice. It has a family if that is likely enough and one of its templates
confirms it; else it is of the family "unknown".
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.llm.common import col, fresh, text_or_empty

# Names of licence families, and sentences of their notices.
FAMILIES: dict[str, list[str]] = {
    "apache": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0"],
    "mit": ["MIT License", "MIT licence", "Expat License"],
    "bsd": ["BSD License", "BSD 3-Clause License", "BSD 2-Clause License", "BSD-3-Clause"],
    "gpl": ["GNU General Public License, version 3", "GNU General Public License, version 2", "GNU GPL", "GPL-3.0-or-later"],
    "lgpl": ["GNU Lesser General Public License", "GNU LGPL", "LGPL-2.1"],
    "agpl": ["GNU Affero General Public License", "GNU AGPL", "AGPL-3.0"],
    "mpl": ["Mozilla Public License, version 2.0", "Mozilla Public License", "MPL-2.0"],
    "isc": ["ISC License", "ISC licence"],
    "epl": ["Eclipse Public License", "EPL-2.0"],
    "cc-by": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution License"],
    "cc-by-sa": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 License"],
    "cc-by-nc": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 License", "CC BY-NC-SA 4.0"],
    "cc-by-nd": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 License"],
    "cc0": ["CC0 1.0 Universal", "CC0 public domain dedication"],
    "proprietary": ["proprietary license, all rights reserved", "commercial license agreement"],
}
SENTENCES: list[tuple[str, str]] = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("proprietary", "All rights reserved. No part of this publication may be reproduced without written permission"),
]
PHRASES = [
    "Licensed under the {}.",
    "Licensed under {}.",
    "Released under the {}.",
    "Released under {}.",
    "This work is licensed under the {}.",
    "This work is licensed under a {}.",
    "Distributed under the terms of the {}.",
    "This project is available under the {}.",
    "Published under {}",
    "SPDX-License-Identifier: {}",
    "License: {}",
    "The text may be used under the {}.",
]
NEAR_MISSES = [
    "The driver showed his license to the officer.",
    "A licensed practitioner must be present at all times.",
    "The copyright office opened a new branch in the city.",
    "Free software is discussed in the next chapter.",
    "The general public was invited to the version two premiere.",
    "Version 4.0 of the plan was released under pressure.",
    "She studied at the MIT campus for two terms.",
    "The apache helicopter flew over the commons.",
    "Creative people in common rooms share work.",
    "The public library is open to the general public.",
    "Er ging mit der Frau in die Stadt.",
    "Sie kam mit ihm und mit den Kindern.",
    "Das Haus mit dem Garten ist mit Holz gebaut.",
    "Cc: by noon, and the by line is under the fold.",
]
#: Licences outside the families: their notices are of the class "unknown". The second list is never
#: fitted on; it only serves the temperature and the confidence below which a family is not named.
UNLISTED = ["zlib License", "Boost Software License 1.0", "Artistic License 2.0", "SIL Open Font License, version 1.1", "PostgreSQL License", "Common Development and Distribution License", "Microsoft Public License", "BSL-1.0"]
UNLISTED_ASIDE = ["European Union Public Licence 1.2", "Python Software Foundation License", "Academic Free License, version 3.0", "Open Data Commons License", "Zope Public License 2.1", "IBM Public License", "NCSA Open Source License"]
NONE, UNKNOWN = "none", "unknown"
FEATURES = 1 << 12
BACKGROUND = 2000
CONFIRMED = 0.75
NOTICE = 0.8
#: Parts of words, one of which every notice holds that the model is fitted on, and without which no template can be
#: confirmed. A paragraph without any is no notice, by definition; the others are classified.
HINTS = ["licen", "permi", "copyright", "software", "redistribut", "rights", "gpl", "mpl", "epl", "bsd", "apache", "under", "public", "document", "notice", "hereby", "source", "modif", "terms", "later", "general", "reserved", "written", "publication", "reproduced", "obtain", "compliance", "provided", "conditions", "binary", "associated", "substantial", "portions", "universal", "domain", "dedication", "distribute", "purpose"]
HINT_WORDS = r"\b(?:cc0?|by\W+(?:nc|nd|sa)|creative|or\W+later)\b"
#: Marks of comments at the ends of a line.
COMMENT_MARKS = r"^\s*(?:/\*+|\*+/?|/{2,}!?|#+|;+|-{2,}|%+|<!--|\"{3}|'{3})|(?:\*+/|-->|\*+|#+)\s*$"
LIKE_TEMPLATE = 0.6
CONFIDENCES = [0.1, 0.2, 0.3, 0.4, 0.5]
TEMPERATURES = [0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0]


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def grams(tokens: Column) -> Column:
    """Words and pairs of neighbouring words; the last word, without a neighbour, comes twice.

    ``tokens`` should be a column of its own, as it is used more than once.
    """
    following = F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0)))
    return F.concat(tokens, F.zip_with(tokens, following, lambda a, b: F.concat_ws(" ", a, b)))


def with_grams(df: DataFrame) -> DataFrame:
    return df.withColumn("tokens", words(F.col("text"))).withColumn("grams", grams(F.col("tokens"))).drop("tokens")


def _hashed() -> HashingTF:
    return HashingTF(inputCol="grams", outputCol="features", numFeatures=FEATURES, binary=True)


@dataclass
class LicenseModel:
    regression: LogisticRegressionModel
    families: list[str]
    temperature: float
    confidence: float


def background(docs: DataFrame, most: int) -> DataFrame:
    """A line and the joined lines of each of the at most ``most`` documents with the smallest hashed texts.
    The bound is a parameter; documents are first thinned by their hash to about twice as many, so that sorting them
    takes no more than that."""
    some = docs.where("text is not null")
    share = min(1.0, 2.0 * most / max(1, some.count()))
    h = F.xxhash64("text")
    thin = some.select("text", h.alias("h")).where(F.pmod("h", F.lit(1 << 30)) < share * (1 << 30))
    lines = F.split("text", "\n")
    least = thin.orderBy("h", "text").limit(most)
    line = F.element_at(lines, (F.pmod("h", F.size(lines)) + 1).cast("int"))
    return least.select(F.explode(F.array_distinct(F.array(line, F.array_join(lines, " ")))).alias("text"))


def training_rows(spark: SparkSession, docs: DataFrame, most_background: int) -> DataFrame:
    notices = [(f, p.format(n)) for f, names in FAMILIES.items() for n in names for p in PHRASES]
    notices += [(f, s) for f, s in SENTENCES for _ in range(4)] + [(NONE, s) for s in NEAR_MISSES for _ in range(4)]
    notices += [(UNKNOWN, p.format(n)) for n in UNLISTED for p in PHRASES]
    # texts that come several times are always fitted on: set aside, none of their copies would be
    several = {s for _, s in SENTENCES} | {*NEAR_MISSES}
    rows = [(f, t, False if t in several else None) for f, t in notices] + [(UNKNOWN, p.format(n), True) for n in UNLISTED_ASIDE for p in PHRASES]
    made = spark.createDataFrame(rows, "family string, text string, aside boolean")
    # a notice among the corpus' paragraphs must not be learnt as none
    other = with_grams(background(docs, most_background)).where(template_similarity(F.col("grams")) < LIKE_TEMPLATE)
    return made.unionByName(other.select(F.lit(NONE).alias("family"), "text", F.lit(None).cast("boolean").alias("aside")))


def train(docs: DataFrame, most_background: int = BACKGROUND) -> LicenseModel:
    """Fit on four fifths of the training rows. On the rest and on notices of licences that the fit has not
    seen, choose the temperature by its likelihood, then the confidence by which fewest notices get a
    wrong family."""
    spark = docs.sparkSession
    families = [NONE, *FAMILIES, UNKNOWN]
    label = reduce(lambda c, k: F.when(F.col("family") == families[k], float(k)).otherwise(c), range(len(families)), F.lit(0.0))
    rows = _hashed().transform(with_grams(training_rows(spark, docs, most_background)).select(label.alias("label"), F.xxhash64("text", "family").alias("h"), "aside", "grams"))
    # the table is small by its parameters; it is read in every step of the fit
    rows = rows.select("label", "features", F.coalesce("aside", F.pmod("h", F.lit(5)) == 0).alias("aside")).coalesce(4).cache()
    weight = F.when(F.col("label") == 0, 1.0).otherwise(2.0)
    fit = LogisticRegression(family="multinomial", regParam=2e-4, elasticNetParam=0.3, maxIter=40, standardization=False, weightCol="weight")
    model = fit.fit(rows.where("not aside").withColumn("weight", weight))
    raw = model.transform(rows.where("aside")).select("label", vector_to_array("rawPrediction").alias("raw"))
    losses = raw.agg(*[F.avg(-F.log(F.greatest(F.element_at(softmax(F.col("raw"), t), F.col("label").cast("int") + 1), F.lit(1e-12)))).alias(f"t{k}") for k, t in enumerate(TEMPERATURES)]).first()
    order = sorted(range(len(TEMPERATURES)), key=lambda k: (losses[k] if losses[k] is not None else 0.0, abs(TEMPERATURES[k] - 1)))
    temperature = TEMPERATURES[order[0]]
    told = raw.where("label > 0").select("label", softmax(F.col("raw"), temperature).alias("p")).select("label", "p", best_family("p").alias("best"))
    wrong = [F.count_if(F.when(F.element_at("p", F.col("best")) >= c, F.col("best") - 1).otherwise(len(families) - 1) != F.col("label")).alias(f"c{k}") for k, c in enumerate(CONFIDENCES)]
    errors = told.agg(*wrong).first()
    rows.unpersist()
    return LicenseModel(model, families, temperature, CONFIDENCES[min(range(len(CONFIDENCES)), key=lambda k: (errors[k], k))])


def best_family(p: str) -> Column:
    """Place, from 1, of the likeliest family; neither "none", the first, nor "unknown", the last, is one."""
    named = F.slice(p, F.lit(2), F.size(p) - 2)
    return (F.array_position(named, F.array_max(named)) + 1).cast("int")


def softmax(raw: Column, temperature: float) -> Column:
    top = F.array_max(raw)
    powers = F.transform(raw, lambda x: F.exp((x - top) / temperature))
    total = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
    return F.transform(powers, lambda x: x / total)


def _template_grams() -> dict[str, list[list[str]]]:
    """Distinct words and pairs of each family's templates, as :func:`grams` gives them (ASCII only)."""
    out = {}
    for family, names in FAMILIES.items():
        out[family] = []
        for text in [*names, *(s for f, s in SENTENCES if f == family)]:
            w = re.findall(r"[a-z0-9]+", text.lower())
            out[family].append(sorted({*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))}))
    return out


def template_similarity(mine: Column, family: Column | None = None) -> Column:
    """Largest share of a template's words and pairs that ``mine`` holds, over the family's names and
    sentences, or those of all families."""
    best = {f: F.greatest(F.lit(0.0), *[F.size(F.array_intersect(F.lit(g), mine)) / len(g) for g in templates]) for f, templates in _template_grams().items()}
    if family is None:
        return F.greatest(*best.values())
    return reduce(lambda c, f: F.when(family == f, best[f]).otherwise(c), best, F.lit(0.0))


def hinted(text: Column) -> Column:
    return hinted_lower(F.lower(text))


def hinted_lower(low: Column) -> Column:
    """:func:`hinted` of a text in lower case; that should be a column of its own, as it is used many times."""
    return reduce(lambda a, h: a | low.contains(h), HINTS[1:], low.contains(HINTS[0])) | low.rlike(HINT_WORDS)


def paragraphs_of(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` but its text; ``paragraph`` and ``last``, the first and last line (from 0),
    ``block``, ``whole`` and ``text``; only paragraphs that are :func:`hinted`.

    A block is a run of lines with letters or digits, so empty lines and bare comment marks end it. Each line
    is a row; so are each block of several lines, and each two and three neighbouring lines of longer blocks.
    Joined lines lose the marks of comments. Texts without a hint are not cut at all.
    """
    kept = [c for c in docs.columns if c != "text"]
    text = text_or_empty(F.col("text"))
    # an explode keeps the lower-case text from being computed for each hint
    lower = docs.select(*kept, text.alias("text"), F.explode(F.array(F.lower(text))).alias("low"))
    cut = lower.where(hinted_lower(F.col("low"))).select(*kept, F.split("text", "\n").alias("lines"))
    several = F.size("lines") > 1
    cut = cut.withColumn("plain", F.when(several, F.transform("lines", lambda x: F.trim(F.regexp_replace(x, COMMENT_MARKS, "")))).otherwise(F.array().cast("array<string>")))
    cut = cut.withColumn("full", F.transform("plain", lambda x: x.rlike(r"[\p{L}\p{N}]")))
    n = F.size("plain")
    places = F.when(n > 0, F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<int>"))

    def on(i: Column) -> Column:
        return F.coalesce(F.get("full", i - 1), F.lit(False))

    # arrays are computed once, before the rows that use them: an explode keeps them from being moved
    cut = cut.withColumn("starts", F.filter(places, lambda i: on(i) & ~on(i - 1))).withColumn("ends", F.filter(places, lambda i: on(i) & ~on(i + 1)))
    cut = cut.select(*kept, "lines", "plain", F.explode_outer(F.array(F.filter(F.arrays_zip("starts", "ends"), lambda b: b["ends"] > b["starts"]))).alias("blocks"))
    one = F.transform("lines", lambda x, i: F.struct(i.alias("paragraph"), i.alias("last"), F.lit(None).cast("int").alias("block"), F.lit(False).alias("whole"), x.alias("text")))

    def row(first: Column, last: Column, block: Column, whole: bool) -> Column:
        return F.struct((first - 1).alias("paragraph"), (last - 1).alias("last"), (block - 1).alias("block"), F.lit(whole).alias("whole"), F.array_join(F.slice("plain", first, last - first + 1), " ").alias("text"))

    def windows(size: int) -> Column:
        longer = F.filter("blocks", lambda b: b["ends"] - b["starts"] >= size)
        return F.flatten(F.transform(longer, lambda b: F.transform(F.sequence(b["starts"], b["ends"] - (size - 1)), lambda i: row(i, i + (size - 1), b["starts"], False))))

    whole = F.transform("blocks", lambda b: row(b["starts"], b["ends"], b["starts"], True))
    rows = cut.select(*kept, "blocks", F.explode_outer(F.concat(one, whole, windows(2), windows(3))).alias("r"))
    rows = rows.withColumn("low", F.explode(F.array(F.lower("r.text")))).where(hinted_lower(F.col("low")))
    inside = F.get(F.filter("blocks", lambda b: (b["starts"] <= F.col("r.paragraph") + 1) & (b["ends"] > F.col("r.paragraph"))), F.lit(0))["starts"] - 1
    return rows.select(*kept, "r.paragraph", "r.last", F.coalesce("r.block", inside, "r.paragraph").alias("block"), "r.whole", "r.text")


def findings(docs: DataFrame, model: LicenseModel, confirmed: float = CONFIRMED) -> DataFrame:
    """One row per notice: the columns of ``docs`` but its text, ``paragraph`` and ``last`` (its lines, from
    0), ``family``, ``predicted``, ``probability`` (of being a notice), ``similarity`` and ``text``; ours are
    lengthened by ``_`` where a column that stays has the name.

    A family's notice that no line of a block holds alone is the smallest and most similar run of lines that
    does, once a block. Lines within it that are confirmed for no family are parts of it. A whole block is
    an unknown notice only if nothing else is found in it.
    """
    columns = [c for c in docs.columns if c != "text"]
    # in one column, so that their names meet none of ours
    packed = docs.select(F.struct(*[col(docs, c) for c in columns]).alias("kept"), "text")
    kept = ["kept"]
    mine = [*kept, "paragraph", "last", "block", "whole", "text"]
    vectors = _hashed().transform(with_grams(paragraphs_of(packed)))
    raw = model.regression.transform(vectors).select(*mine, vector_to_array("rawPrediction").alias("raw"))
    # a filter is not moved below the explode, where it would score each paragraph several times
    raw = raw.select(*mine, F.explode(F.array("raw")).alias("raw"))
    none = F.element_at("raw", 1)
    odds = F.aggregate(F.slice("raw", 2, len(model.families) - 1), F.lit(0.0), lambda a, x: a + F.exp((x - none) / model.temperature))
    notices = raw.where(1 - 1 / (1 + odds) >= NOTICE).withColumn("p", softmax(F.col("raw"), model.temperature))
    notices = notices.select(*mine, F.explode(F.array("p")).alias("p"))
    names = F.array(*[F.lit(f) for f in model.families])
    told = notices.withColumn("best", best_family("p"))
    told = told.select(*mine, (1 - F.element_at("p", 1)).alias("probability"), F.element_at("p", F.col("best")).alias("sure"), F.element_at(names, F.col("best")).alias("predicted"))
    compared = with_grams(told).withColumn("similarity", template_similarity(F.col("grams"), F.col("predicted")))
    compared = compared.select(*mine, "probability", "sure", "predicted", F.explode(F.array("similarity")).alias("similarity"))
    family = F.when((F.col("similarity") >= confirmed) & (F.col("sure") >= model.confidence), F.col("predicted")).otherwise(F.lit(UNKNOWN))
    one, known = F.col("paragraph") == F.col("last"), F.col("family") != UNKNOWN
    found = compared.withColumn("family", family).where(one | known | F.col("whole")).distinct()
    in_block = [*kept, "block"]
    best = W.partitionBy(*in_block, "family").orderBy(F.col("last") - F.col("paragraph"), F.desc("similarity"), "paragraph")
    found = found.withColumn("at", F.row_number().over(best)).where(one | ~known | (F.col("at") == 1))
    wide = F.collect_list(F.when(known & ~one, F.struct("paragraph", "last"))).over(W.partitionBy(*in_block))
    inside = F.exists(wide, lambda w: (w["paragraph"] <= F.col("paragraph")) & (F.col("last") <= w["last"]))
    found = found.withColumn("inside", inside).where(known | ~one | ~F.col("inside"))
    found = found.withColumn("others", F.count_if(known | one).over(W.partitionBy(*in_block))).where(known | one | (F.col("others") == 0))
    own = {"paragraph": F.col("paragraph"), "last": F.col("last"), "family": F.col("family"), "predicted": F.col("predicted"), "probability": F.round("probability", 6), "similarity": F.round("similarity", 6)}
    names = fresh(docs, *own)
    made = F.struct(*[c.alias(n) for n, c in zip(names, own.values(), strict=True)], "text")
    return found.select("kept", made.alias("made")).select("kept.*", "made.*")


def scan(df: DataFrame, model: LicenseModel | None = None, id_col: str = "doc_id", text_col: str = "text", most_background: int = BACKGROUND) -> DataFrame:
    """One row per row of ``df``: ``doc_id, n_paragraphs, n_notices, licenses, paragraphs, similarity``.

    ``n_paragraphs`` counts lines. ``licenses`` are the families found, sorted and joined by commas, empty if
    none; ``paragraphs`` the lines where they begin; ``similarity`` the best template comparison, null if none. A null text counts as one empty
    paragraph. Rows of equal id and text are scanned once and repeated; a null id is like any other.
    """
    docs = df.select(col(df, id_col).alias("doc_id"), col(df, text_col).cast("string").alias("text"))
    model = model or train(docs, most_background)
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    # a document without a notice is a row of counts; both kinds of rows are merged by task before the shuffle
    plain = keyed.select("doc_id", "text_hash", F.size(F.split(text_or_empty(F.col("text")), "\n")).alias("n_paragraphs"))
    found = findings(keyed, model).select("doc_id", "text_hash", "paragraph", "family", "similarity")
    by_doc = found.distinct().groupBy("doc_id", "text_hash").agg(
        F.count("*").cast("long").alias("n_notices"),
        F.array_join(F.array_sort(F.collect_set("family")), ",").alias("licenses"),
        F.array_sort(F.collect_list("paragraph")).alias("paragraphs"),
        F.max("similarity").alias("similarity"),
    )
    named = by_doc.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "n_notices", "licenses", "paragraphs", "similarity")
    joined = plain.join(named, (F.col("text_hash") == F.col("h")) & F.col("doc_id").eqNullSafe(F.col("d")), "left")
    return joined.select(
        "doc_id",
        F.col("n_paragraphs").cast("long").alias("n_paragraphs"),
        F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"),
        F.coalesce("licenses", F.lit("")).alias("licenses"),
        F.coalesce("paragraphs", F.array().cast("array<int>")).alias("paragraphs"),
        "similarity",
    )
