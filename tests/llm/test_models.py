"""Trained operators: licence scan, quality classifier."""

import re
import zlib

import numpy as np
import pytest

from sparkloom.llm import license_scan as L
from sparkloom.llm import quality as Q

# --- licences


@pytest.fixture(scope="module")
def licence_model(documents):
    return L.train(documents, most_background=300)


def test_licence_lines_are_found_and_others_are_not(spark, licence_model, documents):
    notices = {
        "Released under the MIT License.": "mit",
        "This work is licensed under the GNU General Public License, version 3.": "gpl",
        "Licensed under the Apache License, Version 2.0.": "apache",
        "Licensed under CC BY-NC 4.0.": "cc-by-nc",
        "You can use it under the Mozilla Public License, version 2.0": "mpl",
    }
    rows = [(i, f"Some words come first.\n{n}\nAnd then others.") for i, n in enumerate(notices)]
    rows += [(100, "The driver showed his license to the officer."), (101, None), (102, ""), (103, "word " * 100_000), (100, "The driver showed his license to the officer."), (None, "Released under the MIT License.")]
    df = spark.createDataFrame([(*r, "x", i) for i, r in enumerate(rows)], "doc_id long, text string, family string, similarity int")
    got = L.scan(df, licence_model).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    for i, family in enumerate(notices.values()):
        assert (by[i]["licenses"], by[i]["paragraphs"], by[i]["n_paragraphs"]) == (family, [1], 3)
    assert by[None]["licenses"] == "mit" and by[None]["similarity"] == 1.0
    assert all(by[i]["n_notices"] == 0 and by[i]["licenses"] == "" for i in (100, 101, 102, 103))
    assert L.scan(df.where("false"), licence_model).count() == 0


def test_licences_of_the_table(licence_model, documents):
    want = {r["doc_id"] for r in documents.collect() if re.search(r"(?im)^(licensed under|released under|this work is licensed)", r["text"])}
    got = L.scan(documents, licence_model).collect()
    named = {r["doc_id"] for r in got if set(r["licenses"].split(",")) - {"", L.UNKNOWN}}
    assert len(got) == documents.count() and named == want


def test_template_grams_are_those_of_columns(spark):
    from pyspark.sql import functions as F

    for family, names in L.FAMILIES.items():
        mine = [sorted(set(r[0])) for r in spark.createDataFrame([(n,) for n in names], "t string").coalesce(1).select(F.array_distinct(L.grams(L.words(F.col("t"))))).collect()]
        assert mine == L._template_grams()[family][: len(names)]


def scanned(spark, model, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [(r["licenses"], r["paragraphs"]) for r in sorted(L.scan(df, model).collect(), key=lambda r: r["doc_id"])]


def test_notices_of_unlisted_licences_are_unknown(spark, licence_model):
    names = ["Sleepycat License", "Ruby License", "Vim License", "Eiffel Forum License", "Sun Public License"]
    assert not set(names) & {*L.UNLISTED, *L.UNLISTED_ASIDE}
    texts = [p.format(n) for n in names for p in ("Licensed under the {}.", "This work is licensed under the {}.", "Released under the {}.")]
    got = scanned(spark, licence_model, *(f"First some words.\n{t}\nAnd then others." for t in texts))
    assert got == [("unknown", [1])] * len(texts)
    assert licence_model.families[-1] == L.UNKNOWN and licence_model.confidence in L.CONFIDENCES


def test_wrapped_notices_are_seen_whole(spark, licence_model):
    mit = "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated documentation\nfiles"
    bsd = " * Redistribution and use in source and binary forms, with or\n * without modification, are permitted provided that the\n * following conditions are met"
    apache = "# you may not use this file except in compliance with\n# the License. You may obtain a copy of the License at\n# apache.org"
    prose = "Sie kam mit ihm und mit den Kindern.\nThe public library is open to the general public."
    got = scanned(spark, licence_model, f"Some words.\n\n{mit}\n\nOthers.", f"/*\n{bsd}\n */\nint x;", apache, f"{prose}\n{mit}\n{prose}", prose)
    assert got == [("mit", [2]), ("bsd", [1]), ("apache", [0]), ("mit", [2]), ("", [])]


def test_no_notice_is_without_a_hint(spark):
    made = [p.format(n) for names in [*L.FAMILIES.values(), L.UNLISTED, L.UNLISTED_ASIDE] for n in names for p in L.PHRASES] + [t for _, t in L.SENTENCES]
    assert all(any(h in t.lower() for h in L.HINTS) or re.search(L.HINT_WORDS, t.lower()) for t in made)
    for templates in L._template_grams().values():
        for grams in templates:
            left = [g for g in grams if not any(h in g for h in L.HINTS) and not re.search(L.HINT_WORDS, g)]
            assert len(left) / len(grams) < L.CONFIRMED, grams


# --- quality


def brute_score(model, index, value):
    """The pairwise sum, term by term."""
    raw = model.bias + sum(model.linear[i] * x for i, x in zip(index, value, strict=True))
    for a in range(len(index)):
        for b in range(a + 1, len(index)):
            raw += float(model.factors[index[a]] @ model.factors[index[b]]) * value[a] * value[b]
    return raw


def test_sum_of_squares_identity():
    rng = np.random.default_rng(0)
    size = Q.STATISTICS + Q.BUCKETS
    model = Q.Model(0.3, rng.normal(size=size), rng.normal(size=(size, 4)), rng.normal(size=Q.STATISTICS), np.ones(Q.STATISTICS))
    rows = [Q.Featurizer()(t) for t in ("one two three two", "", "Ä!! 12 | x\ny")]
    got = Q._raw_scores(model, rows)
    for k, r in enumerate(rows):
        index, value, _ = Q._flat([r], model.mean, model.scale)
        assert got[k] == pytest.approx(brute_score(model, index, value))


def test_held_out_accuracy_and_folds(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = {r["doc_id"]: r for r in Q.classify(docs, labels).collect()}
    assert len(got) == docs.count()
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [i for i in truth if got[i]["held_out"]]
    assert np.mean([got[i]["predicted"] == truth[i] for i in held]) > 0.93
    kept = {r["doc_id"] for r in Q.keep_good(docs, labels).collect()}
    assert kept == {i for i, r in got.items() if r["predicted"]}


def test_scores_do_not_depend_on_id_language_or_source(spark, make_docs):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    docs = make_docs(*[(i, "good fine words here" if i % 2 else "### %%% $$$", f"s{i}") for i in range(60)], (900, "good fine words here", None), (901, None), (902, ""), (None, "### %%% $$$"))
    r = {x["doc_id"]: x for x in Q.classify(docs, labels).collect()}
    assert r[900]["score"] == r[1]["score"] > 0.5 > r[None]["score"] == r[0]["score"]
    assert r[901]["score"] == r[902]["score"] and r[None]["held_out"] is False


def test_quality_without_usable_labels(spark, make_docs):
    none = spark.createDataFrame([(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    assert [r["score"] for r in Q.classify(make_docs((1, "a"), (2, None)), none).collect()] == [0.5, 0.5]
    assert Q.classify(make_docs((1, "a")).where("false"), none).count() == 0
