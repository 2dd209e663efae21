"""Extra columns whose names the operators use themselves."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkloom.llm import license_scan, mixing, near_dedup, packing, preference, quality
from sparkloom.llm.queries import word_vocabulary


@pytest.fixture(scope="module")
def clash(make_docs):
    df = make_docs((1, "one two three four five six seven", "a"), (2, "one two three four five six seven", "b"), (3, None, None), (None, "Licensed under the MIT License.", "a"))
    return df.selectExpr("*", "1 as kept_id", "2 as group_id", "'x' as rep", "3 as row", "4 as skey", "5 as size", "6 as rate", "7 as piece", "8 as bucket", "'t' as tokens", "'g' as grams", "9 as raw", "1 as p", "2 as y", "0.5 as score", "1 as copies")


def test_whole_row_operators_keep_all_columns(clash, spark):
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert quality.keep_good(clash, labels, threshold=0.0).columns == clash.columns
    near = near_dedup.drop_near_duplicates(clash)
    assert near.columns == clash.columns and sorted((r["doc_id"] or 0) for r in near.collect()) == [0, 1, 3]
    mixed = mixing.mixed_rows(clash)
    assert mixed.columns == clash.columns and all(r["copies"] == 1 for r in mixed.collect())


def test_results_do_not_depend_on_other_columns(clash, spark, sf_dir):
    plain = clash.select("doc_id", "text", "lang", "source", "n_chars")
    for f in (near_dedup.near_duplicates, mixing.mix, lambda d: packing.pack_documents(d, word_vocabulary()), lambda d: quality.classify(d, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int"))):
        a, b = f(clash), f(plain)
        assert a.columns == b.columns and a.exceptAll(b).isEmpty()


def test_notices_keep_clashing_columns(clash, documents):
    model = license_scan.train(documents, most_background=100)
    found = license_scan.findings(clash.select("doc_id", "text", "tokens", "grams", "raw", "p"), model).collect()
    assert [(r["doc_id"], r["tokens"], r["grams"], r["raw"], r["p"], r["family"]) for r in found] == [(None, "t", "g", 9, 1, "mit")]


def test_pairs_keep_clashing_columns(spark):
    turn = "array<struct<role:string,text:string>>"
    df = spark.createDataFrame([(1, 2, 3, 4, "mine", [("user", "q"), ("assistant", "x")], [("user", "q"), ("assistant", "y")])], f"a int, b int, k int, p int, prompt string, chosen {turn}, rejected {turn}")
    r = preference.format_pairs(df).first()
    assert (r["a"], r["b"], r["k"], r["p"], r["prompt"], r["prompt_turns"]) == (1, 2, 3, 4, "mine", 1) and "q" in r["prompt_"]
    assert preference.format_pairs(df.select("chosen", "rejected")).columns[0] == "prompt"


def test_pipeline_stages_on_odd_tables(spark, sf_dir, clash):
    """Nulls, extra columns and no rows at all."""
    for start in (clash, clash.where("false"), clash.select("doc_id", F.lit(None).cast("string").alias("text"), "lang", F.lit(None).cast("string").alias("source"), "n_chars")):
        docs = start
        for name, f in corpus_pipeline.STAGES[:-1]:
            docs = f(spark, docs, sf_dir)
            assert docs.columns == start.columns, name
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).where("length < 1").isEmpty()
