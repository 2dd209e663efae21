import pytest

import __spark_entry__
import corpus_pipeline
from sparkloom.llm import mixing, near_dedup, quality


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for _, f in corpus_pipeline.STAGES:
        out.append(f(spark, out[-1], sf_dir).cache())
    return out


def test_stages_keep_columns_and_rows_take_effect(spark, sf_dir, stages):
    docs, good, exact, near, mix, packed = stages
    assert all(s.schema == docs.schema for s in (good, exact, near, mix))
    rows = {r["doc_id"]: r for r in docs.collect()}
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    kept = {r["doc_id"] for r in quality.classify(docs, labels).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in good.collect()} == kept
    texts = {}
    for i in sorted(kept):
        texts.setdefault(" ".join(rows[i]["text"].split()), i)
    assert {r["doc_id"] for r in exact.collect()} == set(texts.values())
    groups = {r["doc_id"]: r["group_id"] for r in near_dedup.near_duplicates(exact).collect()}
    assert {r["doc_id"] for r in near.collect()} == set(groups.values())
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(near).collect()}
    taken = {}
    for r in mix.collect():
        assert r == rows[r["doc_id"]]
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + 1
    assert taken == {i: n for i, n in copies.items() if n}
    assert {r["doc_id"] for r in packed.collect()} == set(taken)
    assert sum(r["piece"] == 0 for r in packed.collect()) == sum(taken.values())


def test_run_equals_the_stages(spark, sf_dir, stages):
    assert corpus_pipeline.run(spark, sf_dir).groupBy("doc_id", "piece", "length", "ids_crc32").count().exceptAll(stages[-1].groupBy("doc_id", "piece", "length", "ids_crc32").count()).count() == 0


def test_entry_registers_all():
    found = __spark_entry__.queries()
    assert "pipeline" in found and sorted(int(n[2:].split("_")[0]) for n in found if n.startswith("op") and n[2].isdigit()) == list(range(1, 14))
    assert set(__spark_entry__.oracle_sql()) <= set(found)
