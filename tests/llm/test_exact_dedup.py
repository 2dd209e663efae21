import hashlib
import random
import re

import duckdb

from sparkloom.llm import exact_dedup as X
from sparkloom.llm import queries
from sparkloom.llm.common import collapse_ws_bytes


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_bytes_collapse_as_the_contract_says():
    for t in ("", " ", "\t\n", " a  b ", "a b\x1cc", "é\r\n\x0b\x0cü ", "a  b"):
        assert collapse_ws_bytes(t.encode()).decode() == normal(t)


def test_groups_nulls_ties_and_repeated_rows(make_docs):
    rows = [(5, "a  b"), (3, "a\tb"), (9, None), (8, ""), (7, " "), (None, "a b"), (3, "a b"), (2, "x" * 300_000), (1, "x" * 300_000 + "y")]
    got = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in X.dedup_groups(make_docs(*rows)).collect()}
    assert got == {(5, 3, 4, False), (3, 3, 4, True), (None, 3, 4, False), (9, 8, 2, False), (8, 8, 2, True), (7, 7, 1, True), (2, 2, 1, True), (1, 1, 1, True)}
    kept = X.dedup_records(make_docs(*rows)).collect()
    assert sorted(r["doc_id"] for r in kept) == [1, 2, 3, 7, 8]


def test_only_null_ids_and_empty_table(make_docs):
    r = X.dedup_groups(make_docs((None, "a"), (None, "a"))).collect()
    assert [(x["keep_id"], x["group_size"], x["kept"]) for x in r] == [(None, 2, True)] * 2
    assert X.dedup_groups(make_docs((1, "a")).where("false")).count() == 0


def test_spilling_gives_the_same_groups(spark):
    rng = random.Random(1)
    texts = [f"{rng.randrange(400)} " * rng.randrange(1, 40) for _ in range(3000)]
    df = spark.createDataFrame([(i, t, i % 7) for i, t in enumerate(texts)], "doc_id long, text string, keep_id int")
    best = {}
    for i, t in enumerate(texts):
        best.setdefault(normal(t), i)
    small = X.dedup_records(df, table_bytes=2000, with_group=True)
    assert small.columns == ["doc_id", "text", "keep_id", "keep_id_", "group_size", "text_sha256"]
    assert {r["keep_id_"]: r["group_size"] for r in small.collect()} == {i: sum(normal(x) == t for x in texts) for t, i in best.items()}


def test_equal_hashes_are_told_apart_by_content(monkeypatch):
    entries = [[7, f"{i % 5}".encode() * 100, (i,), (False, i), 1] for i in range(50)]
    got = list(X.grace(iter(entries), 300))
    assert sorted(e[2][0] for e in got) == [0, 1, 2, 3, 4] and all(e[4] == 10 for e in got)


def test_query_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = sorted(con.sql(queries.ORACLE_SQL["op1_exact_dedup"]).fetchall())
    got = sorted(tuple(r) for r in queries.op1_exact_dedup(spark, sf_dir).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())
    assert got == want
    one = spark.read.parquet(f"{sf_dir}/documents.parquet").first()
    assert dict((g[0], g[4]) for g in got)[one["doc_id"]] == hashlib.sha256(normal(one["text"]).encode()).hexdigest()
