"""Every registered query of the library against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from sparkloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])

    def cell(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
        return repr(float(v)) if type(v).__name__ == "Decimal" else str(v)

    return sorted([cell(r[k]) for k in order] for r in data)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, db, sf_dir, name):
    got = registry.QUERIES[name](spark, sf_dir)
    want = db.sql(registry.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_without_sql_gives_rows(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0


def test_recall_sweep_reaches_its_gate(spark, sf_dir):
    r = {x["ef"]: x["mean_recall"] for x in registry.QUERIES["ann_recall_sweep"](spark, sf_dir).collect()}
    assert r[64] >= 0.9
