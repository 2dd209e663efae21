import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import vectors as V
from sparkloom.operators import ann, knn

SCHEMA = "vec_id long, v array<double>"


def corpus(spark, rows):
    return spark.createDataFrame(list(enumerate([list(map(float, r)) for r in rows])), SCHEMA)


def found(df):
    return [(r["qid"], r["vec_id"], r["dist"]) for r in df.orderBy("qid", "rank").collect()]


def test_known_angles_and_clamped_k(spark):
    angles = [math.radians(a) for a in (0, 10, 25, 60, 90)]
    c = corpus(spark, [(math.cos(a), math.sin(a)) for a in angles])
    q = spark.createDataFrame([(7, [1.0, 0.0])], "qid long, v array<double>")
    got = found(knn.knn(q, c, 99))
    assert [x[1] for x in got] == [0, 1, 2, 3, 4]
    assert np.allclose([x[2] for x in got], [1 - math.cos(a) for a in angles], atol=1e-9)


def test_ties_go_by_id_and_zero_vector_has_distance_one(spark):
    c = corpus(spark, [(1, 0), (0, 1), (-1, 0), (0, -1), (0, 0)])
    q = spark.createDataFrame([(0, [1.0, 0.0])], "qid long, v array<double>")
    assert found(knn.knn(q, c, 4)) == [(0, 0, 0.0), (0, 1, 1.0), (0, 3, 1.0), (0, 4, 1.0)]


def test_euclidean_matches_naive_loop_over_many_blocks(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(60, 8))
    c = corpus(spark, m.tolist())
    q = spark.createDataFrame([(i, m[i].tolist()) for i in range(0, 60, 7)], "qid long, v array<double>")
    got = found(knn.knn(q, c, 5, "euclidean", block=2))
    want = []
    for i in range(0, 60, 7):
        d = np.round(np.linalg.norm(m - m[i], axis=1), 9)
        want += [(i, int(j), d[j]) for j in sorted(range(60), key=lambda j: (d[j], j))[:5]]
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert np.allclose([x[2] for x in got], [x[2] for x in want], atol=1e-8)


def test_errors_empty_and_null_vectors(spark):
    c = corpus(spark, [(1, 0)])
    q = spark.createDataFrame([(0, [1.0, 0.0]), (1, None)], "qid long, v array<double>")
    with pytest.raises(ValueError):
        knn.knn(q, c, 1, "manhattan")
    with pytest.raises(ValueError):
        knn.knn(q, c, 0)
    assert knn.knn(q, c.where("false"), 3).count() == 0
    assert knn.knn(q.where("false"), c, 3).count() == 0
    assert knn.knn(q, c.unionByName(spark.createDataFrame([(5, None)], SCHEMA)), 3).count() == 1


def test_scalar_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, b array<double>")
    r = df.select(V.norm(F.col("a")), V.unit(F.col("a")), V.cosine_distance(F.col("a"), F.col("b")), V.euclidean_distance(F.col("a"), F.col("b"))).first()
    assert r[0] == 5 and r[1] == [0.6, 0.8] and r[2] == 1.0 and r[3] == 5.0
    with pytest.raises(ValueError):
        V.distance("x", F.col("a"), F.col("b"))


def test_append_continues_ids(spark):
    c = corpus(spark, [(1, 0), (0, 1)])
    assert sorted(r["vec_id"] for r in knn.append(c, c).collect()) == [0, 1, 2, 3]


def test_levels_fall_by_m(spark):
    ids = spark.range(20000).select(F.col("id").alias("vec_id"))
    n = {r["level"]: r["n"] for r in ann.levels(ids, 8).groupBy("level").agg(F.count("*").alias("n")).collect()}
    assert abs(n[0] / 20000 - 7 / 8) < 0.02 and n[1] > n[2]
    with pytest.raises(ValueError):
        ann.levels(ids, 1)
