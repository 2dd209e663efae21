"""Queries over embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.vectors import norm, unit
from sparkloom.operators import ann, graph_index, knn
from sparkloom.sources.catalog import vectors

K = 10


def _queries(corpus: DataFrame) -> DataFrame:
    return corpus.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), "v")


def _rounded(found: DataFrame) -> DataFrame:
    return found.select("qid", F.col("rank").cast("int").alias("rank"), "vec_id", F.round("dist", 6).alias("dist"))


def knn_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = vectors(spark, sf_dir)
    return _rounded(knn.knn(_queries(c), c, K, "cosine"))


def knn_euclidean_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = vectors(spark, sf_dir)
    return _rounded(knn.knn(_queries(c), c, K, "euclidean"))


def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("vec_id", F.round(norm(F.col("v")), 6).alias("norm"))


def vector_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("vec_id", F.posexplode(unit(F.col("v"))).alias("pos", "x")).select("vec_id", "pos", F.round("x", 6).alias("x"))


def knn_append_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = vectors(spark, sf_dir)
    return knn.append(c, c.where("vec_id % 50 = 0")).select("vec_id", F.size("v").alias("dim"), F.round(F.element_at("v", 1), 6).alias("x0"))


def knn_self_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of the cosine neighbours among the euclidean ones, which agree on unit vectors."""
    c = vectors(spark, sf_dir)
    q = _queries(c)
    got = knn.recall(knn.knn(q, c, K, "cosine"), knn.knn(q, c, K, "euclidean"), K)
    return got.select("qid", F.round("recall", 6).alias("recall"))


def ann_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.levels(vectors(spark, sf_dir)).groupBy("level").agg(F.count("*").alias("n"))


def ann_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = graph_index.build(vectors(spark, sf_dir)).edges()
    return edges.where("layer = 0").select("src", "dst", F.round("dist", 6).alias("dist"))


def ann_beam_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = vectors(spark, sf_dir)
    return _rounded(graph_index.search(graph_index.build(c), _queries(c), K, ef=64))


def ann_recall_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = vectors(spark, sf_dir)
    return graph_index.recall_sweep(graph_index.build(c), _queries(c), c, K, (16, 64))


def ann_insert_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of nine tenths, the rest inserted, and beams wide enough to reach every node: the neighbours are
    exact if the stored and the inserted links leave no node out of reach."""
    c = vectors(spark, sf_dir)
    index = graph_index.insert(graph_index.build(c.where("vec_id % 10 <> 3")), c.where("vec_id % 10 = 3"))
    return _rounded(graph_index.search(index, _queries(c), K, ef=2 * graph_index.PIECE_ROWS))


def ann_flat_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over one layer without caps, entered at hashed nodes."""
    c = vectors(spark, sf_dir)
    index = graph_index.build(c.where("vec_id % 10 <> 3"), graph_index.Settings(m=8, kind="flat"))
    return _rounded(graph_index.search(graph_index.insert(index, c.where("vec_id % 10 = 3")), _queries(c), K, ef=2 * graph_index.PIECE_ROWS))


QUERIES = {
    f.__name__: f
    for f in (knn_cosine_topk, knn_euclidean_topk, vector_norms, vector_unit, knn_append_ids, knn_self_recall, ann_levels, ann_graph_edges, ann_beam_search, ann_recall_sweep, ann_insert_search, ann_flat_search)
}

_TOPK = """
    WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
    d AS (SELECT q.vec_id AS qid, c.vec_id, round({distance}, 9) AS dist FROM v q, v c WHERE q.vec_id % 50 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, vec_id) AS rank FROM d)
    SELECT qid, rank::INT AS rank, vec_id, round(dist, 6) AS dist FROM r WHERE rank <= 10"""
_COSINE = "CASE WHEN list_inner_product(q.v, q.v) = 0 OR list_inner_product(c.v, c.v) = 0 THEN 1.0 ELSE list_cosine_distance(q.v, c.v) END"

ORACLE_SQL = {
    "ann_levels": """
        WITH u AS (SELECT (('0x' || substr(md5('0:' || vec_id), 1, 8))::BIGINT + 1) / 4294967296.0::DOUBLE AS u FROM embeddings)
        SELECT floor(-ln(u) / ln(16.0::DOUBLE))::INT AS level, count(*) AS n FROM u GROUP BY 1""",
    "knn_cosine_topk": _TOPK.format(distance=_COSINE),
    "ann_insert_search": _TOPK.format(distance=_COSINE),
    "ann_flat_search": _TOPK.format(distance=_COSINE),
    "knn_euclidean_topk": _TOPK.format(distance="list_distance(q.v, c.v)"),
    "vector_norms": "SELECT vec_id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings",
    "vector_unit": """
        WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
        n AS (SELECT vec_id, v, greatest(sqrt(list_inner_product(v, v)), 1e-12) AS n FROM v)
        SELECT vec_id, (i - 1)::INT AS pos, round(v[i] / n, 6) AS x FROM n, unnest(range(1, len(v) + 1)) AS t(i)""",
    "knn_append_ids": """
        WITH m AS (SELECT max(vec_id) AS m FROM embeddings),
        a AS (SELECT vec_id, embedding AS v FROM embeddings UNION ALL SELECT vec_id + m + 1, embedding FROM embeddings, m WHERE vec_id % 50 = 0)
        SELECT vec_id, len(v)::INT AS dim, round(v[1]::DOUBLE, 6) AS x0 FROM a""",
    "knn_self_recall": f"""
        WITH a AS ({_TOPK.format(distance=_COSINE)}), b AS ({_TOPK.format(distance='list_distance(q.v, c.v)')})
        SELECT a.qid, round(count(b.vec_id) / 10.0, 6)::DOUBLE AS recall
        FROM a LEFT JOIN b ON a.qid = b.qid AND a.vec_id = b.vec_id GROUP BY a.qid""",
}
