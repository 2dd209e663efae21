"""Exact nearest neighbours: a stated query set against all vectors, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.functions.vectors import METRICS, NORM_FLOOR
from sparkloom.shipping import checkpoint

#: Queries of one pass; they are broadcast, and further ones take further passes.
QUERY_BLOCK = 4096
#: Distances are compared to this many digits, so ties go by id and not by rounding errors.
DIGITS = 9


def matrix(column: pa.Array) -> np.ndarray:
    """The lists of a column, all of one length, as rows; a view of Arrow's values where they are doubles."""
    if not len(column):
        return np.empty((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), -1)


def distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """All distances of the rows of ``a`` to those of ``b``."""
    if metric == "cosine":
        a = a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), NORM_FLOOR)
        b = b / np.maximum(np.linalg.norm(b, axis=1, keepdims=True), NORM_FLOOR)
        return np.round(1 - np.clip(a @ b.T, -1.0, 1.0), DIGITS)
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    close = square < 1e-6 * np.maximum((a * a).sum(1)[:, None], 1e-300)
    out = np.sqrt(np.maximum(square, 0.0))
    for i, j in zip(*np.nonzero(close), strict=True):  # cancellation: these few directly
        out[i, j] = np.linalg.norm(a[i] - b[j])
    return np.round(out, DIGITS)


def knn(queries: DataFrame, corpus: DataFrame, k: int, metric: str = "cosine", block: int = QUERY_BLOCK) -> DataFrame:
    """(qid, rank, vec_id, dist): for each query (qid, v) the k nearest of ``corpus`` (vec_id, v), ties by id.

    Queries are dealt to passes of about ``block`` by their hash; a pass broadcasts its queries, each task
    multiplies its vectors by them and keeps k a query, and a window picks the k nearest of those. Null
    vectors are skipped; k beyond the corpus gives all.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; known: {', '.join(sorted(METRICS))}")
    if k < 1:
        raise ValueError("k must be at least 1")
    queries = queries.where("qid is not null and v is not null").select(F.col("qid").cast("long").alias("qid"), "v")
    n = queries.count()
    passes = max(1, -(-n // block))
    out = None
    for p in range(passes):
        part = queries if passes == 1 else queries.where(F.pmod(F.xxhash64("qid"), F.lit(passes)) == p)
        block = part.select("qid", "v").toArrow()
        qids, v = block.column("qid").to_numpy(), matrix(block.column("v").combine_chunks())
        shared = corpus.sparkSession.sparkContext.broadcast((qids, v))
        near = _nearest(corpus, shared, k, metric)
        if passes > 1:  # a pass is over, and its queries are gone, before the next begins
            near = checkpoint(near)
            shared.destroy()
        out = near if out is None else out.unionByName(near)
    w = W.partitionBy("qid").orderBy("dist", "vec_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("qid", "rank", "vec_id", "dist")


class Best:
    """The k nearest of the vectors seen so far, of each query. Products of whole blocks tell which vectors
    may be among them; only those get their exact distance."""

    def __init__(self, q: np.ndarray, k: int, metric: str) -> None:
        self.q, self.k, self.cosine = q, k, metric == "cosine"
        self.norm = np.maximum(np.linalg.norm(q, axis=1), NORM_FLOOR)
        self.square = (q * q).sum(1)
        self.unit = q / self.norm[:, None]
        self.bound = np.full(len(q), np.inf)
        self.who, self.ids, self.dist = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)

    def add(self, ids: np.ndarray, v: np.ndarray, rows: np.ndarray | None = None) -> None:
        """Vectors for all queries, or for those of ``rows``."""
        mine = slice(None) if rows is None else rows
        square, own = np.einsum("ij,ij->i", v, v), self.square[mine]
        if self.cosine:
            near = 1 - self.unit[mine] @ (v / np.maximum(np.sqrt(square), NORM_FLOOR)[:, None]).T
            slack = 1e-8
        else:
            near = own[:, None] + square[None, :] - 2 * (self.q[mine] @ v.T)
            slack = 1e-8 * (1 + own[:, None] + square[None, :])
        limit = self.bound[mine] if self.cosine else self.bound[mine] * self.bound[mine]
        if near.shape[1] > 4 * self.k and np.isinf(limit).any():
            limit = np.minimum(limit, np.partition(near, self.k - 1, axis=1)[:, self.k - 1])
        i, j = np.nonzero(near <= limit[:, None] + slack)
        if not len(i):
            return
        who = i if rows is None else rows[i]
        if self.cosine:
            dist = np.clip(near[i, j], 0.0, 2.0)
        else:
            dist = np.concatenate([np.linalg.norm(self.q[who[at : at + 65536]] - v[j[at : at + 65536]], axis=1) for at in range(0, len(i), 65536)])
        self.merge(who, ids[j], np.round(dist, DIGITS))

    def merge(self, who: np.ndarray, ids: np.ndarray, dist: np.ndarray) -> None:
        """Vectors ``ids`` at known distances of the queries ``who``."""
        who, all_ids, dist = np.concatenate((self.who, who)), np.concatenate((self.ids, ids)), np.concatenate((self.dist, dist))
        order = np.lexsort((all_ids, dist, who))
        place = np.arange(len(order)) - np.searchsorted(who[order], who[order])
        order = order[place < self.k]
        self.who, self.ids, self.dist = who[order], all_ids[order], dist[order]
        n = np.bincount(self.who, minlength=len(self.q))
        full = np.flatnonzero(n == self.k)
        self.bound[full] = self.dist[np.cumsum(n)[full] - 1]


def _nearest(corpus: DataFrame, shared, k: int, metric: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, q = shared.value
        best = Best(q, k, metric)
        for batch in batches:
            for at in range(0, batch.num_rows if len(qid) else 0, 2048):
                best.add(batch.column(0).slice(at, 2048).to_numpy(), matrix(batch.column(1).slice(at, 2048)))
        if best.who.size:
            yield pa.RecordBatch.from_arrays([pa.array(qid[best.who]), pa.array(best.ids), pa.array(best.dist)], names=["qid", "vec_id", "dist"])

    return corpus.where("v is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "v").mapInArrow(run, "qid long, vec_id long, dist double")


def recall(truth: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """(qid, recall): the share of the k true neighbours that were found."""
    hits = truth.select("qid", "vec_id").join(found.select("qid", "vec_id").withColumn("hit", F.lit(1)), ["qid", "vec_id"], "left")
    return hits.groupBy("qid").agg((F.coalesce(F.sum("hit"), F.lit(0)) / k).alias("recall"))


def append(corpus: DataFrame, more: DataFrame) -> DataFrame:
    """``corpus`` and the rows of ``more`` with ids that continue after the largest."""
    last = corpus.agg(F.coalesce(F.max("vec_id"), F.lit(-1)).alias("last"))
    shifted = more.join(F.broadcast(last)).select((F.col("vec_id") + F.col("last") + 1).alias("vec_id"), "v")  # one row
    return corpus.select("vec_id", "v").unionByName(shifted)
