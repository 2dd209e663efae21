"""Quality classifier: a factorisation machine.

Features of a text are hashed words (whole text, distinct words), statistics of its structure, and
metadata derived from the text (its length and line count, in steps). The score of a document is
linear in its features: the pairwise interactions follow from the sum-of-squares identity
sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2).
The model is fitted on the driver on a bounded sample of labelled rows (``max_labelled``), scoring is
done in numpy per Arrow batch.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.caching import WordCache, kept_by_worker
from sparkloom.llm.common import col, id_fold

BUCKETS = 1 << 15
MAX_LABELLED = 4000
STATISTICS = 16
_LETTERS = re.compile(rb"[A-Za-z\x80-\xff]")


def _bucket(word: bytes) -> int:
    return zlib.crc32(word.lower()) % BUCKETS


def featurizer() -> Featurizer:
    """One per worker process."""
    return kept_by_worker("quality features", Featurizer)


@dataclass
class Model:
    """Weights of a factorisation machine; statistics come before hashed words."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray


class Featurizer:
    """Distinct hashed words with damped counts, and STATISTICS numbers."""

    def __init__(self) -> None:
        self.known = WordCache()

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        raw = text.encode("utf-8", "replace")
        words = Counter(raw.split())
        n = sum(words.values())
        at = self.known.values(words, _bucket)
        weight = np.log1p(np.fromiter(words.values(), np.float64, len(words)))
        index = np.array(at, np.int64) + STATISTICS
        if len(index):
            weight /= math.sqrt(float(weight @ weight))
        return index, weight, self._statistics(raw, words, n)

    @staticmethod
    def _statistics(raw: bytes, words: Counter, n: int) -> np.ndarray:
        size, count = max(1, len(raw)), max(1, n)
        lines = raw.split(b"\n")
        distinct_lines = len(set(lines))
        marks = len(raw) - len(raw.translate(None, b"!\"#$%&'()*+-/:;<=>?@[\\]^_`{|}~"))
        digits = len(raw) - len(raw.translate(None, b"0123456789"))
        upper = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        stops = raw.count(b".") + raw.count(b"?")
        longest = max(map(len, words), default=0)
        top = max(words.values(), default=0)
        return np.array(
            [
                math.log1p(n),
                math.log1p(len(raw)),
                math.log1p(len(lines)),
                (size - raw.count(b" ") - len(lines)) / count,
                len(words) / count,
                top / count,
                distinct_lines / len(lines),
                marks / size,
                digits / size,
                upper / size,
                stops / count,
                raw.count(b",") / count,
                raw.count(b"!") / count,
                math.log1p(longest),
                raw.count(b"|") / count,
                sum(c for w, c in words.items() if w.isupper() and len(w) > 2) / count,
            ]
        )


def _raw_scores(model: Model, rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """Linear time in the number of features that are not zero."""
    index, value, owner = _flat(rows, model.mean, model.scale)
    sums = model.factors[index] * value[:, None]
    n, k = len(rows), model.factors.shape[1]
    total = np.stack([np.bincount(owner, sums[:, f], n) for f in range(k)], axis=1)
    squares = np.bincount(owner, np.einsum("ij,ij->i", sums, sums), n)
    return model.bias + np.bincount(owner, model.linear[index] * value, n) + 0.5 * ((total * total).sum(1) - squares)


def _flat(rows, mean: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    statistics = np.arange(STATISTICS)
    index = np.concatenate([np.concatenate((statistics, r[0])) for r in rows])
    value = np.concatenate([np.concatenate((np.clip((r[2] - mean) / scale, -4, 4) / math.sqrt(STATISTICS), r[1])) for r in rows])
    owner = np.repeat(np.arange(len(rows)), [STATISTICS + len(r[0]) for r in rows])
    return index, value, owner


def fit(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], labels: np.ndarray, rank: int = 8, epochs: int = 15, rate: float = 0.05, decay: float = 2e-5, seed: int = 3) -> Model:
    """Logistic loss by Adam over mini-batches; classes weigh equally in the loss, then the bias is set
    so that the mean score equals the share of label 1. Without both labels, the score is the smoothed share."""
    rng = np.random.default_rng(seed)
    stats = np.array([r[2] for r in rows]) if rows else np.zeros((1, STATISTICS))
    mean, scale = stats.mean(0), np.maximum(stats.std(0), 1e-6)
    size = STATISTICS + BUCKETS
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    model = Model(float(np.log(share / (1 - share))), np.zeros(size), np.zeros((size, rank)), mean, scale)
    if not rows or labels.min() == labels.max():
        return model
    model.factors = rng.normal(0, 0.05, (size, rank))
    p = [np.zeros(1), model.linear, model.factors]
    moments = [(np.zeros_like(x), np.zeros_like(x)) for x in p]
    weight = np.where(labels == 1, 0.5 / max(share, 1e-3), 0.5 / max(1 - share, 1e-3))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for start in range(0, len(order), 256):
            part = order[start : start + 256]
            batch = [rows[i] for i in part]
            model.bias = float(p[0][0])
            index, value, owner = _flat(batch, mean, scale)
            sums = model.factors[index] * value[:, None]
            total = np.stack([np.bincount(owner, sums[:, f], len(batch)) for f in range(rank)], axis=1)
            raw = model.bias + np.bincount(owner, model.linear[index] * value, len(batch)) + 0.5 * ((total * total).sum(1) - np.bincount(owner, np.einsum("ij,ij->i", sums, sums), len(batch)))
            error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[part]) * weight[part] / len(part)
            used, place = np.unique(index, return_inverse=True)
            e = error[owner]
            g_linear = np.bincount(place, e * value)
            inner = (e * value)[:, None] * (total[owner] - sums)
            g_factors = np.stack([np.bincount(place, inner[:, f]) for f in range(rank)], axis=1)
            step += 1
            for x, (m, v), at, g in ((p[0], moments[0], slice(None), np.array([error.sum()])), (p[1], moments[1], used, g_linear), (p[2], moments[2], used, g_factors)):
                g = g + decay * x[at]
                m[at] = 0.9 * m[at] + 0.1 * g
                v[at] = 0.99 * v[at] + 0.01 * g * g
                x[at] -= rate * 0.5 * (1 + math.cos(math.pi * min(1.0, step / (epochs * -(-len(rows) // 256))))) * (m[at] / (1 - 0.9**step)) / (np.sqrt(v[at] / (1 - 0.99**step)) + 1e-8)
    model.bias = float(p[0][0])
    raw = _raw_scores(model, rows) - model.bias
    lo, hi = -30.0, 30.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (1 / (1 + np.exp(-np.clip(raw + mid, -60, 60)))).mean() < labels.mean() else (lo, mid)
    model.bias = (lo + hi) / 2
    return model


def labelled_rows(docs: DataFrame, labels: DataFrame, max_labelled: int, folds: int, held_fold: int) -> DataFrame:
    """(doc_id, text, y) of at most ``max_labelled`` labelled documents outside the held-out fold, those
    whose hashed id is smallest. Labels of a repeated id are averaged (half: 1), and of its rows the one whose
    text has the smallest hash counts; null labels do not. The chosen ids, bounded by the parameter,
    are broadcast."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("q")).where(
        F.col("doc_id").isNotNull() & F.col("q").isNotNull() & (id_fold(F.col("doc_id"), folds) != held_fold)
    )
    one = usable.groupBy("doc_id").agg((F.avg("q") >= 0.5).cast("int").alias("y"))
    chosen = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    text = F.coalesce("text", F.lit(""))
    found = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64(text).alias("h"), text.alias("text"))).alias("t"))
    return found.select("doc_id", "t.text", "y")


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, folds: int = 3, held_fold: int = 1) -> Model:
    """Features are computed by the executors; the driver gets those of ``max_labelled`` rows at most."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = featurizer()
        for batch in batches:
            if batch.num_rows:
                rows = [f(t or "") for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        batch.column(2),
                        *(pa.array([r[k].astype(t).tobytes() for r in rows], pa.binary()) for k, t in ((0, "<u4"), (1, "<f4"), (2, "<f8"))),
                    ],
                    names=["doc_id", "y", "i", "w", "s"],
                )

    found = labelled_rows(docs, labels, max_labelled, folds, held_fold).mapInArrow(features, "doc_id long, y int, i binary, w binary, s binary").collect()
    found.sort(key=lambda r: (r["doc_id"], bytes(r["i"])))
    rows = [(np.frombuffer(r["i"], "<u4").astype(np.int64), np.frombuffer(r["w"], "<f4").astype(float), np.frombuffer(r["s"], "<f8")) for r in found]
    return fit(rows, np.array([r["y"] for r in found], float))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, text) to (doc_id, score); a null text counts as empty."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Model(model.bias, model.linear.astype(np.float32), model.factors.astype(np.float32), model.mean, model.scale))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, f = shared.value, featurizer()
        for batch in batches:
            for part in range(0, batch.num_rows, 250):
                rows = [f(t or "") for t in batch.column(1).slice(part, 250).to_pylist()]
                scores = 1 / (1 + np.exp(-np.clip(_raw_scores(m, rows), -500, 500)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part, 250), pa.array(scores)], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def classify(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED, folds: int = 3, held_fold: int = 1) -> DataFrame:
    """One row per row of ``df``: ``doc_id, held_out, score, predicted``.

    ``labels`` has doc_id and quality (1 good). Ids choose the fold and match labels; neither they nor
    labels, language or source are features. A null id is not held out and has no label. Null and
    empty texts get the score of an empty text. Repeated rows are scored each.
    """
    docs = df.select(col(df, id_col).cast("long").alias("doc_id"), col(df, text_col).cast("string").alias("text"))
    scored = score(docs, train(docs, labels, max_labelled, folds, held_fold))
    return scored.select("doc_id", (id_fold(F.col("doc_id"), folds) == held_fold).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(df: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float = 0.5, **parameters) -> DataFrame:
    """The rows of ``df`` whose score is at least ``threshold``, with its columns; rows are scored where
    they lie, without a shuffle."""
    docs = df.select(col(df, id_col).cast("long").alias("doc_id"), col(df, text_col).cast("string").alias("text"))
    shared = df.sparkSession.sparkContext.broadcast(train(docs, labels, **parameters))
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, f = shared.value, featurizer()
        for batch in batches:
            for part in range(0, batch.num_rows, 250):
                some = batch.slice(part, 250)
                raw = _raw_scores(m, [f(t or "") for t in some.column(at).to_pylist()])
                yield some.filter(pa.array(1 / (1 + np.exp(-np.clip(raw, -500, 500))) >= threshold))

    return df.mapInArrow(run, df.schema)
