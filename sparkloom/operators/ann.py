"""Levels and cells of approximate search; the graphs themselves are in :mod:`graph_index`."""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.draws import digest_number

SAMPLE = 20_000


def levels(ids: DataFrame, m: int = 16, seed: int = 0) -> DataFrame:
    """(vec_id, level): floor(-ln u / ln m) with u in (0, 1] from a digest of the id."""
    if m < 2:
        raise ValueError("m must be at least 2")
    u = (digest_number(F.col("vec_id"), str(seed)) + 1) / float(1 << 32)
    return ids.select("vec_id", F.floor(-F.ln(u) / math.log(m)).cast("int").alias("level"))


def centres(corpus: DataFrame, n_cells: int, sample: int = SAMPLE, seed: int = 0) -> np.ndarray:
    """Cell centres, fitted on the ``sample`` vectors with the smallest hashed ids."""
    if n_cells < 2:
        return np.zeros((1, corpus.select(F.size("v")).first()[0]))
    some = corpus.orderBy(F.xxhash64("vec_id")).limit(sample).select(array_to_vector("v").alias("features"))
    return np.array(KMeans(k=n_cells, seed=seed, maxIter=10, initMode="random").fit(some).clusterCenters())
