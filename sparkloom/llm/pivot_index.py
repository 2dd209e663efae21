"""Near-duplicate vectors by a pivot-permutation index.

Each vector is described by the reference points (pivots) nearest to it, in order. An inverted list holds the
vectors that have the same two pivots among their first LISTED; two members of a list are candidates when they
share at least SHARED of their first COMPARED pivots, and every candidate is verified by its exact cosine.

Copies are not expanded into pairs. Within pieces of bounded size, vectors near a common centre become a
ball whose members are all linked, which the angles to the centre prove. Balls enter the lists once, with the
pivots of all their members; of two balls their angles may prove that all members are linked, or none, and only
otherwise do members meet members. Lists of any size are met block by block.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import col
from sparkloom.llm.near_dedup import components, small
from sparkloom.operators.runs import runs
from sparkloom.shipping import checkpoint

#: Reference points, drawn from the SAMPLE vectors with the smallest hashes of their ids.
PIVOTS, SAMPLE = 1024, 8192
#: Pairs of a vector's first LISTED pivots name its lists; members compare their first COMPARED ones.
LISTED, COMPARED, SHARED = 8, 24, 7
PIECE_ROWS = 2048
BLOCK_ROWS = 2048
#: Angles closer to a bound than this decide nothing by themselves.
SLACK = 1e-6


def usable(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(row, vec_id, label, dim, v) of the vectors that can be linked: with a label, no null or non-finite
    component, and not zero. Vectors of different lengths are never linked."""
    rows = df.select(F.monotonically_increasing_id().alias("row"), col(df, id_col).cast("long").alias("vec_id"), col(df, label_col).cast("string").alias("label"), col(df, vector_col).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.withColumn("ok", F.coalesce(F.col("label").isNotNull() & ~bad & F.exists("v", lambda x: x != 0), F.lit(False)))


def unit_rows(column: pa.Array, dim: int) -> np.ndarray:
    """Lists as unit rows, filled up with zeros to ``dim``; scaled first, so no square overflows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().to_numpy()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == dim).all():
        v = flat.reshape(len(sizes), dim)
    else:
        v = np.zeros((len(sizes), dim))
        v[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    v = v / np.abs(v).max(axis=1, initial=1e-300, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def choose_pivots(sample: np.ndarray, count: int, threshold: float) -> np.ndarray:
    """Up to ``count`` of the unit rows, none of them near another; sums of two fill up what is missing."""
    kept: list[np.ndarray] = []
    for at in range(0, len(sample), 512):
        block = sample[at : at + 512]
        far = (block @ np.array(kept).T).max(axis=1) < threshold if kept else np.ones(len(block), bool)
        near = block @ block.T >= threshold
        for i in np.flatnonzero(far):
            if not far[i]:
                continue
            kept.append(block[i])
            far &= ~near[i]
            if len(kept) == count:
                return np.array(kept)
    rng = np.random.default_rng(0)
    own = np.array(kept)
    while len(kept) < count:
        v = rng.normal(size=(1, len(own))) @ own if len(own) > 1 else rng.normal(size=(1, sample.shape[1]))
        norm = np.linalg.norm(v)
        kept += [v[0] / norm] if norm > 0 else [own[0]]
    return np.array(kept)


def _describe(shared) -> callable:
    """(row, label, v) to (row, label, dim, u, near): the unit vector and its nearest pivots in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = shared.value
        some = min(COMPARED, len(pivots))
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                u = unit_rows(part.column(2), pivots.shape[1])
                near = u @ pivots.T
                first = np.argpartition(-near, some - 1, axis=1)[:, :some]
                order = np.lexsort((first, -np.take_along_axis(near, first, 1)), axis=1)
                first = np.take_along_axis(first, order, 1).astype(np.int16)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2).value_lengths(), _lists(u), _lists(first)],
                    names=["row", "label", "dim", "u", "near"],
                )

    return run


def _lists(a: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * a.shape[1]), pa.array(a.reshape(-1)))


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _codes(near: np.ndarray) -> list[int]:
    """The lists of some vectors, by their first pivots: a number for each two."""
    found: set[int] = set()
    for row in np.sort(near[:, :LISTED].astype(np.int64), axis=1).tolist():
        found.update(a * PIVOTS + b for a, b in itertools.combinations(row, 2))
    return sorted(found)


BALL = "ball long, label string, dim int, centre array<double>, angle double, n long, members array<long>, lists array<int>, near array<short>"


def _balls(threshold: float) -> callable:
    """Runs of (label, dim, first, piece, row, u, near) to balls: greedily, the vectors near an unplaced one
    give a centre, and those within half the threshold's angle of it are one ball."""
    most = np.cos(np.arccos(threshold) / 2 - SLACK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for part in runs(batches, ["label", "dim", "first", "piece"]):
            rows, u, near = part.column("row").to_numpy(), _matrix(part.column("u")), _matrix(part.column("near"))
            label, dim = part.column("label")[0].as_py(), part.column("dim")[0].as_py()
            close = u @ u.T >= threshold if len(rows) > 1 else np.ones((1, 1), bool)
            free = np.ones(len(rows), bool)
            for i in range(len(rows)):
                if not free[i]:
                    continue
                who = np.flatnonzero(close[i] & free)
                centre, angle = u[i], 0.0
                if len(who) > 1:
                    mean = u[who].sum(axis=0)
                    mean /= np.linalg.norm(mean)
                    cosines = u[who] @ mean
                    inside = cosines >= most
                    if inside.sum() > 1 and inside[who == i].all():
                        who, centre, angle = who[inside], mean, float(np.arccos(np.clip(cosines[inside].min(), -1, 1)))
                    else:
                        who = np.array([i])
                free[who] = False
                members = rows[who].tolist()
                out.append((min(members), label, dim, centre, angle, len(members), members, _codes(near[who]), np.unique(near[who]).astype(np.int16)))
            if len(out) >= 1000:
                yield _ball_batch(out)
                out = []
        if out:
            yield _ball_batch(out)

    return run


def _ball_batch(out: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.string(), pa.int32(), pa.list_(pa.float64()), pa.float64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int16())]
    names = ["ball", "label", "dim", "centre", "angle", "n", "members", "lists", "near"]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of (label, dim, list, x, y, block, ball, near) to candidates (a, b): members that share enough pivots, of
    one block where x = y, else of two."""
    for part in runs(batches, ["label", "dim", "list", "x", "y"], 2):
        if part.num_rows < 2:
            continue
        balls, block = part.column("ball").to_numpy(), part.column("block").to_numpy()
        near = part.column("near").combine_chunks()
        sizes = near.value_lengths().to_numpy()
        bits = np.zeros((len(balls), PIVOTS), np.float32)
        bits[np.repeat(np.arange(len(balls)), sizes), near.flatten().to_numpy()] = 1
        x, y = part.column("x")[0].as_py(), part.column("y")[0].as_py()
        left, right = (np.flatnonzero(block == x), np.flatnonzero(block == y)) if x != y else (np.arange(len(balls)),) * 2
        for at in range(0, len(left), 512):
            some = left[at : at + 512]
            i, j = np.nonzero(bits[some] @ bits[right].T >= SHARED)
            a, b = balls[some[i]], balls[right[j]]
            keep = a < b if x == y else a != b
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[keep]), pa.array(np.maximum(a, b)[keep])], names=["a", "b"])


def _dealt(entries: DataFrame) -> DataFrame:
    """Entries (label, dim, list, ball, near) with the blocks (x, y) at which they meet others of their list; a list
    of up to BLOCK_ROWS entries is one block."""
    key = ["label", "dim", "list"]
    many = checkpoint(entries.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > BLOCK_ROWS).withColumn("blocks", F.ceil(F.col("n") / BLOCK_ROWS).cast("int")).drop("n"))
    block = F.pmod(F.xxhash64("ball", "list"), F.col("blocks")).cast("int")
    placed = entries.join(small(many), key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", block)
    each = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return each.select(*key, F.least("block", "with").alias("x"), F.greatest("block", "with").alias("y"), "block", "ball", "near")


def _verify(threshold: float) -> callable:
    """(a, b, ca, ra, na, cb, rb, nb) to (a, b, na, nb, all): links of all members, or (all false) of some perhaps;
    pairs without links are left out."""
    wide = float(np.arccos(threshold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cosine = np.einsum("ij,ij->i", _matrix(batch.column(2)), _matrix(batch.column(5)))
            reach = batch.column(3).to_numpy() + batch.column(6).to_numpy()
            angle = np.arccos(np.clip(cosine, -1, 1))
            point = reach == 0
            every = np.where(point, cosine >= threshold, angle + reach <= wide - SLACK)
            some = pa.array(every | (~point & (angle - reach <= wide + SLACK)))
            columns = [batch.column(0), batch.column(1), batch.column(4), batch.column(7), pa.array(every)]
            yield pa.RecordBatch.from_arrays([c.filter(some) for c in columns], names=["a", "b", "na", "nb", "every"])

    return run


def _members_meet(threshold: float) -> callable:
    """Runs of (a, b, side, row, u) to (a, b, row, n): members with links across the two balls, and how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in runs(batches, ["a", "b"]):
            side, rows, u = part.column("side").to_numpy(), part.column("row").to_numpy(), _matrix(part.column("u"))
            links = u[side == 0] @ u[side == 1].T >= threshold
            n = np.concatenate([links.sum(axis=1), links.sum(axis=0)])
            who = np.concatenate([rows[side == 0], rows[side == 1]])[n > 0]
            if len(who):
                a, b = (pa.array(np.full(len(who), part.column(c)[0].as_py())) for c in ("a", "b"))
                yield pa.RecordBatch.from_arrays([a, b, pa.array(who), pa.array(n[n > 0])], names=["a", "b", "row", "n"])

    return run


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93) -> DataFrame:
    """One row per row of ``df``: ``vec_id, n_links, component_id, kept``.

    Rows of equal labels whose cosine reaches ``threshold`` are linked where the index finds them; ``n_links`` counts the
    other rows linked directly, ``component_id`` is the smallest vec_id reachable. A null label or vector, a zero one
    and one with a null or non-finite component link with nothing. Rows that repeat an id are vectors of their own; rows
    without an id are linked, have ids of their component's others, and stay where there are none. No rows give none.
    """
    if not 0 < threshold < 1:
        raise ValueError("threshold must be between 0 and 1")
    rows = checkpoint(usable(df, id_col, vector_col, label_col))
    good = rows.where("ok")
    dim = good.agg(F.max(F.size("v"))).first()[0]
    if dim is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    sample = good.orderBy(F.xxhash64("vec_id", "v"), "row").limit(SAMPLE).select("v").toArrow()
    pivots = df.sparkSession.sparkContext.broadcast(choose_pivots(unit_rows(sample.column("v"), dim), PIVOTS, threshold))
    known = checkpoint(good.select("row", "label", "v").mapInArrow(_describe(pivots), "row long, label string, dim int, u array<double>, near array<short>"))
    placed = known.withColumn("first", F.element_at("near", 1))
    pieces = checkpoint(placed.groupBy("label", "dim", "first").agg(F.ceil(F.count("*") / PIECE_ROWS).cast("int").alias("pieces")))
    placed = placed.join(small(pieces), ["label", "dim", "first"]).withColumn("piece", F.pmod(F.xxhash64("row"), F.col("pieces")).cast("int"))
    key = ["label", "dim", "first", "piece"]
    ordered = placed.select(*key, "row", "u", "near").repartition(*key).sortWithinPartitions(*key, "row")
    balls = checkpoint(ordered.mapInArrow(_balls(threshold), BALL))

    entries = balls.select("label", "dim", F.explode("lists").alias("list"), "ball", "near")
    met = _dealt(entries).repartition("label", "dim", "list", "x", "y").sortWithinPartitions("label", "dim", "list", "x", "y", "ball")
    pairs = checkpoint(met.mapInArrow(_meet, "a long, b long").distinct())
    a = balls.select(F.col("ball").alias("a"), F.col("centre").alias("ca"), F.col("angle").alias("ra"), F.col("n").alias("na"))
    b = balls.select(F.col("ball").alias("b"), F.col("centre").alias("cb"), F.col("angle").alias("rb"), F.col("n").alias("nb"))
    both = pairs.join(a, "a").join(b, "b").select("a", "b", "ca", "ra", "na", "cb", "rb", "nb")
    found = checkpoint(both.mapInArrow(_verify(threshold), "a long, b long, na long, nb long, every boolean"))

    members = checkpoint(balls.select("ball", "n", F.explode("members").alias("row")))
    open_pairs = found.where("not every")
    sides = open_pairs.select(F.explode(F.array(F.struct("a", "b", F.lit(0).alias("side"), F.col("a").alias("ball")), F.struct("a", "b", F.lit(1).alias("side"), F.col("b").alias("ball")))).alias("s")).select("s.*")
    inner = sides.join(members.select("ball", "row"), "ball").join(known.select("row", "u"), "row").select("a", "b", "side", "row", "u")
    across = checkpoint(inner.repartition("a", "b").sortWithinPartitions("a", "b", "side", "row").mapInArrow(_members_meet(threshold), "a long, b long, row long, n long"))

    linked = found.where("every")
    sums = linked.select(F.explode(F.array(F.struct(F.col("a").alias("ball"), F.col("nb").alias("n")), F.struct(F.col("b").alias("ball"), F.col("na").alias("n")))).alias("s")).select("s.*")
    of_balls = checkpoint(sums.groupBy("ball").agg(F.sum("n").alias("other")))
    of_rows = checkpoint(across.groupBy("row").agg(F.sum("n").alias("some")))
    labels = components(linked.select("a", "b").unionByName(across.select("a", "b").distinct()))
    placed = members.join(small(of_balls), "ball", "left").join(small(labels.withColumnRenamed("node", "ball")), "ball", "left").join(small(of_rows), "row", "left")
    links = placed.select("row", F.coalesce("component", "ball").alias("component"), (F.col("n") - 1 + F.coalesce("other", F.lit(0)) + F.coalesce("some", F.lit(0))).alias("n_links"))
    named = checkpoint(links.join(rows.select("row", "vec_id"), "row"))
    least = checkpoint(named.where("n_links > 0").groupBy("component").agg(F.min("vec_id").alias("least")))
    linked_rows = named.join(small(least), "component", "left").select("vec_id", "n_links", F.coalesce("least", "vec_id").alias("component_id"))
    others = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked_rows.unionByName(others).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))
