"""Mixing sources to target weights by entropy balancing.

Each document gets the rate that is closest, in relative entropy over words, to its prior rate while
each source's words meet its target and no rate exceeds the cap. The dual of that convex problem has
one variable per source, and the rates are exponentially tilted: rate = min(cap, prior *
exp(lambda of the source)). Newton steps on the dual are aggregations over all documents; the
variables stay in a DataFrame, one row per source. Rates are rounded to whole copies along the
documents of a source by size, so that rounding errors cancel.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.llm.common import col, text_or_empty
from sparkloom.shipping import checkpoint

CAP = 3.0
WEIGHTS = (1, 2, 3)
TOLERANCE = 1e-9
MAX_STEPS = 60
CELL_ROWS = 2_000
BROADCAST_ROWS = 20_000
LARGE_PARTS = 1000
SIZE_CLASSES_PER_OCTAVE = 4


def word_count(text: Column) -> Column:
    """Number of runs of anything but the six white-space characters; null counts as empty."""
    return F.regexp_count(text_or_empty(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_key(source: Column) -> Column:
    """A text that is never null and orders as the sources do: by code point, null last."""
    return F.when(source.isNull(), F.lit("~")).otherwise(F.concat(F.lit(" "), source.cast("string")))


def joined_small(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Inner join that broadcasts ``right`` if it has at most BROADCAST_ROWS rows and else shuffles both."""
    return left.join(F.broadcast(right) if right.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else right, on)


def source_ranks(sizes: DataFrame) -> DataFrame:
    """``sizes`` with ``place``, the 0-based place of its ``skey``.

    Keys are ranked within ranges of their order and the ranges' counts are added up, so that no task
    needs to hold all sources. Spark compares strings by UTF-8 bytes, which order as code points do.
    """
    ordered = checkpoint(sizes.repartitionByRange("skey").withColumn("range", F.spark_partition_id()))
    counts = ordered.groupBy("range").agg(F.count("*").alias("n"))
    before = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)  # one row a partition
    starts = counts.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = W.partitionBy("range").orderBy("skey")
    return ordered.withColumn("r", F.row_number().over(within)).join(F.broadcast(starts), "range").select(*sizes.columns, (F.col("first") + F.col("r") - 1).alias("place"))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """(skey, source_size) with ``target``: a share by weight of all words, at most ``cap`` times the
    source's size, the excess going to the others by weight until none is above.

    Weights repeat along the sources in their order. Each round finds the share of a unit of weight
    from two sums over the sources.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    rows = checkpoint(source_ranks(sizes).select("skey", "source_size", weight.alias("weight")))
    limit = cap * F.col("source_size")
    total = float(rows.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    unit, capped = 0.0, -1
    while True:
        # a source that is capped at one share stays so at a larger one
        above = F.col("weight") * unit > limit if capped >= 0 else F.lit(False)
        n, fixed, free = rows.agg(F.count_if(above), F.coalesce(F.sum(F.when(above, limit)), F.lit(0.0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0))).first()
        if n == capped:
            break
        capped, unit = n, (total - fixed) / free if free else unit
    return rows.select("skey", "source_size", F.least(F.col("weight") * unit, limit).alias("target"))


def balance(grouped: DataFrame, targets: DataFrame, cap: float = CAP, tolerance: float = TOLERANCE) -> DataFrame:
    """Dual variables: (skey, source_size, target, tilt), such that the words of a source at rates
    min(cap, prior * exp(tilt)) sum to its target.

    ``grouped`` has (skey, prior, words): documents of a source with one prior share their rate.
    Newton steps are damped to one unit and kept inside the bracket in which the solution is known to
    lie. Where priors of 0 keep a target from being met, the largest rates stand.
    """
    # without a cap the words at the prior rates tell how far to tilt; Newton starts from there
    prior_words = grouped.groupBy("skey").agg(F.sum(F.col("words") * F.col("prior")).alias("w"))
    start = F.when(F.col("target") <= 0, F.lit(-40.0)).otherwise(F.coalesce(F.ln(F.try_divide("target", "w")), F.lit(0.0)))
    first = F.greatest(F.lit(-40.0), F.least(F.lit(30.0), start)).alias("tilt")
    state = checkpoint(targets.join(prior_words, "skey", "left").select(*targets.columns, first, F.lit(-700.0).alias("lo"), F.lit(700.0).alias("hi")))
    small = state.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    for _ in range(MAX_STEPS):
        raw = F.col("prior") * F.exp("tilt")
        met = (
            grouped.join(F.broadcast(state.select("skey", "tilt")) if small else state.select("skey", "tilt"), "skey")
            .groupBy("skey")
            .agg(F.sum(F.col("words") * F.least(raw, F.lit(float(cap)))).alias("got"), F.sum(F.when(raw < cap, F.col("words") * raw).otherwise(0.0)).alias("slope"))
        )
        gap = F.col("target") - F.col("got")
        lo = F.when(gap >= 0, F.greatest("lo", "tilt")).otherwise(F.col("lo"))
        hi = F.when(gap <= 0, F.least("hi", "tilt")).otherwise(F.col("hi"))
        newton = F.col("tilt") + F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(gap, "slope"), F.signum(gap))))
        done = (F.abs(gap) <= tolerance * F.greatest(F.lit(1.0), F.col("target"))) | (F.abs("tilt") >= 40)
        step = state.join(met, "skey").select("skey", "source_size", "target", F.col("tilt").alias("was"), lo.alias("lo"), hi.alias("hi"), newton.alias("next"), done.alias("done"))
        moved = F.when(F.col("done"), F.col("was")).otherwise(F.greatest("lo", F.least("hi", "next")))
        step = checkpoint(step.select("skey", "source_size", "target", moved.alias("tilt"), "lo", "hi", "done"))
        state = step.drop("done")
        if step.where(~F.col("done")).isEmpty():
            break
    else:
        warnings.warn(f"targets were not met to {tolerance} after {MAX_STEPS} Newton steps", stacklevel=2)
    return state.select("skey", "source_size", "target", "tilt")


def cell_starts(rated: DataFrame) -> tuple[DataFrame, int]:
    """Sums of the rates before each cell (skey, size_class, bucket) of its source, and the buckets."""
    largest = rated.groupBy("skey", _size_class()).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    buckets = -(-largest // CELL_ROWS) or 1
    sums = rated.groupBy("skey", _size_class(), _bucket(buckets)).agg(F.sum("rate").alias("rates"))
    before = W.partitionBy("skey").orderBy(F.col("size_class").desc(), "bucket").rowsBetween(W.unboundedPreceding, -1)
    return sums.select("skey", "size_class", "bucket", F.coalesce(F.sum("rates").over(before), F.lit(0)).cast("decimal(38,9)").alias("start")), buckets


def _size_class() -> Column:
    return F.floor(F.log2(F.col("size") + 1.0) * SIZE_CLASSES_PER_OCTAVE).cast("int").alias("size_class")


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("doc_id", "size"), F.lit(buckets)).alias("bucket")


def whole_copies(rated: DataFrame, starts: DataFrame, buckets: int) -> DataFrame:
    """``rated`` (skey, size, doc_id, rate, ...) with ``copies``: whole numbers that add up to the rates.

    Along a source's documents, longest first, the copies of the first n are the rounded sum of their
    rates, so the words taken miss the target by about one document. The order is cut into cells
    (source, class of size, hashed bucket) of about CELL_ROWS rows, and a cell starts at the sum of the
    rates before it, so a source that holds a large share of the rows is dealt over many tasks. Sums
    are decimal, hence the same in every run. Rows of equal size and id may swap their copies.
    """
    key = ["skey", "size_class", "bucket"]
    upto = F.sum("rate").over(W.partitionBy(*key).orderBy(F.col("size").desc(), "doc_id").rowsBetween(W.unboundedPreceding, 0))
    half = F.lit("0.5").cast("decimal(2,1)")
    end = (F.col("start") + F.col("upto")).cast("decimal(38,9)")
    copies = F.floor(end + half) - F.floor((end - F.col("rate")).cast("decimal(38,9)") + half)
    cells = rated.select("*", _size_class(), _bucket(buckets)).withColumn("upto", upto.cast("decimal(38,9)"))
    return cells.join(starts, key).withColumn("copies", copies.cast("long"))


def _rated(rows: DataFrame, tilts: DataFrame, cap: float) -> DataFrame:
    """``rows`` with the target, the rate, and whether the document is ``large`` for its source's target."""
    large = F.col("size") * LARGE_PARTS > F.col("target")
    rate = F.least(F.col("prior") * F.exp(F.when(large, F.col("tilt")).otherwise(F.col("tilt_small"))), F.lit(float(cap))).cast("decimal(18,9)")
    joined = joined_small(rows, tilts, "skey").select(*rows.columns, "source_size", "target", large.alias("large"), rate.alias("rate"))
    return joined.withColumn("skey", F.concat("skey", F.when(F.col("large"), F.lit("0")).otherwise(F.lit("1"))))


def _tilts(slim: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """Per source: ``source_size, target, tilt, tilt_small``.

    A document of more than 1/LARGE_PARTS of its source's target may be off by much when its rate is
    rounded. So large ones are rounded first, and small ones are balanced to the words still missing.
    """
    grouped = checkpoint(slim.groupBy("skey", "prior").agg(F.sum("size").cast("double").alias("words"), F.sum("size").alias("n")))
    sizes = grouped.groupBy("skey").agg(F.sum("n").alias("source_size"))
    first = balance(grouped, source_targets(sizes, weights, cap), cap)
    rated = _rated(slim, first.withColumn("tilt_small", F.col("tilt")), cap)
    starts, buckets = cell_starts(rated.where("large"))
    large = whole_copies(rated.where("large"), starts, buckets).groupBy("skey").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"))
    taken = large.select(F.expr("left(skey, length(skey) - 1)").alias("skey"), "taken")
    small = checkpoint(rated.where("not large").groupBy("skey", "prior").agg(F.sum("size").cast("double").alias("words")).withColumn("skey", F.expr("left(skey, length(skey) - 1)")))
    most = small.groupBy("skey").agg((F.sum("words") * cap).alias("most"))
    missing = (
        first.select("skey", "source_size", "target")
        .join(taken, "skey", "left")
        .join(most, "skey")
        .select("skey", "source_size", F.greatest(F.lit(0.0), F.least(F.col("target") - F.coalesce("taken", F.lit(0)), F.col("most"))).alias("target"))
    )
    second = balance(small, missing, cap).select("skey", F.col("tilt").alias("tilt_small"))
    return checkpoint(first.join(second, "skey", "left").withColumn("tilt_small", F.coalesce("tilt_small", "tilt")))


def _mixed(df: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[float, ...], cap: float, prior: Column | None, whole: bool) -> DataFrame:
    prior = F.lit(1.0) if prior is None else F.greatest(F.coalesce(prior.cast("double"), F.lit(0.0)), F.lit(0.0))
    row = [F.struct(*[col(df, c) for c in df.columns]).alias("row")] if whole else []
    source = col(df, source_col).cast("string")
    docs = df.select(
        col(df, id_col).cast("long").alias("doc_id"), source.alias("source"), source_key(source).alias("skey"), word_count(col(df, text_col)).alias("size"), prior.alias("prior"), *row
    )
    slim = checkpoint(docs.drop("row"))
    tilts = _tilts(slim, weights, cap)
    starts, buckets = cell_starts(_rated(slim, tilts, cap))
    return whole_copies(_rated(docs if whole else slim, tilts, cap), starts, buckets)


def mix(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    cap: float = CAP,
    prior: Column | None = None,
) -> DataFrame:
    """One row per row of ``df``: ``doc_id, source, size, source_size, target, rate, copies, taken``.

    ``size`` is the number of words (null text: 0); ``taken`` is size times copies. A null source is a
    source of its own, the last. A source without words has target 0. ``prior`` is the rate that a
    document would have without targets, 1 unless given (null and negative count as 0). Repeated rows
    count each. A table without rows gives none. Copies never exceed ``cap``, rounded up.
    """
    out = _mixed(df, id_col, text_col, source_col, weights, cap, prior, whole=False)
    return out.select("doc_id", "source", "size", "source_size", "target", F.col("rate").cast("double").alias("rate"), "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_rows(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    cap: float = CAP,
    prior: Column | None = None,
) -> DataFrame:
    """The mix itself: each row of ``df``, whole, as often as its copies say; defined as :func:`mix` is."""
    out = _mixed(df, id_col, text_col, source_col, weights, cap, prior, whole=True).where("copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
