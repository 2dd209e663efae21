"""Running sums and ranks over large groups, without holding a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.shipping import checkpoint

#: Rows of a group that one window may hold; larger groups are cut at approximate quantiles.
RANGE_ROWS = 500_000
#: Numbers, of ranges of all groups, that are broadcast.
MOST_CUTS = 100_000


def few(side: DataFrame, most: int = MOST_CUTS) -> DataFrame:
    """``side``, to be broadcast if it has at most ``most`` rows."""
    return F.broadcast(side) if side.limit(most + 1).count() <= most else side


def running_sums(df: DataFrame, keys: list[str], order: str, values: list[str], range_rows: int = RANGE_ROWS) -> DataFrame:
    """``df`` with ``<value>_upto`` for each value: its sum over the rows of the group with ``order`` up to
    and including the row's. ``order`` must be numeric and distinct within a group.

    Groups are cut into ranges at approximate quantiles of ``order`` (where the cuts lie affects only the
    balance); sums of ranges are added up first, then windows run within ranges. The largest group's
    row count reaches the driver, nothing else.
    """
    group = [F.col(k) for k in keys]
    sizes = df.groupBy(*group).agg(F.count("*").alias("n")) if keys else df.agg(F.count("*").alias("n"))
    found = sizes.agg(F.max("n").alias("largest"), F.count("*").alias("groups")).first()
    ranges = max(1, -(-(found["largest"] or 0) // range_rows))
    if ranges == 1 and keys:
        w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
        return df.select("*", *[F.sum(v).over(w).alias(f"{v}_upto") for v in values])
    shares = [k / ranges for k in range(1, ranges)] or [0.5]
    cuts = checkpoint(df.groupBy(*group).agg(F.percentile_approx(order, shares, 10_000).alias("cuts_")))

    def small(side: DataFrame) -> DataFrame:
        """Shuffled by the keys, a group would be whole in one task; so cuts and sums of ranges go to the rows."""
        return F.broadcast(side) if ranges * found["groups"] <= MOST_CUTS else side

    # one row a group, an array of as many numbers as ranges
    placed = (df.join(small(cuts), keys) if keys else df.crossJoin(F.broadcast(cuts))).withColumn("range_", F.size(F.filter("cuts_", lambda c: c < F.col(order)))).drop("cuts_")
    before = W.partitionBy(*keys).orderBy("range_").rowsBetween(W.unboundedPreceding, -1)
    totals = placed.groupBy(*group, "range_").agg(*[F.sum(v).alias(f"{v}_t") for v in values])
    starts = totals.select(*keys, "range_", *[F.coalesce(F.sum(f"{v}_t").over(before), F.lit(0)).alias(f"{v}_s") for v in values])
    within = W.partitionBy(*keys, "range_").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    summed = placed.select("*", *[F.sum(v).over(within).alias(f"{v}_w") for v in values])
    return summed.join(small(starts), [*keys, "range_"]).select(*df.columns, *[(F.col(f"{v}_s") + F.col(f"{v}_w")).alias(f"{v}_upto") for v in values])


def quantiles(df: DataFrame, key: str, x: str, shares: list[float]) -> DataFrame:
    """(key, share, value): exact quantiles with linear interpolation, at positions share * (n - 1).

    Equal values are counted first, so a row is a distinct value; the two values around each position are
    found by their running counts.
    """
    return counted_quantiles(checkpoint(df.groupBy(key, x).agg(F.count("*").alias("n"))), key, x, shares)


def counted_quantiles(counted: DataFrame, key: str, x: str, shares: list[float]) -> DataFrame:
    """:func:`quantiles` from (key, x, n), how often each value occurs, which is read several times."""
    upto = running_sums(counted, [key], x, ["n"])
    total = checkpoint(counted.groupBy(key).agg(F.sum("n").alias("total")))
    placed = upto.join(few(total), key)
    first = F.col("n_upto") - F.col("n")

    def holds(position):
        return (first <= position) & (position < F.col("n_upto"))

    # of the shares, only those whose place lies at this value make rows
    wanted = F.filter(F.array(*[F.lit(float(s)) for s in shares]), lambda s: holds(F.floor(s * (F.col("total") - 1))) | holds(F.ceil(s * (F.col("total") - 1))))
    near = placed.withColumn("share", F.explode(wanted)).withColumn("at", F.col("share") * (F.col("total") - 1)).withColumn("lo", F.floor("at"))
    # the position, counted by whole places, decides between two neighbours
    return near.groupBy(key, "share").agg(
        (F.min(x) + (F.max(x) - F.min(x)) * (F.min("at") - F.min("lo"))).alias("value")
    )


def _ranges(df: DataFrame, keys: list[str], order: str, range_rows: int) -> DataFrame:
    """``df`` with ``range_``: 0 in groups of up to ``range_rows`` rows, else a number that rises with ``order``, at cuts
    between approximate quantiles. Large groups are few, so their cuts are joined by broadcast."""
    sizes = df.groupBy(*keys).agg(F.count("*").alias("n_")).where(F.col("n_") > range_rows)
    large = checkpoint(sizes.withColumn("parts_", F.ceil(F.col("n_") / range_rows).cast("int")))
    most = large.agg(F.max("parts_")).first()[0]
    if not most:
        return df.withColumn("range_", F.lit(0))
    shares = [k / most for k in range(1, most)]
    inside = df.join(F.broadcast(large.select(*keys)), keys, "left_semi")
    cuts = checkpoint(inside.groupBy(*keys).agg(F.percentile_approx(order, shares, 10_000).alias("cuts_")))
    below = F.size(F.filter("cuts_", lambda c: c < F.col(order)))
    return df.join(F.broadcast(cuts), keys, "left").withColumn("range_", F.coalesce(F.when(F.col("cuts_").isNotNull(), below), F.lit(0))).drop("cuts_")


def previous(df: DataFrame, keys: list[str], order: str, columns: list[str], range_rows: int = RANGE_ROWS) -> DataFrame:
    """``df`` with ``was_<column>`` of the row before in its group, by ``order``, which must be numeric and distinct
    within a group; null for the first row.

    Large groups are cut into ranges of ``order``. Within a range a window looks back; the first row of a range takes
    what the last row of the range before carries over the border, a row a range.
    """
    placed = _ranges(df, keys, order, range_rows)
    w = W.partitionBy(*keys, "range_").orderBy(order)
    seen = placed.select("*", F.row_number().over(w).alias("place_"), *[F.lag(c).over(w).alias(f"in_{c}") for c in columns])
    last = placed.groupBy(*keys, "range_").agg(F.max_by(F.struct(*columns), order).alias("last_"))
    carried = last.select(*keys, "range_", F.lag("last_").over(W.partitionBy(*keys).orderBy("range_")).alias("carried_")).where("carried_ is not null")
    joined = seen.join(carried, [*keys, "range_"], "left")
    return joined.select(*df.columns, *[F.when(F.col("place_") > 1, F.col(f"in_{c}")).otherwise(F.col(f"carried_.{c}")).alias(f"was_{c}") for c in columns])


def ranks(df: DataFrame, order: str, ties: list[str], top: int, cells: int = 1 << 12) -> DataFrame:
    """``df`` with ``rank_`` from 0 by ``order``, then ``ties``, where ``order`` is a whole number from 0 to below ``top``,
    evenly spread. Rows are counted in cells of ``order``; only cells are summed up, and rows are ranked within theirs."""
    cell = F.floor(F.col(order) / F.lit(-(-top // cells))).cast("int")
    placed = df.withColumn("cell_", cell)
    sizes = checkpoint(placed.groupBy("cell_").agg(F.count("*").alias("n_")))  # at most ``cells`` rows
    starts = sizes.select("cell_", (F.sum("n_").over(W.orderBy("cell_")) - F.col("n_")).alias("start_"))
    inside = F.row_number().over(W.partitionBy("cell_").orderBy(order, *ties)) - 1
    return placed.withColumn("inside_", inside).join(F.broadcast(starts), "cell_").select(*df.columns, (F.col("start_") + F.col("inside_")).alias("rank_"))
