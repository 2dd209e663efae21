"""A labelled stream that drifts: rows of a table dealt to batches, features shifted or spread from a batch on,
labels flipped from a batch on.

All is column functions of a row and its batch, so a stream of any size is a projection, and equal seeds give equal
streams. The drift of a feature is a :class:`Shift`; its level grows by one a batch from its onset.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.draws import digest_number, uniform
from sparkloom.operators.ordered import ranks

# The kinds of drift.
KINDS = ("mean_shift_up", "mean_shift_down", "variance_inflation")
BASELINE_SHARE = 0.6
FLIP_RATE = 0.04
FLIP_START = 7


@dataclass(frozen=True)
class Shift:
    kind: str
    rate: float
    onset: int

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"unknown kind {self.kind!r}; known: {', '.join(KINDS)}")


def ramp_level(batch: Column, onset: int) -> Column:
    """0 before the onset, then 1, 2, ..."""
    return F.greatest(F.lit(0), batch - F.lit(onset) + 1)


def shifted(x: Column, shift: Shift, level: Column, mean: Column, std: Column) -> Column:
    """``x`` at a level: moved by rate x level deviations, or spread about the mean."""
    if shift.kind == "variance_inflation":
        return mean + (x - mean) * (1 + shift.rate * level)
    return x + (1 if shift.kind == "mean_shift_up" else -1) * shift.rate * level * std


def flip_probability(batch: Column, rate: float = FLIP_RATE, start: int = FLIP_START) -> Column:
    return F.when(batch < start, 0.0).otherwise(rate * (batch - (start - 1)))


def split_baseline(df: DataFrame, id_col: str, share: float = BASELINE_SHARE, seed: str = "baseline") -> tuple[DataFrame, DataFrame]:
    """(baseline, pool), by a draw from the id; rows without an id go to the pool."""
    chosen = F.coalesce(uniform(F.col(id_col), seed) < share, F.lit(False))
    return df.where(chosen), df.where(~chosen)


def moments(baseline: DataFrame, features: list[str]) -> DataFrame:
    """One row: ``<feature>_mean`` and ``<feature>_std`` (population; 1 where it is 0)."""
    std = {f: F.stddev_pop(f) for f in features}
    return baseline.agg(*[F.avg(f).alias(f"{f}_mean") for f in features], *[F.when(s == 0, 1.0).otherwise(s).alias(f"{f}_std") for f, s in std.items()])


def stream(pool: DataFrame, baseline: DataFrame, id_col: str, label: str, shifts: dict[str, Shift], batches: int = 12, seed: str = "stream") -> DataFrame:
    """The columns of ``pool`` with ``batch`` (from 1), drifted features, and the label flipped in some rows.

    Each row of the pool goes to one batch, by a draw from its id. Features that ``pool`` lacks are
    skipped; nulls stay null. Batches before every onset are as the pool is.
    """
    known = {f: s for f, s in shifts.items() if f in pool.columns}
    dealt = pool.withColumn("batch", (digest_number(F.col(id_col), seed) % batches).cast("int") + 1)
    batch = F.col("batch")
    flip = uniform(F.col(id_col), seed + "-flip") < flip_probability(batch)
    joined = dealt.crossJoin(F.broadcast(moments(baseline, list(known)))) if known else dealt  # one row
    drifted = {f: shifted(F.col(f).cast("double"), s, ramp_level(batch, s.onset), F.col(f"{f}_mean"), F.col(f"{f}_std")).alias(f) for f, s in known.items()}
    flipped = F.when(flip, 1 - F.col(label)).otherwise(F.col(label)).alias(label)
    return joined.select(*[drifted.get(c, flipped if c == label else F.col(c)) for c in pool.columns], "batch")


def bootstrap(pool: DataFrame, id_col: str, batches: int, batch_rows: int, seed: str = "bootstrap") -> DataFrame:
    """The columns of ``pool`` with ``batch`` (from 1) and ``draw`` (from 1): ``batch_rows`` rows a batch, drawn with
    replacement, the same in every run and on any cluster.

    Rows have ranks by a digest of their id, then the id, then their columns; a draw is a digest of its batch and number, scaled to a rank.
    Ranks come from counts of cells, so no task holds the pool, and draws meet rows by an equi-join on the rank.
    """
    told = pool.select(F.struct(*pool.columns).alias("row"), F.coalesce(digest_number(F.col(id_col), seed), F.lit((1 << 32) - 1)).alias("key"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("tie"))
    ranked = ranks(told, "key", ["tie", "row"], 1 << 32)
    n = pool.count()
    draws = pool.sparkSession.range(batches * batch_rows).select((F.floor(F.col("id") / batch_rows) + 1).cast("int").alias("batch"), (F.col("id") % batch_rows + 1).alias("draw"))
    name = F.concat_ws(":", F.col("batch").cast("string"), F.col("draw").cast("string"))
    wanted = draws.withColumn("rank_", F.floor(uniform(name, f"{seed}-draw") * n).cast("long"))
    return wanted.join(ranked, "rank_").select("row.*", "batch", "draw")


def manifest(streamed: DataFrame, shifts: dict[str, Shift]) -> DataFrame:
    """A row a batch: rows, names and levels of the drifting features, the flip probability, whether it is clean."""
    rows = streamed.groupBy("batch").agg(F.count("*").alias("rows"))
    names = [f for f in sorted(shifts) if f in streamed.columns]
    levels = F.array(*[F.struct(F.lit(f).alias("feature"), ramp_level(F.col("batch"), shifts[f].onset).alias("level")) for f in names])
    active = F.filter(levels, lambda x: x["level"] > 0) if names else F.array().cast("array<struct<feature:string,level:int>>")
    flip = F.round(flip_probability(F.col("batch")), 4)
    told = F.array_join(F.transform("active", lambda x: F.concat(x["feature"], F.lit("="), x["level"].cast("string"))), ",")
    return rows.withColumn("active", active).select("batch", "rows", told.alias("drifting"), flip.alias("p_flip"), ((F.size("active") == 0) & (flip == 0)).alias("clean"))


def formula(feature: str, shift: Shift) -> str:
    """What is done to a feature, in words."""
    if shift.kind == "variance_inflation":
        return f"{feature}' = mu + ({feature} - mu) * (1 + {shift.rate} * k)"
    return f"{feature}' = {feature} {'+' if shift.kind == 'mean_shift_up' else '-'} {shift.rate} * k * sigma"
