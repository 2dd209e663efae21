"""Drift of samples (feature, x, is_current): PSI, Kolmogorov-Smirnov, moments, histograms, decisions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.drift import SHARE_FLOOR, bin_of, drift_detected, ks_p_asymptotic, psi_severity
from sparkloom.operators.ordered import counted_quantiles, few, running_sums
from sparkloom.shipping import checkpoint

BINS = 10
RETRAIN_FRACTION = 0.3
RETRAIN_ROWS = 60
#: Cells of the band up to which paths are counted one by one: minutes at most for a feature.
EXACT_CELLS = 2e10
#: Tasks that the features' paths are dealt to.
MOST_TASKS = 10_000


def clean(samples: DataFrame) -> DataFrame:
    """Without nulls and NaN; other types than numbers become null first."""
    x = F.col("x").try_cast("double")
    return samples.select("feature", x.alias("x"), "is_current").where("x is not null and not isnan(x)")


def counts(samples: DataFrame) -> DataFrame:
    """(feature, x, base, now): how often each value occurs in either sample. The rest starts from these rows, so that
    samples are read once and never shuffled by their feature alone."""
    both = clean(samples).groupBy("feature", "x").agg(F.count_if(~F.col("is_current")).alias("base"), F.count_if("is_current").alias("now"))
    return checkpoint(both)


def decile_edges(samples: DataFrame, bins: int = BINS) -> DataFrame:
    """(feature, edges): distinct quantiles of the baseline, ascending, outer ones infinite.

    With at most two distinct edges there is one bin, so its PSI is 0.
    """
    return _edges(counts(samples), bins)


def _edges(counted: DataFrame, bins: int) -> DataFrame:
    shares = [k / bins for k in range(bins + 1)]
    base = counted.where("base > 0").select("feature", "x", F.col("base").alias("n"))
    found = counted_quantiles(base, "feature", "x", shares)
    edges = found.groupBy("feature").agg(F.array_sort(F.collect_set("value")).alias("e"))  # at most bins + 1 values
    inner = F.slice("e", 2, F.greatest(F.size("e") - 2, F.lit(0)))
    return edges.select("feature", F.concat(F.array(F.lit(-math.inf)), inner, F.array(F.lit(math.inf))).alias("edges"))


def psi_bins(samples: DataFrame, bins: int = BINS) -> DataFrame:
    """(feature, bin, lo, hi, expected, actual, contribution), every bin of every feature.

    Shares are floored at 1e-6 and not normalised again.
    """
    return _psi_bins(counts(samples), bins)


def _psi_bins(counted: DataFrame, bins: int) -> DataFrame:
    edges = checkpoint(_edges(counted, bins))
    inner = F.slice("edges", 2, F.greatest(F.size("edges") - 2, F.lit(0)))
    placed = counted.join(few(edges), "feature").groupBy("feature", bin_of(F.col("x"), inner).alias("bin"))
    counts_ = checkpoint(placed.agg(F.sum("base").alias("base"), F.sum("now").alias("now")))  # at most bins + 1 rows a feature
    totals = counts_.groupBy("feature").agg(F.sum("base").alias("all_base"), F.sum("now").alias("all_now"))
    every = edges.select("feature", "edges", F.explode(F.sequence(F.lit(0), F.size("edges") - 2)).alias("bin"))
    joined = every.join(counts_, ["feature", "bin"], "left").join(totals, "feature")
    expected = F.greatest(F.coalesce(F.col("base") / F.col("all_base"), F.lit(0.0)), F.lit(SHARE_FLOOR))
    actual = F.greatest(F.coalesce(F.try_divide("now", "all_now"), F.lit(0.0)), F.lit(SHARE_FLOOR))
    contribution = F.when(F.col("all_now") > 0, (actual - expected) * F.ln(actual / expected)).otherwise(0.0)
    return joined.select(
        "feature", "bin", F.element_at("edges", F.col("bin") + 1).alias("lo"), F.element_at("edges", F.col("bin") + 2).alias("hi"), expected.alias("expected"), actual.alias("actual"), contribution.alias("contribution")
    )


def psi(samples: DataFrame, bins: int = BINS) -> DataFrame:
    """(feature, psi): 0 where either sample is empty."""
    return _psi(samples, counts(samples), bins)


def _psi(samples: DataFrame, counted: DataFrame, bins: int) -> DataFrame:
    found = _psi_bins(counted, bins).groupBy("feature").agg(F.sum("contribution").alias("psi"))
    features = samples.select("feature").distinct()
    return features.join(found, "feature", "left").select("feature", F.coalesce("psi", F.lit(0.0)).alias("psi"))


def ks(samples: DataFrame) -> DataFrame:
    """(feature, n_base, n_current, d): the largest gap of the two distribution functions; 0 with fewer
    than two values on a side."""
    return _ks(counts(samples))


def _ks(counted: DataFrame) -> DataFrame:
    totals = checkpoint(counted.groupBy("feature").agg(F.sum("base").alias("n_base"), F.sum("now").alias("n_current")))
    upto = running_sums(counted, ["feature"], "x", ["base", "now"]).join(few(totals), "feature")
    gap = F.abs(F.try_divide("base_upto", "n_base") - F.try_divide("now_upto", "n_current"))
    found = upto.groupBy("feature", "n_base", "n_current").agg(F.max(gap).alias("d"))
    enough = (F.col("n_base") > 1) & (F.col("n_current") > 1)
    return found.select("feature", "n_base", "n_current", F.when(enough, F.col("d")).otherwise(0.0).alias("d"))


def ks_p_exact(d: float, n: int, m: int) -> float:
    """The chance that two samples of ``n`` and ``m`` from one continuous distribution are at least ``d`` apart.

    It is the share of lattice paths from (0, 0) to (n, m) that leave the band of width d around the diagonal. For
    equal samples reflections count them in closed form. Else paths are counted along the shorter side, within the
    band alone, of 2 d max(n, m) places a row, and weighted so that nothing overflows or vanishes. Where the shorter
    side is far shorter, they are counted along the longer one, in leaps (see :func:`_kept_by_leaps`).
    """
    if min(n, m) < 1 or d <= 0:
        return 1.0
    if n == m:
        k, out = max(1, math.ceil(d * n - 1e-9 * n)), 0.0
        ways = math.lgamma(2 * n + 1) - 2 * math.lgamma(n + 1)
        for i in range(1, n // k + 1):
            part = math.exp(math.lgamma(2 * n + 1) - math.lgamma(n - i * k + 1) - math.lgamma(n + i * k + 1) - ways)
            out += part if i % 2 else -part
            if part < 1e-17 * out:
                break
        return min(1.0, max(0.0, 2 * out))
    n, m = min(n, m), max(n, m)
    bound = d * n * m - 1e-9 * n * m
    if bound <= 0:
        return 1.0
    # weights of paths that step with chances n and m in n + m; on the diagonal they are near 1 / sqrt(i + j)
    p, q = n / (n + m), m / (n + m)
    total = math.lgamma(n + m + 1) - math.lgamma(n + 1) - math.lgamma(m + 1) + n * math.log(p) + m * math.log(q)
    if (wide := 2 * d * n + 1) * wide < d * m:
        kept = _kept_by_leaps(n, m, bound, p, q)
        return float(min(1.0, max(0.0, 1.0 - math.exp(math.log(kept) - total)))) if kept > 0 else 1.0
    block = min(m + 1, int(300 / -math.log(q)))
    up = q ** -np.arange(block, dtype=float)
    down = 1 / up

    def along(x: np.ndarray) -> np.ndarray:
        """y[j] = x[j] + q y[j - 1]; what comes from more than a block before is below 1e-130."""
        if len(x) <= block:
            return np.cumsum(x * up[: len(x)]) * down[: len(x)]
        y = np.cumsum(np.append(x, np.zeros(-len(x) % block)).reshape(-1, block) * up, axis=1) * down
        y[1:] += y[:-1, -1:] * (q * down)
        return y.reshape(-1)[: len(x)]

    lo, row = 0, q ** np.arange(min(m, math.ceil(bound / n) - 1) + 1, dtype=float)
    for i in range(1, n + 1):
        # places j with |i m - j n| < bound
        first = max(0, math.floor((i * m - bound) / n) + 1)
        last = min(m, math.ceil((i * m + bound) / n) - 1)
        if last < first or first - lo >= len(row):
            return 1.0
        here = np.zeros(last - first + 1)
        kept = row[first - lo :][: len(here)]
        here[: len(kept)] = p * kept
        row, lo = along(here), first
    if lo + len(row) - 1 < m or row[-1] <= 0:
        return 1.0
    return float(min(1.0, max(0.0, 1.0 - math.exp(math.log(row[-1]) - total))))


def _kept_by_leaps(n: int, m: int, bound: float, p: float, q: float) -> float:
    """The weight of paths to (n, m) that stay in the band. Between two columns at which a row enters or leaves it,
    nothing bounds a path, and the ways up have a closed form; there are 2 n such columns, however large m is."""
    i = np.arange(n + 1, dtype=float)
    first = np.maximum(0, np.floor((i * m - bound) / n) + 1).astype(np.int64)
    last = np.minimum(m, np.ceil((i * m + bound) / n) - 1).astype(np.int64)
    ends = np.unique(np.concatenate((first, last + 1, [0, m + 1])))
    ends = ends[ends <= m + 1]
    f = np.zeros(n + 1)
    f[0] = 1 / q  # the first column is entered without a step
    for at, to in zip(ends.tolist(), ends[1:].tolist(), strict=False):
        lo, hi = int(np.searchsorted(last, at)), int(np.searchsorted(first, at, side="right"))
        if lo >= hi:
            return 0.0
        up = np.arange(1, hi - lo, dtype=float)
        ways = q ** (to - at) * np.cumprod(np.concatenate(([1.0], p * (up + (to - at) - 1) / up)))
        here = np.convolve(f[lo:hi], ways)[: hi - lo]
        f = np.zeros(n + 1)
        f[lo:hi] = here
    return float(f[n])


def _exact(d: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
    return pd.Series([ks_p_exact(a, int(b), int(c)) for a, b, c in zip(d, n, m, strict=True)], dtype="float64")


def ks_test(samples: DataFrame, exact_cells: float = EXACT_CELLS) -> DataFrame:
    """:func:`ks` with ``p_asymptotic`` and ``p_value``; 1 with fewer than two values on a side.

    ``p_value`` is exact for samples of equal sizes, and where the band has at most ``exact_cells`` cells: 2 d n m, which
    10^5 values a side do not reach at any d that leaves a doubt. Beyond, both agree to more digits than a decision needs.
    """
    return _ks_test(counts(samples), exact_cells)


def _ks_test(counted: DataFrame, exact_cells: float = EXACT_CELLS) -> DataFrame:
    found = checkpoint(_ks(counted))
    # a feature a task: the paths of one may take minutes
    found = found.repartitionByRange(max(1, min(MOST_TASKS, found.count())), "feature")
    enough = (F.col("n_base") > 1) & (F.col("n_current") > 1)
    asymptotic = F.when(enough, ks_p_asymptotic(F.col("d"), F.col("n_base"), F.col("n_current"))).otherwise(1.0)
    counted = enough & ((F.col("n_base") == F.col("n_current")) | (2 * F.col("d") * F.col("n_base") * F.col("n_current") <= exact_cells))
    told = found.withColumn("p_asymptotic", asymptotic)
    exact = F.pandas_udf(_exact, "double")(F.col("d"), F.when(counted, F.col("n_base")).otherwise(0), F.when(counted, F.col("n_current")).otherwise(0))
    return told.withColumn("p_value", F.when(counted, exact).otherwise(F.col("p_asymptotic")))


def moments(samples: DataFrame) -> DataFrame:
    """(feature, base_mean, base_std, current_mean, current_std) with population deviations; null if empty."""
    c = F.col("is_current")
    return clean(samples).groupBy("feature").agg(
        F.avg(F.when(~c, F.col("x"))).alias("base_mean"),
        F.stddev_pop(F.when(~c, F.col("x"))).alias("base_std"),
        F.avg(F.when(c, F.col("x"))).alias("current_mean"),
        F.stddev_pop(F.when(c, F.col("x"))).alias("current_std"),
    )


def report(samples: DataFrame, p_column: str = "p_value", bins: int = BINS) -> DataFrame:
    """One row a feature: ``psi, severity, d, p_value, drift_detected, n_base, n_current``."""
    counted = counts(samples)
    # the paths are counted once, before anything is joined
    joined = _psi(samples, counted, bins).join(checkpoint(_ks_test(counted)), "feature", "left")
    p = F.coalesce(p_column, F.lit(1.0))
    return joined.select(
        "feature", "psi", psi_severity(F.col("psi")).alias("severity"), F.coalesce("d", F.lit(0.0)).alias("d"), p.alias("p_value"), drift_detected(F.col("psi"), p).alias("drift_detected"),
        F.coalesce("n_base", F.lit(0)).alias("n_base"), F.coalesce("n_current", F.lit(0)).alias("n_current"),
    )


def summary(reports: DataFrame) -> DataFrame:
    """One row: features checked, significant and drifted, their names, and the significant fraction."""
    significant = F.col("severity") == "significant"
    return reports.agg(
        F.count("*").alias("n_checked"),
        F.count_if(significant).alias("n_significant"),
        F.count_if("drift_detected").alias("n_drifted"),
        F.array_join(F.array_sort(F.collect_list(F.when(significant, F.col("feature")))), ",").alias("significant_features"),
        F.coalesce(F.try_divide(F.count_if(significant).cast("double"), F.count("*")), F.lit(0.0)).alias("fraction"),
        F.coalesce(F.bool_or("drift_detected"), F.lit(False)).alias("any_drift"),
    )


def retrain_decision(summarised: DataFrame, n_labelled: int, fraction: float = RETRAIN_FRACTION, rows: int = RETRAIN_ROWS) -> DataFrame:
    """``decision`` and ``reason``: retrain only strictly above ``fraction`` and with enough labelled rows."""
    above = F.col("fraction") > fraction
    decision = F.when(~above, "no_action").when(F.lit(n_labelled < rows), "insufficient_labels").otherwise("retrain")
    share = F.format_string("%.2f", "fraction")
    counted = F.concat(F.col("n_significant").cast("string"), F.lit("/"), F.col("n_checked").cast("string"))
    # The wording of the reasons.
    quiet = F.concat(F.lit("No retrain: "), counted, F.lit(" features significant (fraction "), share, F.lit(f" <= {fraction:.2f})"))
    few = F.concat(F.lit("Drift threshold exceeded (fraction "), share, F.lit(f" > {fraction:.2f}) but only {n_labelled} labelled rows available (need {rows}); retrain skipped"))
    done = F.concat(F.lit("Auto-retrain: "), counted, F.lit(" features significantly drifted (fraction "), share, F.lit(f" > threshold {fraction:.2f}); retrained on {n_labelled} recent production rows"))
    reason = F.when(~above, quiet).when(F.lit(n_labelled < rows), few).otherwise(done)
    return summarised.select("n_checked", "n_significant", "fraction", decision.alias("decision"), F.lit(n_labelled).cast("long").alias("n_labelled"), reason.alias("reason"))


def histogram(samples: DataFrame, bins: int = 20) -> DataFrame:
    """(feature, bin, center, base, now): equal widths over both samples, the last bin closed; one unit
    wide range where all values are equal; empty bins are rows too."""
    x = clean(samples)
    limits = x.groupBy("feature").agg(F.min("x").alias("lo"), F.max("x").alias("top")).select("feature", "lo", F.when(F.col("top") > F.col("lo"), F.col("top")).otherwise(F.col("lo") + 1).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    placed = x.join(limits, "feature").groupBy("feature", F.least(F.floor((F.col("x") - F.col("lo")) / width), F.lit(bins - 1)).cast("int").alias("bin"))
    counts = placed.agg(F.count_if(~F.col("is_current")).alias("base"), F.count_if("is_current").alias("now"))
    every = limits.select("feature", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return every.join(counts, ["feature", "bin"], "left").select(
        "feature", "bin", (F.floor((F.col("lo") + (F.col("bin") + 0.5) * width) * 10000 + 0.5) / 10000).alias("center"), F.coalesce("base", F.lit(0)).alias("base"), F.coalesce("now", F.lit(0)).alias("now")
    )


def timeline(base: DataFrame, days: DataFrame, wanted: DataFrame, bins: int = BINS) -> DataFrame:
    """(feature, day, psi, d) of every day of ``wanted`` (day) and feature of ``base`` (feature, x), from ``days`` (feature,
    day, x); 0 where a day has no values.

    The baseline is read once for its edges, once for its counts: each bin's share and the running counts at all values
    that a day has. A day adds counts of its own, which any partition of its rows gives, so a new day costs itself.
    """
    base = clean(base.withColumn("is_current", F.lit(False))).select("feature", "x")
    days = days.select("feature", "day", F.col("x").try_cast("double").alias("x")).where("x is not null and not isnan(x)")
    edges = checkpoint(decile_edges(base.withColumn("is_current", F.lit(False)), bins))
    inner = F.slice("edges", 2, F.greatest(F.size("edges") - 2, F.lit(0)))
    counted = checkpoint(base.groupBy("feature", "x").agg(F.count("*").alias("b")))  # equal values once
    of_days = checkpoint(days.groupBy("feature", "day", "x").agg(F.count("*").alias("n")))
    every = edges.join(F.broadcast(wanted.select("day").distinct())).select("feature", "day")  # one row a day

    shares = counted.join(edges, "feature").groupBy("feature", bin_of(F.col("x"), inner).alias("bin")).agg(F.sum("b").alias("b"))
    totals = shares.groupBy("feature").agg(F.sum("b").alias("nb"))
    places = edges.select("feature", F.explode(F.sequence(F.lit(0), F.size("edges") - 2)).alias("bin"))
    expected = places.join(shares, ["feature", "bin"], "left").join(totals, "feature").select("feature", "bin", "nb", F.greatest(F.coalesce(F.col("b") / F.col("nb"), F.lit(0.0)), F.lit(SHARE_FLOOR)).alias("expected"))
    got = of_days.join(edges, "feature").groupBy("feature", "day", bin_of(F.col("x"), inner).alias("bin")).agg(F.sum("n").alias("n"))
    sizes = checkpoint(got.groupBy("feature", "day").agg(F.sum("n").alias("nd")))
    cells = expected.join(sizes, "feature").join(got, ["feature", "day", "bin"], "left")
    actual = F.greatest(F.coalesce(F.col("n") / F.col("nd"), F.lit(0.0)), F.lit(SHARE_FLOOR))
    psi = cells.groupBy("feature", "day").agg(F.sum((actual - F.col("expected")) * F.ln(actual / F.col("expected"))).alias("psi"))

    both = counted.unionByName(of_days.select("feature", "x", F.lit(0).cast("long").alias("b"))).groupBy("feature", "x").agg(F.sum("b").alias("b"))
    upto = running_sums(both, ["feature"], "x", ["b"])
    steps = running_sums(of_days, ["feature", "day"], "x", ["n"]).join(upto, ["feature", "x"]).join(sizes, ["feature", "day"]).join(totals, "feature")
    # between two values of a day its own share stands still, so the gap is largest at one of them or just before
    at = F.abs(F.col("b_upto") / F.col("nb") - F.col("n_upto") / F.col("nd"))
    before = F.abs((F.col("b_upto") - F.col("b")) / F.col("nb") - (F.col("n_upto") - F.col("n")) / F.col("nd"))
    enough = (F.col("nb") > 1) & (F.col("nd") > 1)
    ks = steps.groupBy("feature", "day").agg(F.max(F.when(enough, F.greatest(at, before)).otherwise(0.0)).alias("d"))
    found = psi.join(ks, ["feature", "day"])
    return every.join(found, ["feature", "day"], "left").select("feature", "day", F.coalesce("psi", F.lit(0.0)).alias("psi"), F.coalesce("d", F.lit(0.0)).alias("d"))
