import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import drift as D
from sparkloom.operators import drift, drift_stream, ordered

SCHEMA = "feature string, x double, is_current boolean"


def samples(spark, base, now, name="f"):
    return spark.createDataFrame([(name, float(x), False) for x in base] + [(name, float(x), True) for x in now], SCHEMA)


def numpy_psi(base, now, bins=10):
    e = np.unique(np.quantile(base, np.linspace(0, 1, bins + 1)))
    inner = e[1:-1] if len(e) > 2 else e[:0]
    p = np.bincount(np.searchsorted(inner, base, side="right"), minlength=len(inner) + 1) / len(base)
    q = np.bincount(np.searchsorted(inner, now, side="right"), minlength=len(inner) + 1) / len(now)
    p, q = np.maximum(p, 1e-6), np.maximum(q, 1e-6)
    return float(((q - p) * np.log(q / p)).sum())


@pytest.mark.parametrize("shift", [0.0, 0.7, 2.0])
def test_psi_matches_numpy_and_bins_add_up(spark, shift):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=700), rng.normal(shift, 1.2, size=500)
    s = samples(spark, a, b)
    got = drift.psi(s).first()["psi"]
    assert got == pytest.approx(numpy_psi(a, b), rel=1e-9)
    assert drift.psi_bins(s).agg(F.sum("contribution")).first()[0] == pytest.approx(got, rel=1e-9)


def test_quantiles_in_many_ranges_match_numpy(spark, monkeypatch):
    rng = np.random.default_rng(2)
    a = np.round(rng.exponential(size=3000), 2)
    monkeypatch.setattr(ordered, "RANGE_ROWS", 50)
    monkeypatch.setattr(ordered.running_sums, "__defaults__", (50,))
    shares = [k / 10 for k in range(11)]
    got = {round(r["share"], 1): r["value"] for r in ordered.quantiles(samples(spark, a, []), "feature", "x", shares).collect()}
    assert [got[round(s, 1)] for s in shares] == pytest.approx(np.quantile(a, shares).tolist())


def test_psi_is_zero_for_empty_or_constant_or_binary_baselines(spark):
    assert drift.psi(samples(spark, [], [1, 2, 3])).first()["psi"] == 0
    assert drift.psi(samples(spark, [1] * 100, [1] * 100)).first()["psi"] == 0
    assert drift.psi(samples(spark, [0, 1] * 50, [1] * 100)).first()["psi"] == pytest.approx(numpy_psi(np.array([0, 1] * 50), np.ones(100)))
    assert drift.psi(samples(spark, [1, 2], [None, math.nan] if False else [])).first()["psi"] == 0


def test_nulls_and_nans_do_not_count(spark):
    rows = [("f", 1.0, False), ("f", None, False), ("f", math.nan, True), ("g", None, True), (None, 1.0, True)]
    r = {x["feature"]: x for x in drift.report(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert r["f"]["n_current"] == 0 and r["f"]["p_value"] == 1 and r["g"]["psi"] == 0


def test_ks_statistic_and_exact_p(spark):
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=272), rng.normal(0.3, 1, size=300)
    xs = np.unique(np.concatenate((a, b)))
    d = np.abs(np.searchsorted(np.sort(a), xs, side="right") / 272 - np.searchsorted(np.sort(b), xs, side="right") / 300).max()
    r = drift.ks_test(samples(spark, a, b)).first()
    assert r["d"] == pytest.approx(d) and 0 < r["p_value"] < r["p_asymptotic"] < 1
    assert drift.ks_test(samples(spark, [1], [2, 3])).first()["p_value"] == 1.0


def test_exact_p_counts_paths():
    for n, m in ((3, 4), (4, 4), (2, 5)):
        for d in (0.3, 0.5, 0.75, 1.0):
            hit = 0
            for ups in itertools.combinations(range(n + m), n):
                i = j = 0
                top = 0.0
                for step in range(n + m):
                    i, j = (i + 1, j) if step in ups else (i, j + 1)
                    top = max(top, abs(i / n - j / m))
                hit += top >= d - 1e-9
            assert drift.ks_p_exact(d, n, m) == pytest.approx(hit / math.comb(n + m, n), abs=1e-9)
    assert drift.ks_p_exact(0.1, 272, 300) == pytest.approx(0.10551, abs=2e-3)


def test_exact_p_of_large_samples_and_equal_ones():
    """Against Kolmogorov's limit where it is good, and the two ways of counting against each other."""
    import time

    start = time.perf_counter()
    n, m, d = 100_000, 90_000, 0.007
    t = d * math.sqrt(n * m / (n + m))
    limit = 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * t * t) for k in range(1, 50))
    assert drift.ks_p_exact(d, n, m) == pytest.approx(limit, rel=0.02)
    assert time.perf_counter() - start < 30
    for k, size in ((3, 10), (12, 60), (40, 900)):
        closed, near = drift.ks_p_exact(k / size, size, size), drift.ks_p_exact(k / size, size, size * 7)
        assert near < closed <= 1  # more values, less doubt about one gap
    assert drift.ks_p_exact(0.0, 5, 5) == 1.0 and drift.ks_p_exact(1.0, 3, 3) == pytest.approx(2 / math.comb(6, 3))
    assert drift.ks_p_exact(1.0, 4, 9) == pytest.approx(2 / math.comb(13, 4), rel=1e-6)


def test_timeline_equals_a_report_a_day(spark):
    rng = random.Random(11)
    base = [("a", rng.gauss(0, 1)) for _ in range(300)] + [("b", float(rng.randint(0, 1))) for _ in range(50)] + [("a", None), ("a", float("nan"))]
    days = [("a", d, rng.gauss(d / 3, 1)) for d in range(4) for _ in range(40)] + [("b", 1, 1.0), ("b", 2, 7.0), ("b", 2, None), ("c", 1, 1.0)] + [("a", 2, base[0][1])] * 3
    got = {(r["feature"], r["day"]): (r["psi"], r["d"]) for r in drift.timeline(spark.createDataFrame(base, "feature string, x double"), spark.createDataFrame(days, "feature string, day int, x double"), spark.createDataFrame([(d,) for d in range(5)], "day int")).collect()}
    assert got.keys() == {(f, d) for f in "ab" for d in range(5)}
    for (f, d), (psi, gap) in got.items():
        rows = [(f, x, False) for g, x in base if g == f] + [(f, x, True) for g, e, x in days if (g, e) == (f, d)]
        s = spark.createDataFrame(rows, "feature string, x double, is_current boolean")
        assert psi == pytest.approx(drift.psi(s).first()["psi"]) and gap == pytest.approx(drift.ks(s).first()["d"])


def test_bootstrap_draws_with_replacement(spark):
    pool = spark.createDataFrame([(i, i * 1.5) for i in range(50)], "id long, x double")
    once, again = (sorted(map(tuple, drift_stream.bootstrap(pool.repartition(n), "id", 4, 200).collect())) for n in (1, 5))
    assert once == again and len(once) == 800 and {(r[2], r[3]) for r in once} == {(b, d) for b in range(1, 5) for d in range(1, 201)}
    counts = [sum(r[0] == i for r in once) for i in range(50)]
    assert min(counts) >= 4 and max(counts) <= 40 and len({r[0] for r in once if r[2] == 1}) < 200
    assert drift_stream.bootstrap(pool.where("false"), "id", 2, 5).count() == 0


def test_severity_and_decision_bounds(spark):
    df = spark.createDataFrame([(0.0,), (0.05,), (0.1,), (0.15,), (0.2,), (0.9,)], "psi double")
    assert [r[0] for r in df.select(D.psi_severity(F.col("psi"))).collect()] == ["stable", "stable", "moderate", "moderate", "significant", "significant"]
    assert [r[0] for r in df.select(D.drift_detected(F.col("psi"), F.lit(0.5))).collect()] == [False] * 5 + [True]


def test_only_the_drifted_feature_is_flagged(spark):
    rng = np.random.default_rng(6)
    s = samples(spark, rng.normal(size=2000), rng.normal(size=2000), "a").unionByName(samples(spark, rng.normal(size=2000), rng.normal(3, 1, size=2000), "b"))
    r = drift.summary(drift.report(s)).first()
    assert (r["n_checked"], r["n_significant"], r["significant_features"], r["fraction"]) == (2, 1, "b", 0.5)
    assert drift.retrain_decision(drift.summary(drift.report(s)), 59).first()["decision"] == "insufficient_labels"
    assert drift.retrain_decision(drift.summary(drift.report(s)), 60).first()["decision"] == "retrain"


def test_summary_of_nothing(spark):
    r = drift.summary(drift.report(spark.createDataFrame([], SCHEMA))).first()
    assert r["n_checked"] == 0 and r["fraction"] == 0.0 and r["any_drift"] is False


def test_histogram_closes_last_bin_and_shows_empty_ones(spark):
    h = drift.histogram(samples(spark, [0, 0, 10], [10, 5]), 4).orderBy("bin").collect()
    assert [(r["base"], r["now"]) for r in h] == [(2, 0), (0, 0), (0, 1), (1, 1)]
    same = drift.histogram(samples(spark, [3, 3], [3]), 2).orderBy("bin").collect()
    assert [(r["base"], r["now"], r["center"]) for r in same] == [(2, 1, 3.25), (0, 0, 3.75)]


def test_running_sums_over_ranges_without_keys(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("o"), F.lit(1).cast("long").alias("one"))
    got = ordered.running_sums(df, [], "o", ["one"], range_rows=37)
    assert got.where("one_upto <> o + 1").count() == 0 and got.count() == 1000


def test_samples_are_read_once(spark):
    """Before, each step of a report read and counted the samples anew, and joins dealt them by their feature alone."""
    seen = spark.sparkContext.accumulator(0)

    def read(x):
        seen.add(1)
        return x

    rng = np.random.default_rng(6)
    some = samples(spark, rng.normal(size=300), rng.normal(size=200)).withColumn("x", F.udf(read, "double").asNondeterministic()("x"))
    assert drift.report(some).count() == 1
    assert seen.value == 500


def test_ranges_do_not_shuffle_rows_by_group(spark):
    rows = spark.createDataFrame([("f", float(i), 1) for i in range(300)], "k string, x double, n long")
    told = ordered.running_sums(rows, ["k"], "x", ["n"], range_rows=50)
    plan = told._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan
    assert [r["n_upto"] for r in told.orderBy("x").collect()] == list(range(1, 301))


def test_paths_of_each_feature_have_their_own_task(spark):
    rng = np.random.default_rng(7)
    some = None
    for name in "abcde":
        one = samples(spark, rng.normal(size=40), rng.normal(size=31), name)
        some = one if some is None else some.unionByName(one)
    tasks = drift.ks_test(some).select("feature", F.spark_partition_id().alias("task")).collect()
    assert len({r["task"] for r in tasks}) == len(tasks) == 5


def test_paths_by_leaps_equal_those_by_rows():
    for d, n, m in ((0.3, 7, 2000), (0.9, 3, 100), (0.2, 1, 50), (0.15, 20, 301)):
        p, q, bound = n / (n + m), m / (n + m), d * n * m - 1e-9 * n * m
        row = np.array([q**j if j * n < bound else 0.0 for j in range(m + 1)])
        for i in range(1, n + 1):
            new, last = np.zeros(m + 1), 0.0
            for j in range(m + 1):
                last = p * row[j] + q * last if abs(i * m - j * n) < bound else 0.0
                new[j] = last
            row = new
        assert abs(drift._kept_by_leaps(n, m, bound, p, q) - row[m]) < 1e-12
    # rows of this length would take minutes and gigabytes
    assert abs(drift.ks_p_exact(0.05, 300, 1_000_000_000) - drift.ks_p_exact(0.05, 300, 1_000_000)) < 1e-3
