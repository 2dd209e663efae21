"""Queries on drift and on the prediction log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import drift, drift_stream, metrics, models
from sparkloom.operators.drift_stream import Shift
from sparkloom.sources.catalog import LINE_FEATURES, event_samples, line_samples, predictions, table


def _edges(samples: DataFrame) -> DataFrame:
    e = drift.decile_edges(samples)
    return e.select("feature", F.posexplode(F.filter("edges", lambda x: F.abs(x) < float("inf"))).alias("pos", "edge")).select("feature", "pos", F.round("edge", 6).alias("edge"))


def drift_decile_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(event_samples(spark, sf_dir))


def drift_psi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.psi(event_samples(spark, sf_dir)).select("feature", F.round("psi", 6).alias("psi"))


def drift_psi_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.psi(line_samples(spark, sf_dir)).select("feature", F.round("psi", 6).alias("psi"))


def drift_psi_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = drift.psi_bins(event_samples(spark, sf_dir))
    return b.select("feature", "bin", *[F.round(c, 6).alias(c) for c in ("expected", "actual", "contribution")])


def drift_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.functions.drift import psi_severity

    return drift.psi(line_samples(spark, sf_dir)).select("feature", psi_severity(F.col("psi")).alias("severity"))


def drift_ks_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.ks(event_samples(spark, sf_dir)).select("feature", "n_base", "n_current", F.round("d", 6).alias("d"))


def drift_ks_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.ks(line_samples(spark, sf_dir)).select("feature", "n_base", "n_current", F.round("d", 6).alias("d"))


def drift_ks_pvalue_asym(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.ks_test(event_samples(spark, sf_dir), exact_cells=0).select("feature", F.round("p_asymptotic", 6).alias("p_value"))


def drift_feature_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = drift.moments(event_samples(spark, sf_dir))
    return m.select("feature", *[F.round(c, 6).alias(c) for c in m.columns[1:]])


def drift_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On asymptotic p-values, which SQL can follow; ``drift_report`` has the exact ones."""
    s = drift.summary(drift.report(event_samples(spark, sf_dir), "p_asymptotic"))
    return s.withColumn("fraction", F.round("fraction", 6))


def drift_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PSI, KS and the decision per feature, with exact p-values up to their size limit."""
    r = drift.report(event_samples(spark, sf_dir))
    return r.select("feature", F.round("psi", 5).alias("psi"), "severity", F.round("d", 5).alias("d"), F.round("p_value", 6).alias("p_value"), "drift_detected")


def drift_retrain_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = predictions(spark, sf_dir).where("actual_label is not null").count()
    s = drift.summary(drift.report(event_samples(spark, sf_dir), "p_asymptotic"))
    return drift.retrain_decision(s, labelled).withColumn("fraction", F.round("fraction", 6))


def feature_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.histogram(event_samples(spark, sf_dir))


def drift_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PSI and D of each day against the first fifteen, per event type; one row a day and feature."""
    e = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), F.col("event_type").alias("feature"), F.col("value").alias("x"))
    cut = F.lit("2024-01-16").cast("date")
    wanted = spark.range(1).select(F.explode(F.sequence(cut, F.lit("2024-01-30").cast("date"))).alias("day"))
    t = drift.timeline(e.where(F.col("day") < cut), e.where(F.col("day") >= cut), wanted.unionByName(e.where(F.col("day") >= cut).select("day")))
    return t.select(F.date_format("day", "yyyy-MM-dd").alias("day"), F.col("feature").alias("event_type"), F.round("psi", 6).alias("psi"), F.round("d", 6).alias("d"))


def recent_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.recent(predictions(spark, sf_dir)).select("run_id", "id", F.col("rn").cast("int").alias("rn"), "prediction")


def rolling_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.rolling_accuracy(predictions(spark, sf_dir)).select("run_id", "n_labelled", F.round("accuracy", 6).alias("accuracy"))


def positive_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.positive_rate(predictions(spark, sf_dir)).select("run_id", "n", F.round("positive_rate", 6).alias("positive_rate"))


def prediction_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The capped listing of a run: the newest 100 rows, its limit being the feature."""
    return metrics.listing(predictions(spark, sf_dir), run_id=3).select("id", "run_id", "prediction", F.round("proba", 6).alias("proba"))


def coerce_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = metrics.align(predictions(spark, sf_dir), ["k", "value", "missing"])
    return a.select("id", F.round("k", 6).alias("k"), F.round("value", 6).alias("value"), "missing")


def experiment_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parent and children: nations with the ordered names of their customers' segments, as experiments have
    their runs; a nation without customers has none."""
    n, c = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    per = c.select("c_nationkey", "c_mktsegment").distinct().groupBy("c_nationkey").agg(F.array_join(F.array_sort(F.collect_list("c_mktsegment")), ",").alias("runs"))
    return n.join(per, F.col("n_nationkey") == F.col("c_nationkey"), "left").select("n_nationkey", "n_name", F.coalesce("runs", F.lit("")).alias("runs"))


def run_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished orders with their customer's name, as completed runs with their experiment's."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    done = o.where("o_orderstatus = 'F'").join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
    return done.select("o_orderkey", "c_name", F.date_format("o_orderdate", "yyyy-MM-dd").alias("created"), F.round("o_totalprice", 2).alias("total"))


def entity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir)
    return p.agg(F.count("*").alias("predictions"), F.count_distinct("run_id").alias("runs"), F.count("actual_label").alias("labelled"), F.count_if(F.col("prediction") == 1).alias("positive"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, y = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    marks = F.length(F.regexp_replace("text", r"[^!#$%&*]", "")) / F.greatest(F.length("text"), F.lit(1))
    return d.join(y, "doc_id").select("doc_id", F.col("quality").alias("label"), F.round(1 - marks, 6).alias("score")).withColumn("predicted", (F.col("score") > 0.98).cast("int"))


def classification_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = metrics.classification(_scored(spark, sf_dir))
    return m.select("tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


def auc_ranksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.auc(_scored(spark, sf_dir)).select(F.round("auc", 6).alias("auc"))


def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which side of the split each labelled document is on."""
    s = metrics.stratified_split(table(spark, sf_dir, "labels"), "quality", "doc_id")
    return s.select("doc_id", "quality", F.col("in_train").cast("int").alias("in_train"))


def train_score_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scaler and a logistic regression on inferred line features, trained on one side of a split by class,
    measured on the other."""
    lines = _lines(spark, sf_dir).select("id", (F.year("l_shipdate") - 1992).alias("year"), *LINE_FEATURES, (F.col("l_linestatus") == "F").cast("int").alias("target"))
    m = models.train(lines, "id", settings={"maxIter": 20, "regParam": 1e-4}).metrics
    return m.select("tp", "fp", "fn", "tn", F.round("accuracy", 6).alias("accuracy"), F.round("auc", 6).alias("auc"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").withColumn("id", F.col("l_orderkey") * 8 + F.col("l_linenumber"))


#: What drifts in the stream of lines.
LINE_SHIFTS = {"l_quantity": Shift("mean_shift_up", 0.28, 4), "l_extendedprice": Shift("variance_inflation", 0.35, 6), "l_discount": Shift("mean_shift_down", 0.24, 8)}


def _stream_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("id", *[F.col(c).cast("double").alias(c) for c in LINE_FEATURES], (F.col("l_returnflag") == "R").cast("int").alias("target"))


def baseline_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift_stream.split_baseline(_stream_lines(spark, sf_dir), "id")[0]


def line_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    baseline, pool = drift_stream.split_baseline(_stream_lines(spark, sf_dir), "id")
    return drift_stream.stream(pool, baseline, "id", "target", LINE_SHIFTS)


def drift_stream_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch, drifted features and possibly flipped label of every row of the stream."""
    return line_stream(spark, sf_dir).select("id", "batch", "target", *[F.round(c, 4).alias(c) for c in LINE_FEATURES])


def drift_stream_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift_stream.manifest(line_stream(spark, sf_dir), LINE_SHIFTS)


def drift_bootstrap_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve batches of 500 rows drawn with replacement from the pool of lines."""
    pool = drift_stream.split_baseline(_stream_lines(spark, sf_dir), "id")[1]
    return drift_stream.bootstrap(pool, "id", 12, 500).select("batch", "draw", "id", *[F.round(c, 4).alias(c) for c in LINE_FEATURES], "target")


QUERIES = {
    f.__name__: f
    for f in (
        drift_decile_edges, drift_psi, drift_psi_lines, drift_psi_bins, drift_severity, drift_ks_stat, drift_ks_lines, drift_ks_pvalue_asym, drift_feature_moments, drift_summary, drift_report,
        drift_retrain_decision, feature_histogram, drift_timeline, recent_window, rolling_accuracy, positive_rate, prediction_listing, coerce_features, experiment_runs, run_listing, entity_counts,
        classification_metrics, auc_ranksum, stratified_split, train_score_pipeline, drift_stream_rows, drift_stream_manifest, drift_bootstrap_rows,
    )
}

_EVENTS = "s AS (SELECT event_type AS feature, value AS x, ts >= TIMESTAMP '2024-01-16' AS cur FROM events)"
_LINES = """l AS (SELECT l_returnflag = 'R' AS cur, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem),
    s AS (SELECT feature, x, cur FROM (UNPIVOT l ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME feature VALUE x))"""
_BINS = """
    q AS (SELECT feature, list_sort(list_distinct(quantile_cont(x, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e FROM s WHERE NOT cur GROUP BY feature),
    i AS (SELECT feature, CASE WHEN len(e) > 2 THEN e[2:len(e) - 1] ELSE [] END AS e FROM q),
    p AS (SELECT s.feature, len(list_filter(i.e, lambda y: y <= x)) AS bin, cur FROM s JOIN i USING (feature)),
    c AS (SELECT feature, bin, count(*) FILTER (NOT cur) AS b, count(*) FILTER (cur) AS n FROM p GROUP BY ALL),
    t AS (SELECT feature, sum(b) AS tb, sum(n) AS tn FROM c GROUP BY ALL),
    every AS (SELECT feature, unnest(range(0, len(e) + 1)) AS bin FROM i),
    f AS (SELECT every.feature, every.bin, greatest(coalesce(b / tb, 0), 1e-6) AS expected, greatest(coalesce(n / tn, 0), 1e-6) AS actual
          FROM every LEFT JOIN c ON every.feature = c.feature AND every.bin = c.bin JOIN t ON t.feature = every.feature),
    psi AS (SELECT feature, sum((actual - expected) * ln(actual / expected)) AS psi FROM f GROUP BY feature)"""
_KS = """
    kc AS (SELECT feature, x, count(*) FILTER (NOT cur) AS b, count(*) FILTER (cur) AS n FROM s GROUP BY ALL),
    ku AS (SELECT feature, sum(b) OVER w AS ub, sum(n) OVER w AS un, sum(b) OVER (PARTITION BY feature) AS tb, sum(n) OVER (PARTITION BY feature) AS tn
           FROM kc WINDOW w AS (PARTITION BY feature ORDER BY x ROWS UNBOUNDED PRECEDING)),
    ks AS (SELECT feature, max(tb)::BIGINT AS n_base, max(tn)::BIGINT AS n_current, max(abs(ub / tb - un / tn)) AS d FROM ku GROUP BY feature)"""
_P = """
    pv AS (SELECT feature, CASE WHEN t2 < 0.04 THEN 1.0 ELSE greatest(0.0, least(1.0,
             list_sum(list_transform(range(1, 101), lambda k: (CASE WHEN k % 2 = 1 THEN 2.0 ELSE -2.0 END) * exp(-2.0 * k * k * t2))))) END AS p
           FROM (SELECT feature, d * d * (n_base * n_current / (n_base + n_current)) AS t2 FROM ks))"""
# The exact p: weights of lattice paths that stay in the band, a step of the shorter sample at a time. ks is needed.
_EXACT = """
    kn AS (SELECT feature, d, least(n_base, n_current) AS n, greatest(n_base, n_current) AS m FROM ks),
    kb AS (SELECT *, n / (n + m) AS p, m / (n + m) AS q, d * n * m - 1e-9 * n * m AS bound FROM kn),
    band(feature, i, j, w) AS (
        SELECT feature, 0::BIGINT, j, pow(q, j) FROM kb, unnest(range(0, least(m, ceil(bound / n)::BIGINT - 1) + 1)) AS t(j)
        UNION ALL
        SELECT feature, i, j, pow(q, j - lo) * sum(p * w * pow(q, lo - j)) OVER (PARTITION BY feature ORDER BY j)
        FROM (SELECT c.feature, c.i, c.p, c.q, c.lo, c.j, coalesce(band.w, 0) AS w
              FROM (SELECT feature, i, p, q, lo, unnest(range(lo, hi + 1)) AS j
                    FROM (SELECT kb.feature, b.i, p, q, greatest(0, floor((b.i * m - bound) / n)::BIGINT + 1) AS lo, least(m, ceil((b.i * m + bound) / n)::BIGINT - 1) AS hi
                          FROM kb JOIN (SELECT feature, max(i) + 1 AS i FROM band GROUP BY feature) b USING (feature) WHERE b.i <= n)) c
              LEFT JOIN band ON band.feature = c.feature AND band.j = c.j)),
    pe AS (SELECT kb.feature, CASE WHEN d = 0 THEN 1.0 ELSE greatest(0.0, least(1.0, 1 - w / exp(lgamma(n + m + 1) - lgamma(n + 1) - lgamma(m + 1) + n * ln(p) + m * ln(q)))) END AS p
           FROM kb LEFT JOIN band ON band.feature = kb.feature AND i = n AND j = m)"""
_SEVERITY = "CASE WHEN psi < 0.1 THEN 'stable' WHEN psi < 0.2 THEN 'moderate' ELSE 'significant' END"
_REPORT = f"r AS (SELECT feature, psi, {_SEVERITY} AS severity, psi > 0.2 OR p < 0.05 AS drifted FROM psi JOIN pv USING (feature))"
_LOG = """
    lg AS (SELECT event_id AS id, (user_id % 7)::INT AS run_id, ts, value, (props->>'$.k')::INT AS k, (value > 15)::INT AS prediction, value / (value + 15) AS proba,
                  CASE WHEN event_id % 5 <> 0 THEN (props->>'$.k')::INT % 2 END AS actual_label FROM events),
    rc AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ts DESC, id DESC) AS rn FROM lg)"""
_SCORED = """
    sc AS (SELECT doc_id, quality AS label, round(1 - length(regexp_replace(text, '[^!#$%&*]', '', 'g')) / greatest(length(text), 1), 6) AS score FROM documents JOIN labels USING (doc_id)),
    sp AS (SELECT *, (score > 0.98)::INT AS predicted FROM sc)"""



def _draw(key: str, seed: str) -> str:
    return f"('0x' || substr(md5('{seed}:' || {key}), 1, 8))::BIGINT"


_STREAM = f"""
    li AS (SELECT l_orderkey * 8 + l_linenumber AS id, l_quantity::DOUBLE AS q, l_extendedprice::DOUBLE AS e, l_discount::DOUBLE AS d, l_tax::DOUBLE AS t, (l_returnflag = 'R')::INT AS y FROM lineitem),
    dr AS (SELECT *, {_draw("id", "baseline")} / 4294967296 < 0.6 AS base, ({_draw("id", "stream")} % 12)::INT + 1 AS batch, {_draw("id", "stream-flip")} / 4294967296 AS u FROM li),
    mo AS (SELECT avg(q) AS qm, stddev_pop(q) AS qs, avg(e) AS em, avg(d) AS dm, stddev_pop(d) AS ds FROM dr WHERE base),
    st AS (SELECT id, batch, CASE WHEN u < 0.04 * greatest(0, batch - 6) THEN 1 - y ELSE y END AS target, q + 0.28 * greatest(0, batch - 3) * qs AS l_quantity,
                  em + (e - em) * (1 + 0.35 * greatest(0, batch - 5)) AS l_extendedprice, d - 0.24 * greatest(0, batch - 7) * ds AS l_discount, t AS l_tax FROM dr, mo WHERE NOT base)"""

ORACLE_SQL = {
    "drift_bootstrap_rows": f"""WITH {_STREAM},
        p AS (SELECT *, row_number() OVER (ORDER BY {_draw("id", "bootstrap")}, id::VARCHAR, q, e, d, t, y) - 1 AS rank FROM dr WHERE NOT base), n AS (SELECT count(*) AS n FROM p),
        w AS (SELECT b::INT AS k, j AS draw, floor({_draw("b || ':' || j", "bootstrap-draw")} / 4294967296 * n)::BIGINT AS rank FROM range(1, 13) AS x(b), range(1, 501) AS z(j), n)
        SELECT k AS batch, draw, id, round(q, 4) AS l_quantity, round(e, 4) AS l_extendedprice, round(d, 4) AS l_discount, round(t, 4) AS l_tax, p.y AS target
        FROM w JOIN p USING (rank)""",
    "stratified_split": f"""
        WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY {_draw("doc_id", "42")}, doc_id::VARCHAR) AS r FROM labels),
        k AS (SELECT quality, count(*) AS n FROM labels GROUP BY quality), a AS (SELECT sum(n)::BIGINT AS n, (sum(n) - ceil(round(sum(n) * 0.2, 6)))::BIGINT AS t FROM k),
        p AS (SELECT quality, t * k.n / a.n AS quota, floor(t * k.n / a.n) AS least, t FROM k, a),
        o AS (SELECT *, t - sum(least) OVER () AS rest, row_number() OVER (ORDER BY round(quota - least, 9) DESC, quality) AS o FROM p),
        m AS (SELECT quality, least + CASE WHEN o <= rest THEN 1 ELSE 0 END AS take FROM o)
        SELECT doc_id, r.quality, (r <= take)::INT AS in_train FROM r JOIN m ON r.quality IS NOT DISTINCT FROM m.quality""",
    "drift_stream_rows": f"""WITH {_STREAM} SELECT id, batch, target, round(l_quantity, 4) AS l_quantity, round(l_extendedprice, 4) AS l_extendedprice, round(l_discount, 4) AS l_discount, round(l_tax, 4) AS l_tax FROM st""",
    "drift_stream_manifest": f"""WITH {_STREAM}, c AS (SELECT batch, count(*) AS rows FROM st GROUP BY batch),
        f AS (SELECT *, concat_ws(',', CASE WHEN batch >= 8 THEN 'l_discount=' || (batch - 7) END, CASE WHEN batch >= 6 THEN 'l_extendedprice=' || (batch - 5) END, CASE WHEN batch >= 4 THEN 'l_quantity=' || (batch - 3) END) AS drifting,
                     round(0.04 * greatest(0, batch - 6), 4)::DOUBLE AS p_flip FROM c)
        SELECT batch, rows, drifting, p_flip, drifting = '' AND p_flip = 0 AS clean FROM f""",
    "drift_decile_edges": f"""WITH {_EVENTS},
        q AS (SELECT feature, list_sort(list_distinct(quantile_cont(x, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e FROM s WHERE NOT cur GROUP BY feature)
        SELECT feature, (i - 1)::INT AS pos, round(e[i + 1], 6) AS edge FROM q, unnest(range(1, len(e) - 1)) AS t(i)""",
    "drift_psi": f"WITH {_EVENTS}, {_BINS} SELECT feature, round(psi, 6) AS psi FROM psi",
    "drift_psi_lines": f"WITH {_LINES}, {_BINS} SELECT feature, round(psi, 6) AS psi FROM psi",
    "drift_psi_bins": f"""WITH {_EVENTS}, {_BINS}
        SELECT feature, bin::INT AS bin, round(expected, 6) AS expected, round(actual, 6) AS actual, round((actual - expected) * ln(actual / expected), 6) AS contribution FROM f""",
    "drift_severity": f"WITH {_LINES}, {_BINS} SELECT feature, {_SEVERITY} AS severity FROM psi",
    "drift_ks_stat": f"WITH {_EVENTS}, {_KS} SELECT feature, n_base, n_current, round(d, 6) AS d FROM ks",
    "drift_ks_lines": f"WITH {_LINES}, {_KS} SELECT feature, n_base, n_current, round(d, 6) AS d FROM ks",
    "drift_ks_pvalue_asym": f"WITH {_EVENTS}, {_KS}, {_P} SELECT feature, round(p, 6) AS p_value FROM pv",
    "drift_feature_moments": f"""WITH {_EVENTS} SELECT feature, round(avg(x) FILTER (NOT cur), 6) AS base_mean, round(stddev_pop(x) FILTER (NOT cur), 6) AS base_std,
        round(avg(x) FILTER (cur), 6) AS current_mean, round(stddev_pop(x) FILTER (cur), 6) AS current_std FROM s GROUP BY feature""",
    "drift_report": f"""WITH RECURSIVE {_EVENTS}, {_BINS}, {_KS}, {_EXACT}
        SELECT feature, round(psi, 5) AS psi, {_SEVERITY} AS severity, round(d, 5) AS d, round(p, 6) AS p_value, psi > 0.2 OR p < 0.05 AS drift_detected
        FROM psi JOIN ks USING (feature) JOIN pe USING (feature)""",
    "drift_summary": f"""WITH {_EVENTS}, {_BINS}, {_KS}, {_P}, {_REPORT}
        SELECT count(*) AS n_checked, count(*) FILTER (severity = 'significant') AS n_significant, count(*) FILTER (drifted) AS n_drifted,
               coalesce(string_agg(feature, ',' ORDER BY feature) FILTER (severity = 'significant'), '') AS significant_features,
               round(count(*) FILTER (severity = 'significant') / count(*), 6) AS fraction, coalesce(bool_or(drifted), false) AS any_drift FROM r""",
    "drift_retrain_decision": f"""WITH {_EVENTS}, {_BINS}, {_KS}, {_P}, {_REPORT}, {_LOG},
        a AS (SELECT count(*) AS n_checked, count(*) FILTER (severity = 'significant') AS n_significant FROM r),
        b AS (SELECT count(actual_label) AS n_labelled FROM lg)
        SELECT n_checked, n_significant, round(n_significant / n_checked, 6) AS fraction,
               CASE WHEN n_significant / n_checked <= 0.3 THEN 'no_action' WHEN n_labelled < 60 THEN 'insufficient_labels' ELSE 'retrain' END AS decision, n_labelled,
               CASE WHEN n_significant / n_checked <= 0.3 THEN printf('No retrain: %d/%d features significant (fraction %.2f <= 0.30)', n_significant, n_checked, n_significant / n_checked)
                    WHEN n_labelled < 60 THEN printf('Drift threshold exceeded (fraction %.2f > 0.30) but only %d labelled rows available (need 60); retrain skipped', n_significant / n_checked, n_labelled)
                    ELSE printf('Auto-retrain: %d/%d features significantly drifted (fraction %.2f > threshold 0.30); retrained on %d recent production rows', n_significant, n_checked, n_significant / n_checked, n_labelled)
               END AS reason FROM a, b""",
    "feature_histogram": f"""WITH {_EVENTS},
        m AS (SELECT feature, min(x) AS lo, CASE WHEN max(x) > min(x) THEN max(x) ELSE min(x) + 1 END AS hi FROM s GROUP BY feature),
        w AS (SELECT feature, lo, (hi - lo) / 20 AS width FROM m),
        c AS (SELECT s.feature, least(floor((x - lo) / width), 19)::INT AS bin, count(*) FILTER (NOT cur) AS base, count(*) FILTER (cur) AS now FROM s JOIN w USING (feature) GROUP BY ALL)
        SELECT w.feature, b::INT AS bin, floor((lo + (b + 0.5) * width) * 10000 + 0.5) / 10000 AS center, coalesce(base, 0) AS base, coalesce(now, 0) AS now
        FROM w CROSS JOIN range(20) AS r(b) LEFT JOIN c ON c.feature = w.feature AND c.bin = b""",
    "drift_timeline": f"""WITH e AS (SELECT ts::DATE AS day, event_type, value FROM events),
        s AS (SELECT d::DATE::VARCHAR || '|' || event_type AS feature, value AS x, false AS cur FROM e, generate_series(DATE '2024-01-16', DATE '2024-01-30', INTERVAL 1 DAY) AS g(d) WHERE day < DATE '2024-01-16'
              UNION ALL SELECT day::VARCHAR || '|' || event_type, value, true FROM e WHERE day >= DATE '2024-01-16'), {_BINS}, {_KS}
        SELECT split_part(feature, '|', 1) AS day, split_part(feature, '|', 2) AS event_type,
               round(CASE WHEN n_current > 0 THEN psi ELSE 0 END, 6) AS psi, round(CASE WHEN n_base > 1 AND n_current > 1 THEN d ELSE 0 END, 6) AS d FROM psi JOIN ks USING (feature)""",
    "recent_window": f"WITH {_LOG} SELECT run_id, id, rn::INT AS rn, prediction FROM rc WHERE rn <= 300",
    "rolling_accuracy": f"WITH {_LOG} SELECT run_id, count(actual_label) AS n_labelled, round(avg((prediction = actual_label)::INT) FILTER (actual_label IS NOT NULL), 6) AS accuracy FROM rc WHERE rn <= 100 GROUP BY run_id",
    "positive_rate": f"WITH {_LOG} SELECT run_id, count(*) AS n, round(avg(prediction), 6) AS positive_rate FROM lg GROUP BY run_id",
    "prediction_listing": f"WITH {_LOG} SELECT id, run_id, prediction, round(proba, 6) AS proba FROM rc WHERE run_id = 3 AND rn <= 100",
    "coerce_features": f"WITH {_LOG} SELECT id, round(k::DOUBLE, 6) AS k, round(value, 6) AS value, 0.0::DOUBLE AS missing FROM lg",
    "experiment_runs": """
        WITH p AS (SELECT c_nationkey, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS runs FROM customer GROUP BY 1)
        SELECT n_nationkey, n_name, coalesce(runs, '') AS runs FROM nation LEFT JOIN p ON n_nationkey = c_nationkey""",
    "run_listing": """
        SELECT o_orderkey, c_name, strftime(o_orderdate, '%Y-%m-%d') AS created, round(o_totalprice, 2) AS total
        FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F'""",
    "entity_counts": f"WITH {_LOG} SELECT count(*) AS predictions, count(DISTINCT run_id) AS runs, count(actual_label) AS labelled, count(*) FILTER (prediction = 1) AS positive FROM lg",
    "classification_metrics": f"""WITH {_SCORED},
        c AS (SELECT count(*) FILTER (label = 1 AND predicted = 1) AS tp, count(*) FILTER (label = 0 AND predicted = 1) AS fp,
                     count(*) FILTER (label = 1 AND predicted = 0) AS fn, count(*) FILTER (label = 0 AND predicted = 0) AS tn FROM sp)
        SELECT tp, fp, fn, tn, round(coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0), 0), 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision,
               round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c""",
    "auc_ranksum": f"""WITH {_SCORED}, r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS r FROM sp),
        a AS (SELECT sum(r) FILTER (label = 1) AS s, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM r)
        SELECT round((s - p * (p + 1) / 2) / (p * n), 6) AS auc FROM a""",
}
