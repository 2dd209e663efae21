"""Queries that run as streams; their results equal those of the same computation on the whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import drift
from sparkloom.plans.drift_queries import _BINS, _KS, _LOG, _STREAM, _draw, baseline_lines, line_stream
from sparkloom.shipping import checkpoint, shared_folder, ship
from sparkloom.sources.catalog import DRIFT_CUT, predictions
from sparkloom.streaming import replay
from sparkloom.streaming.retrain import RetrainFlow


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.table_stream(ship(spark), f"{sf_dir}/events.parquet")


def stream_batch_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and mean values per event type, from partial sums of micro-batches."""
    parts = replay.replay(_events(spark, sf_dir), lambda df: df.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("s")))
    return parts.groupBy("event_type").agg(F.sum("n").alias("n"), F.round(F.sum("s") / F.sum("n"), 6).alias("mean"))


def stream_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = replay.hourly(_events(spark, sf_dir))
    return h.select(F.date_format("hour", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))


def stream_count_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean value of each run's newest 300 events by id."""
    s = _events(spark, sf_dir).withColumn("run_id", F.col("user_id") % 7)
    w = replay.count_window(s, "run_id", "event_id", "value")
    return w.select(F.col("k").alias("run_id"), "n", F.round("mean", 6).alias("mean"))


def stream_count_window_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PSI and D of each run's newest 300 predictions, kept as state of a stream, against all before the cut."""
    log = predictions(spark, sf_dir)
    of_run = F.concat_ws("|", F.col("run_id").cast("string"), "feature")
    k = F.get_json_object("props", "$.k").cast("double")
    s = _events(spark, sf_dir).select((F.col("user_id") % 7).alias("run_id"), F.col("event_id").alias("id"), F.create_map(F.lit("value"), F.col("value"), F.lit("k"), k).alias("features"))
    now = replay.newest_rows(s, "run_id", "id", "features").select(of_run.alias("feature"), "x", F.lit(True).alias("is_current"))
    was = log.where(F.col("ts") < F.lit(DRIFT_CUT).cast("timestamp_ntz")).select("run_id", F.explode("features").alias("feature", "x"))
    samples = checkpoint(was.select(of_run.alias("feature"), "x", F.lit(False).alias("is_current")).unionByName(now))
    return drift.psi(samples).join(drift.ks(samples), "feature").select("feature", "n_base", "n_current", F.round("psi", 6).alias("psi"), F.round("d", 6).alias("d"))


def stream_retrain_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit rows of a drifting stream of lines that is scored, checked every third batch, and switched to a new
    model at the first check that asks for one."""
    folder = f"{shared_folder(ship(spark))}/retrain-{uuid.uuid4().hex}"
    flow = RetrainFlow(spark, folder, "id", "target", settings={"maxIter": 20})
    flow.start(baseline_lines(spark, sf_dir))
    line_stream(spark, sf_dir).write.partitionBy("batch").parquet(f"{folder}/due")
    rows = spark.read.parquet(f"{folder}/due")
    batches = [r["batch"] for r in rows.select("batch").distinct().orderBy("batch").collect()]  # at most 12
    for b in batches:  # batches arrive one after another
        rows.where(F.col("batch") == b).drop("batch").write.parquet(f"{folder}/arrived/batch={b}")
        arrived = spark.readStream.schema(rows.drop("batch").schema).parquet(f"{folder}/arrived/*")
        flow.run(arrived, f"retrain-{folder[-32:]}")
    told = flow.events()
    return told.select((F.col("batch_id") + 1).cast("int").alias("batch"), "decision", "reason", "n_checked", "n_significant", F.round("fraction", 6).alias("fraction"), "n_labelled")


QUERIES = {f.__name__: f for f in (stream_batch_replay, stream_hourly, stream_count_window, stream_count_window_drift, stream_retrain_policy)}

ORACLE_SQL = {
    "stream_batch_replay": "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1",
    "stream_hourly": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "stream_count_window": """
        WITH r AS (SELECT user_id % 7 AS run_id, value, row_number() OVER (PARTITION BY user_id % 7 ORDER BY event_id DESC) AS r FROM events)
        SELECT run_id, count(*) AS n, round(avg(value), 6) AS mean FROM r WHERE r <= 300 GROUP BY run_id""",
    "stream_count_window_drift": f"""
        WITH {_LOG},
        u AS (SELECT run_id, ts, rn, unnest(['value', 'k']) AS f, unnest([value, k::DOUBLE]) AS x FROM (SELECT * EXCLUDE (rn), row_number() OVER (PARTITION BY run_id ORDER BY id DESC) AS rn FROM rc)),
        s AS (SELECT run_id || '|' || f AS feature, x, false AS cur FROM u WHERE ts < TIMESTAMP '{DRIFT_CUT}' UNION ALL SELECT run_id || '|' || f, x, true FROM u WHERE rn <= 300), {_BINS}, {_KS}
        SELECT feature, n_base, n_current, round(psi, 6) AS psi, round(d, 6) AS d FROM psi JOIN ks USING (feature)""",
    "stream_retrain_policy": f"""
        WITH {_STREAM},
        r AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY {_draw("id", "42")}, id::VARCHAR) AS r FROM dr WHERE base),
        k AS (SELECT y, count(*) AS n FROM r GROUP BY y), a AS (SELECT sum(n)::BIGINT AS n, (sum(n) - ceil(round(sum(n) * 0.2, 6)))::BIGINT AS t FROM k),
        qu AS (SELECT y, t * k.n / a.n AS quota, floor(t * k.n / a.n) AS least, t FROM k, a),
        o AS (SELECT *, t - sum(least) OVER () AS rest, row_number() OVER (ORDER BY round(quota - least, 9) DESC, y) AS o FROM qu),
        tr AS (SELECT r.* FROM r JOIN o USING (y) WHERE r <= least + CASE WHEN o <= rest THEN 1 ELSE 0 END),
        ck AS (SELECT unnest([3, 6, 9, 12]) AS b),
        wi AS (SELECT b, st.*, row_number() OVER (PARTITION BY b ORDER BY batch DESC, id DESC) AS rn FROM st JOIN ck ON batch <= b),
        s AS (SELECT b || '|' || f AS feature, x, false AS cur FROM (SELECT b, unnest(['q', 'e', 'd', 't']) AS f, unnest([q, e, d, t]) AS x FROM tr, ck)
              UNION ALL SELECT b || '|' || f, x, true FROM (SELECT b, unnest(['q', 'e', 'd', 't']) AS f, unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS x FROM wi WHERE rn <= 300)), {_BINS},
        c2 AS (SELECT split_part(feature, '|', 1)::INT AS batch, count(*) AS n_checked, count(*) FILTER (psi >= 0.2) AS n_significant FROM psi GROUP BY 1),
        n2 AS (SELECT b AS batch, least(count(*), 300) AS n_labelled FROM wi GROUP BY b),
        f2 AS (SELECT *, n_significant / n_checked AS fraction FROM c2 JOIN n2 USING (batch)),
        d2 AS (SELECT *, CASE WHEN fraction <= 0.3 THEN 'no_action' WHEN n_labelled < 60 THEN 'insufficient_labels' ELSE 'retrain' END AS decision FROM f2)
        SELECT batch, decision, n_checked, n_significant, round(fraction, 6) AS fraction, n_labelled,
               CASE decision WHEN 'no_action' THEN printf('No retrain: %d/%d features significant (fraction %.2f <= 0.30)', n_significant, n_checked, fraction)
                    WHEN 'insufficient_labels' THEN printf('Drift threshold exceeded (fraction %.2f > 0.30) but only %d labelled rows available (need 60); retrain skipped', fraction, n_labelled)
                    ELSE printf('Auto-retrain: %d/%d features significantly drifted (fraction %.2f > threshold 0.30); retrained on %d recent production rows', n_significant, n_checked, fraction, n_labelled) END AS reason
        FROM d2 WHERE batch <= coalesce((SELECT min(batch) FROM d2 WHERE decision = 'retrain'), 99)""",
}
