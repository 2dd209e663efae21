"""Sources, sinks and artifacts: tables that are written, read back and compared with what they were."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import drift_stream, graph_index, models
from sparkloom.plans.drift_queries import _STREAM, LINE_SHIFTS, ORACLE_SQL as _DRIFT, _draw, baseline_lines, line_stream
from sparkloom.plans.log_queries import _WAL
from sparkloom.plans.vector_queries import _COSINE, _TOPK, K, _queries, _rounded
from sparkloom.shipping import shared_folder
from sparkloom.sources import files
from sparkloom.sources.catalog import LINE_FEATURES, table, vectors, wal


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/kept-{uuid.uuid4().hex}"


def load_by_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as Parquet, JSON lines, CSV and text, each loaded by its suffix."""
    s, at = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.col("s_acctbal").cast("double").alias("s_acctbal")), _folder(spark)
    s.write.parquet(f"{at}/s.parquet")
    s.write.json(f"{at}/s.json")
    s.write.csv(f"{at}/s.csv", header=True)
    s.select(F.concat_ws("|", "s_suppkey", "s_name", "s_acctbal").alias("value")).write.text(f"{at}/s.txt")
    parts = F.split("value", r"\|")
    text = files.load(spark, f"{at}/s.txt").select(parts[0].alias("s_suppkey"), parts[1].alias("s_name"), parts[2].alias("s_acctbal"))
    out = None
    for kind, df in (("parquet", files.load(spark, f"{at}/s.parquet")), ("json", files.load(spark, f"{at}/s.json")), ("csv", files.load(spark, f"{at}/s.csv")), ("txt", text)):
        rows = df.select(F.lit(kind).alias("kind"), F.col("s_suppkey").cast("long").alias("s_suppkey"), "s_name", F.round(F.col("s_acctbal").cast("double"), 2).alias("s_acctbal"))
        out = rows if out is None else out.unionByName(rows)
    return out


def base_table_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts with spelt-out names, kept as CSV in snake case; the second call reads what the first kept."""
    p, at = table(spark, sf_dir, "part"), _folder(spark)
    p.select(F.col("p_partkey").alias("Part Key"), F.col("p_size").alias("the-Size")).write.csv(f"{at}/raw.csv", header=True)
    files.base_table(spark, f"{at}/raw.csv", f"{at}/kept.csv")
    kept = files.base_table(spark, f"{at}/raw.csv", f"{at}/kept.csv")
    return kept.select(F.col("part_key").cast("long").alias("part_key"), F.col("the_size").cast("long").alias("the_size"))


def csv_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drifting stream as CSV files a batch, by their names and by their rows."""
    at = _folder(spark)
    files.save_batches(line_stream(spark, sf_dir), at)
    rows = spark.read.csv(at, header=True, inferSchema=True).groupBy("batch").agg(F.count("*").alias("rows"), F.round(F.sum("l_tax"), 4).alias("tax"))
    return rows.join(files.batch_names(spark, at).where("n_files > 0").select("batch"), "batch").select(F.col("batch").cast("int").alias("batch"), "rows", "tax")


def manifest_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _folder(spark)
    files.save_manifest(drift_stream.manifest(line_stream(spark, sf_dir), LINE_SHIFTS), f"{at}/manifest.json")
    return files.load(spark, f"{at}/manifest.json", "batch int, rows long, drifting string, p_flip double, clean boolean")


def npy_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as .npy files and back; numbers are places by vec_id."""
    at = _folder(spark)
    files.save_npy(vectors(spark, sf_dir), f"{at}/v.npy")
    return files.load(spark, f"{at}/v.npy").select("vec_id", F.size("v").alias("dim"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


def saved_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph index saved, loaded, and searched as widely as it takes to reach every node."""
    c, at = vectors(spark, sf_dir), _folder(spark)
    graph_index.save(graph_index.build(c), at)
    return _rounded(graph_index.search(graph_index.load(spark, at), _queries(c), K, ef=2 * graph_index.PIECE_ROWS))


def wal_append_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log appended in two parts as JSON lines, and scanned."""
    log, at = wal(spark, sf_dir), _folder(spark)
    for k in (0, 1):
        files.append_log(log.where(F.col("lsn") % 2 == k), at)
    return files.scan_log(spark, at).select("lsn", "txn_id", "op", "key", "value")


def numeric_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What training would take for features of each table with numbers, and for its target."""
    out = None
    for name in ("customer", "supplier", "part", "lineitem", "labels"):
        df = table(spark, sf_dir, name)
        target = models.detect_target(df)
        rows = df.groupBy().agg(F.count("*").alias("rows")).select(F.lit(name).alias("of_table"), F.lit(target).alias("target"), F.lit(",".join(models.numeric_features(df, target))).alias("features"), "rows")
        out = rows if out is None else out.unionByName(rows)
    return out


def training_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of a run that ends well and of one that fails, and the sizes of the snapshot and the test side."""
    at, lines = _folder(spark), baseline_lines(spark, sf_dir)
    models.run_training(lines, "id", at, 1, settings={"maxIter": 5}, target="target", notes="first")
    try:
        models.run_training(lines.select("id", "target"), "id", at, 2, target="target", notes="no features")
    except ValueError:
        pass
    rows = spark.read.parquet(f"{at}/runs")
    snapshot = spark.read.parquet(f"{at}/snapshots").groupBy("run_id").agg(F.count("*").alias("kept"))
    m = F.col("metrics")
    tested = (m["tp"] + m["fp"] + m["fn"] + m["tn"]).cast("long")
    return rows.join(snapshot, "run_id", "left").select(F.col("run_id").cast("int").alias("run_id"), "status", F.split("notes", "\n")[0].alias("notes"), F.array_join("features", ",").alias("features"), "n_training_rows", "kept", tested.alias("tested"), (m["tp"] + m["fn"]).cast("long").alias("tested_positive"))


def scored_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What scoring logs of lines of which some lack a feature: the features, null where missing, and labels. The
    kept model and the one in memory agree."""
    at, lines = _folder(spark), baseline_lines(spark, sf_dir)
    t = models.train(lines, "id", settings={"maxIter": 5}, target="target")
    models.save(t, f"{at}/model")
    again = models.load(spark, f"{at}/model")
    odd = lines.withColumn("l_tax", F.when(F.col("id") % 3 > 0, F.col("l_tax").cast("string")).otherwise("none")).drop("l_discount")
    log = models.predict_and_log(again.model, odd, again.features, "id", 5, f"{at}/log", "target", 0)
    same = models.predict(t.model, odd, t.features).select(F.col("id").alias("i"), F.col("prediction").alias("p"), F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("e"))
    differ = log.join(same, (F.col("id") == F.col("i")) & (F.col("features")["l_quantity"] == F.col("q")) & (F.col("features")["l_extendedprice"] == F.col("e"))).where("prediction <> p").count()
    f = F.col("features")
    told = log.groupBy("run_id", "actual_label").agg(F.count("*").alias("n"), F.count(f["l_tax"]).alias("n_tax"), F.count(f["l_discount"]).alias("n_discount"), F.round(F.sum(f["l_tax"]), 4).alias("tax"), F.count_if(F.col("proba").between(0, 1)).alias("n_proba"))
    return told.withColumn("differ", F.lit(differ).cast("long"))


QUERIES = {
    f.__name__: f
    for f in (load_by_suffix, base_table_names, csv_batches, manifest_json, npy_round_trip, saved_index_search, wal_append_scan, numeric_features, training_runs, scored_log)
}

_NUMBERS = "('TINYINT', 'SMALLINT', 'INTEGER', 'BIGINT', 'FLOAT', 'DOUBLE')"


def _features(name: str) -> str:
    last = f"(SELECT column_name FROM (DESCRIBE {name}) LIMIT 1 OFFSET (SELECT count(*) - 1 FROM (DESCRIBE {name})))"
    return f"""SELECT '{name}' AS of_table, {last} AS target, coalesce((SELECT string_agg(column_name, ',') FROM (DESCRIBE {name}) WHERE (column_type IN {_NUMBERS} OR column_type LIKE 'DECIMAL%') AND column_name <> {last}), '') AS features,
        (SELECT count(*) FROM {name}) AS rows"""


ORACLE_SQL = {
    "load_by_suffix": "SELECT kind, s_suppkey::BIGINT AS s_suppkey, s_name, round(s_acctbal::DOUBLE, 2) AS s_acctbal FROM supplier, (SELECT unnest(['parquet', 'json', 'csv', 'txt']) AS kind)",
    "base_table_names": "SELECT p_partkey::BIGINT AS part_key, p_size::BIGINT AS the_size FROM part",
    "csv_batches": f"WITH {_STREAM} SELECT batch, count(*) AS rows, round(sum(l_tax), 4) AS tax FROM st GROUP BY batch",
    "manifest_json": _DRIFT["drift_stream_manifest"],
    "npy_round_trip": "SELECT row_number() OVER (ORDER BY vec_id) - 1 AS vec_id, len(embedding)::INT AS dim, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings",
    "saved_index_search": _TOPK.format(distance=_COSINE),
    "wal_append_scan": f"WITH {_WAL} SELECT * FROM w",
    "numeric_features": " UNION ALL ".join(map(_features, ("customer", "supplier", "part", "lineitem", "labels"))),
    "training_runs": f"""
        WITH {_STREAM},
        r AS (SELECT y, {{'k': {_draw("id", "42")}, 'i': id::VARCHAR}} AS place, row_number() OVER (PARTITION BY y ORDER BY {_draw("id", "42")}, id::VARCHAR) AS r FROM dr WHERE base),
        k AS (SELECT y, count(*) AS n FROM r GROUP BY y), a AS (SELECT sum(n)::BIGINT AS n, (sum(n) - ceil(round(sum(n) * 0.2, 6)))::BIGINT AS t FROM k),
        qu AS (SELECT y, t * k.n / a.n AS quota, floor(t * k.n / a.n) AS least, t FROM k, a),
        o AS (SELECT *, least + CASE WHEN row_number() OVER (ORDER BY round(quota - least, 9) DESC, y) <= t - sum(least) OVER () THEN 1 ELSE 0 END AS take FROM qu),
        bd AS (SELECT y, max(place) AS bound FROM r JOIN o USING (y) WHERE r <= take GROUP BY y),
        tr AS (SELECT y, place <= bound AS train FROM r JOIN bd USING (y))
        SELECT 1 AS run_id, 'completed' AS status, 'first' AS notes, '{",".join(LINE_FEATURES)}' AS features, count(*) FILTER (train) AS n_training_rows, count(*) FILTER (train) AS kept,
               count(*) FILTER (NOT train) AS tested, count(*) FILTER (NOT train AND y = 1) AS tested_positive FROM tr
        UNION ALL SELECT 2, 'failed', 'no features', NULL, NULL, NULL, NULL, NULL""",
    "scored_log": f"""WITH {_STREAM} SELECT 5 AS run_id, y AS actual_label, count(*) AS n, count(*) FILTER (id % 3 > 0) AS n_tax, 0::BIGINT AS n_discount,
        round(sum(t) FILTER (id % 3 > 0), 4) AS tax, count(*) AS n_proba, 0::BIGINT AS differ FROM dr WHERE base GROUP BY y""",
}
