"""Tables by name, and the logs and traces that the domain queries derive from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.shipping import ship

#: Numeric columns of lineitem that drift is measured on.
LINE_FEATURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
DRIFT_CUT = "2024-01-16"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, v array<double>)."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))


def event_samples(spark: SparkSession, sf_dir: str, cut: str = DRIFT_CUT) -> DataFrame:
    """(feature, x, is_current): a feature per event type, the current sample from ``cut`` on."""
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("feature"), F.col("value").alias("x"), (F.col("ts") >= F.lit(cut).cast("timestamp_ntz")).alias("is_current"))


def line_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(feature, x, is_current): the numeric columns of lineitem in long form; returned lines are current."""
    lines = table(spark, sf_dir, "lineitem").select((F.col("l_returnflag") == "R").alias("is_current"), *LINE_FEATURES)
    return lines.unpivot("is_current", list(LINE_FEATURES), "feature", "x").select("feature", "x", "is_current")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prediction log: (id, run_id, ts, features map, prediction, proba, actual_label).

    The label is the parity of the number in ``props``; every fifth row is not labelled yet.
    """
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        (F.col("user_id") % 7).cast("int").alias("run_id"),
        "ts",
        F.create_map(F.lit("value"), F.col("value"), F.lit("k"), k.cast("double")).alias("features"),
        (F.col("value") > 15).cast("int").alias("prediction"),
        (F.col("value") / (F.col("value") + 15)).alias("proba"),
        F.when(F.col("event_id") % 5 != 0, k % 2).alias("actual_label"),
    )


def wal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A write-ahead log: (lsn, txn_id, op, key, value), four records a transaction.

    Every fifth transaction aborts, every seventh has no terminal record (its last record is a write).
    """
    e = table(spark, sf_dir, "events")
    txn = F.floor(F.col("event_id") / 4).cast("long") + 1
    last = F.col("event_id") % 4 == 3
    op = (
        F.when(last & (txn % 7 != 0), F.when(txn % 5 == 0, "ABORT").otherwise("COMMIT"))
        .when(F.col("event_type") == "error", "DELETE")
        .otherwise("PUT")
    )
    write = ~op.isin("COMMIT", "ABORT")
    return e.select(
        F.col("event_id").alias("lsn"),
        txn.alias("txn_id"),
        op.alias("op"),
        F.when(write, F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("key"),
        F.when(op == "PUT", F.format_string("%.2f", "value")).alias("value"),
    )


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A consensus trace: (seed, step, node_id, term, state, commit_index, log_length).

    One row an event: a seed has the events of a few users in time order, terms last a day, and the kind
    of event gives the state.
    """
    e = table(spark, sf_dir, "events")
    return e.select(
        (F.col("user_id") % 10).cast("int").alias("seed"),
        F.col("event_id").alias("step"),
        (F.col("user_id") % 50 / 10).cast("int").alias("node_id"),
        F.datediff("ts", F.lit("2024-01-01").cast("date")).alias("term"),
        F.when(F.col("event_type") == "purchase", "LEADER").when(F.col("event_type") == "click", "CANDIDATE").otherwise("FOLLOWER").alias("state"),
        F.get_json_object("props", "$.k").cast("int").alias("commit_index"),
        (F.get_json_object("props", "$.k").cast("int") + F.floor("value").cast("int") % 10).alias("log_length"),
    )
