"""Training, scoring and keeping of models for tables of numbers: pyspark.ml pipelines chosen by name."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.operators import metrics
from sparkloom.shipping import checkpoint

#: Names under which a target is looked for, in this order (fixed values).
TARGET_NAMES = ("target", "label", "y", "Churn", "default")

#: Estimators by name, with the settings they have unless told otherwise; of a penalty C = 1 each of n rows has 1 / n,
#: which :func:`train` sets.
ESTIMATORS: dict[str, tuple[Callable[..., Estimator], dict[str, Any]]] = {
    "logistic_regression": (LogisticRegression, {"maxIter": 1000}),
    "random_forest": (RandomForestClassifier, {"numTrees": 200, "maxDepth": 30, "seed": 42}),
}


def detect_target(df: DataFrame) -> str:
    """The first of TARGET_NAMES that is a column, else the last column."""
    return next((c for c in TARGET_NAMES if c in df.columns), df.columns[-1])


def numeric_features(df: DataFrame, target: str) -> list[str]:
    """Columns of a numeric type, in order, without the target."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name != target]


def build(features: list[str], target: str, model_type: str, settings: dict[str, Any] | None = None) -> Pipeline:
    """Assembler, scaler and the estimator named ``model_type``."""
    if model_type not in ESTIMATORS:
        raise ValueError(f"unknown model type {model_type!r}; known: {', '.join(sorted(ESTIMATORS))}")
    make, usual = ESTIMATORS[model_type]
    last = make(labelCol=target, featuresCol="scaled_", **(usual | (settings or {})))
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="raw_"), StandardScaler(inputCol="raw_", outputCol="scaled_", withMean=True), last])


def coerced(df: DataFrame, features: list[str]) -> DataFrame:
    """The features as numbers, 0 where missing, null or no number; columns that lack are added."""
    have = {c: F.coalesce(F.col(f"`{c}`").try_cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0) for c in features}
    return df.withColumns(have)


@dataclass
class Trained:
    model: PipelineModel
    features: list[str]
    target: str
    metrics: DataFrame
    #: The rows that the model was fitted on; not kept with a saved model.
    rows: DataFrame | None = None


def train(df: DataFrame, id_col: str, target: str | None = None, features: list[str] | None = None, model_type: str = "logistic_regression", settings: dict[str, Any] | None = None, test_share: float = 0.2) -> Trained:
    """Fit on the larger side of a split by class, measure on the other. The target and the features are
    inferred unless given; rows without a label are left out."""
    target = target or detect_target(df)
    features = features or [c for c in numeric_features(df, target) if c != id_col]
    rows = coerced(df.where(F.col(target).isNotNull()).withColumn(target, F.col(target).cast("int")), features)
    if not features:
        raise ValueError("no numeric feature columns")
    # kept, since fitting, measuring and whoever keeps the rows read it again
    split = checkpoint(metrics.stratified_split(rows, target, id_col, 1 - test_share))
    fitted = split.where("in_train").drop("in_train")
    usual = {"regParam": 1 / max(1, fitted.count())} if model_type == "logistic_regression" else {}
    model = build(features, target, model_type, usual | (settings or {})).fit(fitted)
    scored = predict(model, split.where("not in_train"), features).select(F.col(target).alias("label"), F.col("prediction").cast("int").alias("predicted"), F.col("probability").alias("score"))
    scored = checkpoint(scored)
    measured = metrics.classification(scored).crossJoin(F.broadcast(metrics.auc(scored)))  # one row each
    return Trained(model, features, target, checkpoint(measured), fitted)


def predict(model: PipelineModel, df: DataFrame, features: list[str]) -> DataFrame:
    """``df`` with ``prediction`` and ``probability`` (of class 1)."""
    scored = model.transform(coerced(df.drop("prediction", "probability"), features))
    return scored.select(*[F.col(f"`{c}`") for c in df.columns if c not in ("prediction", "probability")], F.col("prediction").cast("int").alias("prediction"), vector_to_array("probability")[1].alias("probability"))


def predict_and_log(model: PipelineModel, df: DataFrame, features: list[str], id_col: str, run_id: int, log: str, label: str | None = None, batch_id: int | None = None) -> DataFrame:
    """Predictions of ``df`` in the Parquet log at ``log`` as (id, run_id, ts, features, prediction, proba,
    actual_label); returns the rows that were written.

    Features that are missing, null or no numbers are scored as 0 and logged as null. ``label`` names the column of
    true labels, if they are known. Rows are appended in a folder of their own: that of ``batch_id``, which a repeated
    call replaces, or a new one.
    """
    have = [F.lit(c) if k == 0 else (F.col(f"`{c}`").try_cast("double") if c in df.columns else F.lit(None).cast("double")) for c in features for k in (0, 1)]
    actual = F.col(f"`{label}`").cast("int") if label else F.lit(None).cast("int")
    told = df.withColumns({"features_": F.create_map(*have), "actual_": actual})
    rows = predict(model, told, features).select(
        F.col(f"`{id_col}`").alias("id"), F.lit(run_id).alias("run_id"), F.current_timestamp().alias("ts"), F.col("features_").alias("features"),
        "prediction", F.col("probability").alias("proba"), F.col("actual_").alias("actual_label"),
    )
    part = f"{log}/batch_id={batch_id if batch_id is not None else time.time_ns()}"
    rows.write.mode("overwrite").parquet(part)
    return df.sparkSession.read.parquet(part)


def payload_rows(spark: SparkSession, payload: dict) -> DataFrame:
    """Rows to score from a request: one feature object, one under ``features``, a list under ``features``, or a
    list under ``records``; with ``actual_labels``, one label a row. All values are strings, which scoring coerces."""
    wanted = payload.get("features", payload.get("records", payload))
    rows = wanted if isinstance(wanted, list) else [wanted]
    if not rows or not all(isinstance(r, dict) for r in rows):
        raise ValueError("no feature rows supplied")
    labels = payload.get("actual_labels")
    if labels is not None and len(labels) != len(rows):
        raise ValueError("actual_labels length must match number of rows")
    names = sorted({c for r in rows for c in r if c != "actual_labels" or "features" in payload or "records" in payload})
    schema = T.StructType([T.StructField("id", T.LongType()), *(T.StructField(c, T.StringType()) for c in names if c != "id"), T.StructField("actual_label", T.IntegerType())])
    data = [(i, *(None if r.get(c) is None else str(r[c]) for c in names if c != "id"), None if labels is None else labels[i]) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, schema)


RUN = "status string, notes string, model_name string, model_type string, settings string, features array<string>, target string, metrics map<string,double>, n_training_rows long, seconds double"


def run_training(
    df: DataFrame, id_col: str, folder: str, run_id: int, model_name: str = "model", model_type: str = "logistic_regression", settings: dict[str, Any] | None = None,
    target: str | None = None, features: list[str] | None = None, notes: str | None = None, test_share: float = 0.2,
) -> Trained:
    """:func:`train`, kept under ``folder``: a row in ``runs`` (RUN), the model, and a snapshot of the rows that it was
    fitted on. A run that fails leaves a row of status ``failed`` with the error, and the error is raised. A repeated
    ``run_id`` replaces what it had."""
    spark = df.sparkSession

    def record(status: str, told: str | None, trained: Trained | None, n: int | None, seconds: float | None) -> None:
        m = trained.metrics.first().asDict() if trained else {}
        row = (status, told, model_name, model_type, json.dumps(settings or {}), trained.features if trained else features, trained.target if trained else target, {k: None if v is None else float(v) for k, v in m.items()}, n, seconds)
        spark.createDataFrame([row], RUN).coalesce(1).write.mode("overwrite").parquet(f"{folder}/runs/run_id={run_id}")

    start = time.perf_counter()
    try:
        trained = train(df, id_col, target, features, model_type, settings, test_share)
        save(trained, f"{folder}/models/{run_id}")
        trained.rows.select(*[F.col(f"`{c}`") for c in trained.features]).write.mode("overwrite").parquet(f"{folder}/snapshots/run_id={run_id}")
        n = spark.read.parquet(f"{folder}/snapshots/run_id={run_id}").count()
        record("completed", notes, trained, n, time.perf_counter() - start)
    except Exception as e:
        record("failed", f"{notes or ''}\nERROR: {e}".strip(), None, None, None)
        raise
    return trained


def save(trained: Trained, path: str) -> None:
    """The model, and what is needed to use it, in one folder; an earlier one is replaced."""
    spark = trained.metrics.sparkSession
    trained.model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(trained.features, trained.target)], "features array<string>, target string").coalesce(1).write.mode("overwrite").json(f"{path}/about")
    trained.metrics.coalesce(1).write.mode("overwrite").json(f"{path}/metrics")


def load(spark: SparkSession, path: str) -> Trained:
    about = spark.read.schema("features array<string>, target string").json(f"{path}/about").first()
    return Trained(PipelineModel.load(f"{path}/model"), list(about["features"]), about["target"], spark.read.json(f"{path}/metrics"))
