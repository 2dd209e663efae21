"""Scoring, drift checks and retraining as one stream with an audit table.

Each micro-batch is scored with the model in charge and logged. At every few batches the newest logged rows are compared
with the rows that this model was fitted on; above the policy's share of significant features, and with enough labels,
a new model is fitted on those rows and takes over from the next batch on.

What a batch writes lies in folders of its number: ``log``, ``reports``, and last ``events``, the audit row that ends a
check. Which model is in charge follows from the events of earlier batches alone. So a batch that was killed half-way
runs again from the start, replaces what it wrote, and nothing is logged or decided twice.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import drift, metrics, models
from sparkloom.shipping import checkpoint
from sparkloom.streaming.replay import drain

EVENT = "run_id long, triggered_by string, decision string, reason string, n_checked long, n_significant long, fraction double, n_labelled long, new_run_id long"


@dataclass(frozen=True)
class Policy:
    """A check after every ``every`` batches; with ``once`` none after the first retraining."""

    window: int = metrics.WINDOW
    every: int = 3
    fraction: float = drift.RETRAIN_FRACTION
    rows: int = drift.RETRAIN_ROWS
    once: bool = True


@dataclass
class RetrainFlow:
    """A flow kept under ``folder``, whose first model is run 0 there (see :func:`models.run_training`)."""

    spark: SparkSession
    folder: str
    id_col: str
    label: str
    policy: Policy = field(default_factory=Policy)
    model_type: str = "logistic_regression"
    settings: dict[str, Any] | None = None
    _loaded: dict[int, models.Trained] = field(default_factory=dict)

    def start(self, baseline: DataFrame, features: list[str] | None = None) -> None:
        models.run_training(baseline, self.id_col, self.folder, 0, model_type=self.model_type, settings=self.settings, target=self.label, features=features, notes="first run")

    def run(self, stream: DataFrame, name: str) -> None:
        """Take what is new in ``stream``; a later call of one ``name`` goes on."""
        drain(stream, self.each, name=name)

    def _table(self, kind: str) -> DataFrame | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{kind}")
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.option("basePath", f"{self.folder}/{kind}").parquet(f"{self.folder}/{kind}") if there else None

    def events(self) -> DataFrame:
        """The audit rows, with ``batch_id``."""
        found = self._table("events")
        return found if found is not None else self.spark.createDataFrame([], EVENT + ", batch_id int")

    def log(self) -> DataFrame:
        return self._table("log")

    def in_charge(self, batch_id: int) -> int:
        """The run that scores a batch: the newest one that an earlier batch trained."""
        row = self.events().where((F.col("batch_id") < batch_id) & F.col("new_run_id").isNotNull()).agg(F.max_by("new_run_id", "batch_id")).first()
        return row[0] or 0

    def each(self, batch: DataFrame, batch_id: int) -> None:
        run = self.in_charge(batch_id)
        if run not in self._loaded:
            self._loaded = {run: models.load(self.spark, f"{self.folder}/models/{run}")}
        trained = self._loaded[run]
        models.predict_and_log(trained.model, batch, trained.features, self.id_col, run, f"{self.folder}/log", self.label, batch_id)
        if (batch_id + 1) % self.policy.every == 0 and not (self.policy.once and run):
            self.check(run, trained, batch_id)

    def window(self, run: int, batch_id: int) -> DataFrame:
        """The newest rows that ``run`` scored, by batch, then id. Older batches are read only where newer ones
        have too few."""
        back = 1
        while True:
            rows = self.log().where((F.col("run_id") == run) & (F.col("batch_id") <= batch_id) & (F.col("batch_id") > batch_id - back))
            newest = checkpoint(rows.orderBy(F.col("batch_id").desc(), F.col("id").desc()).limit(self.policy.window))
            if back > batch_id or newest.count() == self.policy.window:
                return newest
            back *= 2

    def check(self, run: int, trained: models.Trained, batch_id: int) -> None:
        rows, features = self.window(run, batch_id), trained.features
        snapshot = self.spark.read.parquet(f"{self.folder}/snapshots/run_id={run}")
        was = snapshot.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in features]).unpivot([], features, "feature", "x").withColumn("is_current", F.lit(False))
        now = rows.select(F.explode("features").alias("feature", "x")).withColumn("is_current", F.lit(True))
        report = checkpoint(drift.report(was.unionByName(now)))
        report.write.mode("overwrite").parquet(f"{self.folder}/reports/batch_id={batch_id}")
        labelled = rows.where("actual_label is not null")
        n = labelled.count()
        told = drift.retrain_decision(drift.summary(report), n, self.policy.fraction, self.policy.rows).first()
        new_run = None
        if told["decision"] == "retrain":
            new_run = batch_id + 1
            wide = labelled.select(F.col("id").alias(self.id_col), *[F.col("features")[c].alias(c) for c in features], F.col("actual_label").alias(self.label))
            models.run_training(wide, self.id_col, self.folder, new_run, model_type=self.model_type, settings=self.settings, target=self.label, features=features, notes=f"drift-triggered retrain of run {run}")
        row = (run, "drift_monitor", told["decision"], told["reason"], told["n_checked"], told["n_significant"], told["fraction"], n, new_run)
        self.spark.createDataFrame([row], EVENT).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/events/batch_id={batch_id}")
