"""Streams over a table's files: replay in micro-batches, and a count-based window kept as state."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sparkloom.shipping import shared_folder

STATE_ROWS = 300


def table_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """A Parquet table, a folder or one file, as a stream of ``files_per_batch`` files a micro-batch."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{path[:-1]}[{path[-1]}]")  # a pattern may name a file


def drain(stream: DataFrame, each: Callable[[DataFrame, int], None], mode: str = "append", name: str | None = None) -> None:
    """Run all that is available now. The checkpoint lies in the shared folder under ``name``, so a later call
    of that name takes only what is new; without one, each call starts anew."""
    at = f"{shared_folder(stream.sparkSession)}/stream-{name or uuid.uuid4().hex}"
    query = stream.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", at).trigger(availableNow=True).start()
    query.awaitTermination()


def replay(stream: DataFrame, summarise: Callable[[DataFrame], DataFrame], name: str | None = None) -> DataFrame:
    """``summarise`` of each micro-batch, appended to a table with its ``batch_id``. A batch that runs again
    replaces its own rows; batches of earlier calls of one ``name`` stay."""
    spark = stream.sparkSession
    at = f"{shared_folder(spark)}/replay-{name or uuid.uuid4().hex}"
    drain(stream, lambda df, k: summarise(df).write.mode("overwrite").parquet(f"{at}/batch_id={k}"), name=name)
    return spark.read.parquet(at)


def hourly(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Counts and sums per hour and event type of a stream of events, with a watermark; hours are complete
    once the watermark has passed, the last ones when the stream is drained."""
    spark = stream.sparkSession
    at = f"{shared_folder(spark)}/hourly-{uuid.uuid4().hex}"
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    counts = timed.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    flat = counts.select(F.col("window.start").alias("hour"), "event_type", "n", "total")
    drain(flat, lambda df, k: df.write.mode("overwrite").parquet(f"{at}/batch_id={k}"), mode="update")
    # an hour is updated in each batch that adds to it; its last update holds all
    rows = spark.read.parquet(at)
    return rows.groupBy("hour", "event_type").agg(F.max_by("n", "batch_id").alias("n"), F.max_by("total", "batch_id").alias("total"))


def count_window(stream: DataFrame, key: str, order: str, value: str, rows: int = STATE_ROWS) -> DataFrame:
    """(key, n, mean) over each key's newest ``rows`` rows: the state of a key holds that many (order, value)
    at most."""
    spark = stream.sparkSession
    at = f"{shared_folder(spark)}/window-{uuid.uuid4().hex}"

    def update(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        orders, values = state.get if state.exists else ([], [])
        held = list(zip(orders, values, strict=True))
        for frame in frames:
            held = sorted([*held, *zip(frame["o"].tolist(), frame["v"].tolist(), strict=True)])[-rows:]
        state.update(([o for o, _ in held], [v for _, v in held]))
        yield pd.DataFrame({"k": [k[0]], "n": [len(held)], "mean": [sum(v for _, v in held) / len(held)]})

    slim = stream.select(F.col(key).cast("long").alias("k"), F.col(order).cast("long").alias("o"), F.col(value).cast("double").alias("v"))
    out = slim.groupBy("k").applyInPandasWithState(update, "k long, n long, mean double", "orders array<long>, values array<double>", "update", GroupStateTimeout.NoTimeout)
    drain(out, lambda df, b: df.write.mode("overwrite").parquet(f"{at}/batch_id={b}"), mode="update")
    found = spark.read.parquet(at)
    return found.groupBy("k").agg(F.max_by("n", "batch_id").alias("n"), F.max_by("mean", "batch_id").alias("mean"))


def _newest(held: pd.DataFrame, rows: int) -> pd.DataFrame:
    return held.sort_values("o", kind="stable").tail(rows)


class _Window(StatefulProcessor):
    """The newest rows of a key as a list state of at most ``rows`` (order, names, values); what falls out of the
    window is evicted with each batch. Gives the window of every key that has new rows."""

    def __init__(self, rows: int) -> None:
        self.rows = rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("kept", "o long, names array<string>, xs array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame(list(self.kept.get()), columns=["o", "names", "xs"])
        for frame in rows:
            held = _newest(pd.concat((held, frame[["o", "names", "xs"]])) if len(held) else frame[["o", "names", "xs"]], self.rows)
        self.kept.put([(int(o), list(n), [None if pd.isna(x) else float(x) for x in v]) for o, n, v in held.itertuples(index=False)])
        yield held.assign(k=key[0])[["k", "o", "names", "xs"]]

    def close(self) -> None:
        pass


@contextmanager
def _state_store(spark: SparkSession):
    """A store that list states need, for the streams started within."""
    name, needed = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    had = spark.conf.get(name)
    spark.conf.set(name, needed)
    try:
        yield
    finally:
        spark.conf.set(name, had)


def newest_rows(stream: DataFrame, key: str, order: str, features: str, rows: int = STATE_ROWS, name: str | None = None) -> DataFrame:
    """(key, order, feature, x): the features (a map to numbers) of each key's newest ``rows`` rows of a stream, by
    ``order``. Tasks keep that many rows a key of a batch before the shuffle, so a hot key moves few. A later call of
    one ``name`` goes on with the windows as they were."""
    spark = stream.sparkSession
    at = f"{shared_folder(spark)}/newest-{name or uuid.uuid4().hex}"
    slim = stream.select(F.col(key).cast("long").alias("k"), F.col(order).cast("long").alias("o"), F.map_keys(features).alias("names"), F.map_values(features).cast("array<double>").alias("xs"))

    def first(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None
        for frame in frames:
            both = frame if kept is None else pd.concat((kept, frame))
            kept = both.sort_values(["k", "o"], kind="stable").groupby("k", dropna=False, sort=False).tail(rows)
        if kept is not None:
            yield kept

    schema = "k long, o long, names array<string>, xs array<double>"
    with _state_store(spark):
        windows = slim.where("k is not null and o is not null").mapInPandas(first, schema).groupBy("k").transformWithStateInPandas(_Window(rows), schema, "update", "None")
        drain(windows, lambda df, b: df.write.mode("overwrite").parquet(f"{at}/batch_id={b}"), mode="update", name=name and f"newest-{name}")
    found = spark.read.parquet(at)
    last = found.groupBy("k").agg(F.max("batch_id").alias("batch_id"))  # the newest window of a key is whole
    pairs = F.explode(F.arrays_zip("names", "xs")).alias("p")
    return found.join(last, ["k", "batch_id"]).select("k", "o", pairs).select(F.col("k").alias(key), F.col("o").alias(order), F.col("p.names").alias("feature"), F.col("p.xs").alias("x"))
