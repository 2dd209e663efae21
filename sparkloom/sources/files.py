"""Sources and sinks: tables by suffix, file trees with hidden names, vector files, indexes, log lines."""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions.text import snake_name

#: Rows of a written .npy file.
NPY_ROWS = 65_536
LOG_SCHEMA = "txn_id long, op string, key string, value string"


def load(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """By suffix: .parquet, .json, .txt, .npy, else CSV with a header. A missing path is an error."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    kind = Path(path.rstrip("/")).suffix
    if kind == ".parquet":
        return reader.parquet(path)
    if kind == ".json":
        return reader.json(path)
    if kind == ".txt":
        return reader.text(path)
    if kind == ".npy":
        return load_npy(spark, path)
    return reader.csv(path, header=True, inferSchema=schema is None)


def load_npy(spark: SparkSession, path: str) -> DataFrame:
    """(vec_id, v) of .npy files of two dimensions (or one vector each); ids are row numbers, by file name
    order. Files are read whole by Spark's binary source, one task a file."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io

        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                m = np.atleast_2d(np.load(io.BytesIO(content), allow_pickle=False)).astype(np.float64)
                for at in range(0, len(m), 4096):
                    part = m[at : at + 4096]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(range(at, at + len(part)), pa.int64()), pa.array(list(part), pa.list_(pa.float64()))], names=["file", "row", "v"])

    each = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(rows, "file string, row long, v array<double>")
    # a row a file, by name; its first number is what the files before it hold
    starts = each.groupBy("file").agg(F.count("*").alias("n")).select("file", (F.sum("n").over(W.orderBy("file")) - F.col("n")).alias("first"))
    return each.join(starts, "file").select((F.col("first") + F.col("row")).alias("vec_id"), "v")


def save_npy(vectors: DataFrame, folder: str) -> int:
    """Write ``vectors`` (vec_id, v) in order of vec_id as .npy files of two dimensions in ``folder``, which tasks and
    driver share; the number of files. A task that runs again writes its file again, under the same name."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io

        from pyarrow import fs
        from pyspark import TaskContext

        system, base = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        part, k, rows = TaskContext.get().partitionId(), 0, []

        def out() -> None:
            held = io.BytesIO()
            np.save(held, np.concatenate(rows))
            system.create_dir(base, recursive=True)
            with system.open_output_stream(f"{base}/part-{part:06d}-{k:06d}.npy") as f:
                f.write(held.getvalue())

        for batch in batches:
            for at in range(0, batch.num_rows, NPY_ROWS):
                piece = batch.column(1).slice(at, NPY_ROWS)
                rows.append(np.stack([np.asarray(v, float) for v in piece.to_pylist()]))
                if sum(map(len, rows)) >= NPY_ROWS:
                    out()
                    k, rows = k + 1, []
        if rows:
            out()
        yield pa.RecordBatch.from_arrays([pa.array([k + bool(rows)], pa.int64())], names=["n"])

    ordered = vectors.where("v is not null").select("vec_id", "v").repartitionByRange("vec_id").sortWithinPartitions("vec_id")
    return ordered.mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0


def save_index(tables: dict[str, DataFrame], path: str) -> None:
    """An index as Parquet tables under one folder."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}.parquet")


def load_index(spark: SparkSession, path: str, names: tuple[str, ...]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}.parquet") for n in names}


def tree(spark: SparkSession, root: str, most_bytes: int = 1 << 20, skip: tuple[str, ...] = (".git",)) -> DataFrame:
    """(path, size, text): the files below a folder, hidden ones too, which Spark's own sources leave out.

    The driver lists names; tasks read contents of up to ``most_bytes`` (larger ones and unreadable ones
    have a null text). The folder must be one that the executors see.
    """
    found = []
    for folder, folders, names in os.walk(root):
        folders[:] = sorted(d for d in folders if d not in skip)
        for n in sorted(names):
            p = os.path.join(folder, n)
            try:
                found.append((os.path.relpath(p, root), os.path.getsize(p)))
            except OSError:
                found.append((os.path.relpath(p, root), None))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for path, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    texts.append(Path(root, path).read_bytes().decode("utf-8", "replace") if size is not None and size <= most_bytes else None)
                except OSError:
                    texts.append(None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=["path", "size", "text"])

    return spark.createDataFrame(found, "path string, size long").repartition(max(1, len(found) // 1000)).mapInArrow(read, "path string, size long, text string")


def append_log(log: DataFrame, path: str) -> None:
    """Append records as files of JSON lines; durability is that of the file system's commit, by batch."""
    log.select("lsn", "txn_id", "op", "key", "value").write.mode("append").json(path)


def scan_log(spark: SparkSession, path: str) -> DataFrame:
    """Records with their stored lsn; a torn line gives no record."""
    return spark.read.schema("lsn long, " + LOG_SCHEMA).option("mode", "DROPMALFORMED").json(path).where("op is not null")


def random_unit_vectors(spark: SparkSession, n: int, dim: int, seed: int = 0) -> DataFrame:
    """(vec_id, v): n unit vectors of independent normal components."""
    if n < 0 or dim < 1:
        raise ValueError("n must not be negative, dim at least 1")
    from sparkloom.functions.vectors import unit

    return spark.range(n).select(F.col("id").alias("vec_id"), unit(F.array(*[F.randn(seed + k) for k in range(dim)])).alias("v"))


def base_table(spark: SparkSession, source: str, kept: str) -> DataFrame:
    """The table at ``source`` with names in snake case, kept as CSV at ``kept``; later calls read that."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    path = hadoop.Path(f"{kept}/_SUCCESS")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        df = load(spark, source)
        df.toDF(*map(snake_name, df.columns)).write.mode("overwrite").csv(kept, header=True)
    return load(spark, kept)


def save_batches(batches: DataFrame, folder: str) -> None:
    """A CSV folder a batch (``batch=1``, ...), with headers; batches of an earlier run are replaced."""
    batches.repartition("batch").write.mode("overwrite").partitionBy("batch").csv(folder, header=True)


def batch_names(spark: SparkSession, folder: str) -> DataFrame:
    """(batch, n_files) of a folder of :func:`save_batches`, by its names alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").load(folder).select("path")
    batch = F.regexp_extract("path", r"batch=(\d+)/[^/]*$", 1).cast("int")
    return files.select(batch.alias("batch")).groupBy("batch").agg(F.count("*").alias("n_files"))


def save_manifest(rows: DataFrame, folder: str) -> None:
    """One JSON line a batch, in one file: batches are few."""
    rows.coalesce(1).write.mode("overwrite").json(folder)
