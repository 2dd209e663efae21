"""File trees of any size: folders are listed by tasks, level by level, and contents are read in byte ranges."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.operators.scan import PLACEHOLDER, SECRETS
from sparkloom.shipping import checkpoint

RANGE_BYTES = 8 << 20
#: What a range reads beyond its ends: a finding's line is judged by so many bytes around it, and no secret is longer.
OVERLAP = 4096
#: Bytes of an ignore file.
MOST_RULES = 16 << 20


def _opened(root: str) -> tuple[fs.FileSystem, str]:
    """A file system and a path of it, from a path or a URI."""
    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)


def listing(spark: SparkSession, root: str, skip: tuple[str, ...] = (".git",)) -> DataFrame:
    """(path, size) of all files below ``root``, hidden ones too; folders named in ``skip`` are left out, unreadable
    ones give nothing. Tasks list the folders of a level, so the driver sees their number only."""

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _opened(root)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                try:
                    found = system.get_file_info(fs.FileSelector(f"{base}/{folder}" if folder else base))
                except OSError:
                    continue
                rows = [(f"{folder}/{x.base_name}" if folder else x.base_name, x.type == fs.FileType.Directory, x.size) for x in found if x.type in (fs.FileType.Directory, fs.FileType.File) and not (x.type == fs.FileType.Directory and x.base_name in skip)]
                for at in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[at : at + 10_000], strict=True)], schema=pa.schema([("path", pa.string()), ("is_folder", pa.bool_()), ("size", pa.int64())]))

    level = spark.createDataFrame([("",)], "path string")
    out = None
    while True:
        n = level.count()
        if not n and out is not None:
            return out.select("path", "size")
        spread = level.repartition(min(n, 8 * spark.sparkContext.defaultParallelism)) if n > 1 else level
        entries = checkpoint(spread.mapInArrow(inside, "path string, is_folder boolean, size long"))
        files = entries.where("not is_folder")
        out = files if out is None else out.unionByName(files)
        level = entries.where("is_folder").select("path")


def line_ends(data: bytes, start: int, end: int) -> int:
    """Line ends that lie in ``data[start:end]``; a return before a line feed is part of it, wherever the cut is."""
    part = data[start:end]
    both = part.count(b"\r\n") + (1 if part.endswith(b"\r") and data[end : end + 1] == b"\n" else 0)
    return part.count(b"\n") + part.count(b"\r") - both


def findings(spark: SparkSession, root: str, files: DataFrame | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(file_path, severity, message, line_number) of secrets in ``files`` (path, size) below ``root``, all of them if not
    given: a row a line and pattern, as :func:`scan.findings_of_lines` has them.

    A task reads a range of ``range_bytes`` and OVERLAP bytes around it, and tells what begins in its range and how many
    lines end there. Running sums of those give line numbers. Files with a NUL anywhere are binary and skipped.
    """
    files = listing(spark, root) if files is None else files
    ranges = files.where("size > 0").select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(range_bytes).cast("long"))).alias("start"))
    patterns = [(re.compile(p.encode()), s, m) for p, s, m in SECRETS]
    placeholder = re.compile(PLACEHOLDER.encode())
    schema = pa.schema([("path", pa.string()), ("start", pa.int64()), ("severity", pa.string()), ("message", pa.string()), ("lines", pa.int64()), ("binary", pa.bool_())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _opened(root)
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                first = max(0, start - OVERLAP)
                try:
                    with system.open_input_file(f"{base}/{path}") as f:
                        f.seek(first)
                        data = f.read(start - first + range_bytes + OVERLAP)
                except OSError:
                    continue
                a, b = start - first, start - first + range_bytes
                rows = [(path, start, None, None, line_ends(data, a, b), b"\0" in data[a:b])]
                for pattern, severity, message in patterns:
                    for hit in pattern.finditer(data):
                        at = hit.start()
                        if not a <= at < b or b"\n" in hit.group() or b"\r" in hit.group():
                            continue
                        begin = max(data.rfind(b"\n", 0, at), data.rfind(b"\r", 0, at)) + 1
                        ends = [e for e in (data.find(b"\n", at), data.find(b"\r", at)) if e >= 0]
                        if not placeholder.search(data, begin, min(ends, default=len(data))):
                            rows.append((path, start, severity, message, line_ends(data, a, at), None))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    told = checkpoint(ranges.repartition("path", "start").mapInArrow(read, "path string, start long, severity string, message string, lines long, binary boolean"))
    before = W.partitionBy("path").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    counts = told.where("message is null").select("path", "start", F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("before"), F.max("binary").over(W.partitionBy("path")).alias("is_binary"))
    hits = told.where("message is not null").drop("binary").join(counts.where("not is_binary"), ["path", "start"])
    return hits.select(F.col("path").alias("file_path"), "severity", "message", (F.col("before") + F.col("lines") + 1).cast("int").alias("line_number")).distinct()


def ignore_lines(root: str, name: str = ".gitignore") -> list[str]:
    """Lines of the ignore file of a folder; none if it has none."""
    system, base = _opened(root)
    info = system.get_file_info(f"{base}/{name}")
    if info.type != fs.FileType.File:
        return []
    if info.size > MOST_RULES:
        raise ValueError(f"{name} is larger than {MOST_RULES} bytes")
    with system.open_input_file(f"{base}/{name}") as f:
        return f.read().decode("utf-8", "replace").splitlines()
