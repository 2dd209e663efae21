"""Exact deduplication by Grace hashing.

Spark's shuffle is the first partitioning pass. A map-side open-addressing table first merges the
copies that a task has read, so that a text that makes up a third of all rows reaches the shuffle as
one record per task. After the shuffle each task fills an open-addressing table that compares
complete contents; when the table would exceed its memory, the task deals its records out to spill
files by the next bits of the hash and treats each file in the same way. Spill files are private to
the running task and go with it, so a retried task depends on nothing that a lost executor held.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sparkloom.llm.common import col, collapse_ws, collapse_ws_bytes, fresh

TABLE_BYTES = 48 << 20
FANOUT = 16
FANOUT_BITS = 4
MAX_LEVEL = 12
FLUSH_ROWS = 2000


def content_hash(content: bytes) -> int:
    return xxhash.xxh64_intdigest(content)


class ContentTable:
    """Open addressing with linear probing; a slot points to an entry, equality is that of contents.

    An entry is [hash, content, record, order key, count]: the record with the smallest order key
    stays and counts add up.
    """

    def __init__(self) -> None:
        self.mask = 1023
        self.slots = [-1] * 1024
        self.entries: list[list] = []
        self.bytes = 0

    def add(self, h: int, content: bytes, record: tuple, order: tuple, n: int) -> None:
        at = h & self.mask
        while (k := self.slots[at]) >= 0:
            e = self.entries[k]
            if e[0] == h and e[1] == content:
                e[4] += n
                if order < e[3]:
                    e[2], e[3] = record, order
                return
            at = (at + 1) & self.mask
        self.slots[at] = len(self.entries)
        self.entries.append([h, content, record, order, n])
        self.bytes += 2 * len(content) + 400
        if 2 * len(self.entries) > self.mask:
            self._grow()

    def _grow(self) -> None:
        self.mask = 2 * self.mask + 1
        self.slots = [-1] * (self.mask + 1)
        for k, e in enumerate(self.entries):
            at = e[0] & self.mask
            while self.slots[at] >= 0:
                at = (at + 1) & self.mask
            self.slots[at] = k


def grace(entries: Iterable[list], table_bytes: int, level: int = 0) -> Iterator[list]:
    """One entry per distinct content, holding at most about ``table_bytes`` of distinct contents."""
    table = ContentTable()
    spill = None
    with tempfile.TemporaryDirectory(prefix="grace-") as folder:
        for e in entries:
            if spill is not None:
                pickle.dump(e, spill[(e[0] >> (64 - FANOUT_BITS * (level + 1))) % FANOUT], protocol=5)
                continue
            table.add(*e)
            # hashes of 64 bits have no bits left below the last level; such a bucket stays in memory
            if table.bytes > table_bytes and level < MAX_LEVEL and len(table.entries) > 1:
                spill = [open(f"{folder}/{i}", "w+b") for i in range(FANOUT)]  # noqa: SIM115
                for kept in table.entries:
                    pickle.dump(kept, spill[(kept[0] >> (64 - FANOUT_BITS * (level + 1))) % FANOUT], protocol=5)
                table = ContentTable()
        if spill is None:
            yield from table.entries
            return
        for f in spill:
            f.seek(0)
            yield from grace(_unpickled(f), table_bytes, level + 1)
            f.close()


def _unpickled(f) -> Iterator[list]:
    while True:
        try:
            yield pickle.load(f)
        except EOFError:
            return


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row if isinstance(v, str | bytes))
        if len(held) >= FLUSH_ROWS or size > 8 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types, strict=True)], schema=schema)


def _order(doc_id) -> tuple:
    return (doc_id is None, 0 if doc_id is None else doc_id)


def dedup_records(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES, with_group: bool = False
) -> DataFrame:
    """One whole record per distinct text: that of the smallest id.

    Texts are equal when identical after collapsing white space; a null text counts as empty.
    Null ids order last. Of rows that repeat an id and a text any one stays, as they are equal in
    both; other columns may hold any values or nulls and travel with their record. An empty table
    gives an empty result. ``with_group`` adds ``keep_id``, ``group_size`` and ``text_sha256`` (under
    longer names where columns of the input clash).
    """
    names = df.columns
    at_id, at_text = names.index(id_col), names.index(text_col)
    hash_name, n_name, keep, size, sha = fresh(df, "content_hash", "n_copies", "keep_id", "group_size", "text_sha256")
    mid = T.StructType([*df.schema.fields, T.StructField(hash_name, T.LongType()), T.StructField(n_name, T.LongType())])
    end = df.schema
    if with_group:
        end = T.StructType(
            [*df.schema.fields, T.StructField(keep, df.schema[id_col].dataType), T.StructField(size, T.LongType()), T.StructField(sha, T.StringType())]
        )
    mid_arrow, end_arrow = to_arrow_schema(mid), to_arrow_schema(end)
    width = len(names)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for batch in batches:
            for part in range(0, batch.num_rows, 500):
                columns = [c.slice(part, 500).to_pylist() for c in batch.columns]
                for row in zip(*columns, strict=True):
                    content = collapse_ws_bytes((row[at_text] or "").encode())
                    yield [content_hash(content), content, row[:width], _order(row[at_id]), row[width + 1] if len(row) > width else 1]

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            table = ContentTable()
            for e in entries(batches):
                table.add(*e)
                if table.bytes > table_bytes:  # what is merged so far goes on; the next pass merges the rest
                    yield from (_mid(x) for x in table.entries)
                    table = ContentTable()
            yield from (_mid(x) for x in table.entries)

        return _batches(rows(), mid_arrow)

    def _mid(e: list) -> tuple:
        return (*e[2], e[0] - (1 << 64) if e[0] >> 63 else e[0], e[4])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for e in grace(entries(batches), table_bytes):
                yield (*e[2], e[2][at_id], e[4], hashlib.sha256(e[1]).hexdigest()) if with_group else e[2]

        return _batches(rows(), end_arrow)

    return df.mapInArrow(combine, mid).repartition(F.col(f"`{hash_name}`")).mapInArrow(finish, end)


def dedup_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """Every row with its group: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Nulls and ties as in :func:`dedup_records`. A row is kept when its id is its group's ``keep_id``;
    rows that repeat both id and text are one document and share that mark, while ``group_size``
    counts each of them. The join below has one row a text on its right side, and Spark splits the
    left side of a text that holds a large share of the rows (AQE skew join).
    """
    slim = df.select(col(df, id_col).alias("doc_id"), col(df, text_col).cast("string").alias("text"))
    groups = dedup_records(slim, "doc_id", "text", table_bytes, with_group=True).select("keep_id", "group_size", "text_sha256")
    members = slim.select("doc_id", F.sha2(collapse_ws(F.col("text")).cast("binary"), 256).alias("text_sha256"))
    return members.join(groups, "text_sha256").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
