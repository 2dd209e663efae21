"""Multi-version reads over a write-ahead log (lsn, txn_id, op, key, value).

A log is replayed as joins and aggregations. Snapshots are prefixes of the commit order, so a snapshot
is one number. Where one transaction writes a key twice, the later record counts, also in vacuum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.ordered import RANGE_ROWS, previous, running_sums

OPS = ("PUT", "DELETE", "COMMIT", "ABORT")


def commits(log: DataFrame) -> DataFrame:
    """(txn_id, commit_lsn, commit_order): COMMIT records numbered from 1 by lsn; the first of a transaction
    counts. The numbering is a running sum over ranges, so no task holds all commits."""
    first = log.where("op = 'COMMIT'").groupBy("txn_id").agg(F.min("lsn").alias("commit_lsn")).withColumn("one", F.lit(1).cast("long"))
    return running_sums(first, [], "commit_lsn", ["one"]).select("txn_id", "commit_lsn", F.col("one_upto").cast("long").alias("commit_order"))


def versions(log: DataFrame) -> DataFrame:
    """(key, value, txn_id, commit_order, lsn): writes of committed transactions, deletions with a null
    value. A write that follows its transaction's COMMIT is not committed."""
    writes = log.where("op in ('PUT', 'DELETE')").select("key", F.when(F.col("op") == "PUT", F.col("value")).alias("value"), "txn_id", "lsn")
    return writes.join(commits(log), "txn_id").where("lsn < commit_lsn").select("key", "value", "txn_id", "commit_order", "lsn")


def _newest() -> Column:
    return F.max_by(F.struct("value", "txn_id", "commit_order", "lsn"), F.struct("commit_order", "lsn"))


def snapshot(found: DataFrame, hi: int | Column | None = None, with_deleted: bool = False) -> DataFrame:
    """(key, value, txn_id, commit_order, lsn): per key the newest version of ``versions`` up to commit
    ``hi`` (all if None); keys whose newest version is a deletion are left out unless asked for. One
    aggregation, merged by task before the shuffle."""
    seen = found if hi is None else found.where(F.col("commit_order") <= hi)
    newest = seen.groupBy("key").agg(_newest().alias("v")).select("key", "v.*")
    return newest if with_deleted else newest.where("value is not null")


def conflicts(found: DataFrame, begun: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Transactions of ``begun`` (txn_id, snapshot_hi) with a written key of which another transaction
    committed a version after the snapshot and before their own commit: (txn_id, key).

    A transaction has one commit, so the commit before its own among those of a key decides: versions of a key
    meet no others, and those of a hot key are cut into ranges of ``range_rows`` commits.
    """
    each = found.select("key", "txn_id", "commit_order").distinct()
    behind = previous(each, ["key"], "commit_order", ["commit_order"], range_rows).where("was_commit_order is not null")
    return behind.join(begun, "txn_id").where("was_commit_order > snapshot_hi").select("txn_id", "key")


def vacuum(found: DataFrame, cutoff: int) -> DataFrame:
    """``versions`` with ``dropped``: those up to ``cutoff`` that a newer one up to ``cutoff`` supersedes."""
    kept = snapshot(found, cutoff, with_deleted=True).select(F.col("key").alias("k"), F.col("lsn").alias("kept_lsn"))
    joined = found.join(kept, F.col("key") == F.col("k"), "left")
    return joined.select(*found.columns, ((F.col("commit_order") <= cutoff) & (F.col("lsn") != F.col("kept_lsn"))).alias("dropped"))


def vacuum_cutoff(log: DataFrame, active: DataFrame) -> DataFrame:
    """One row, ``cutoff``: the smallest snapshot of an active transaction, else the last commit."""
    last = commits(log).agg(F.coalesce(F.max("commit_order"), F.lit(0)).alias("last"))
    return active.agg(F.min("snapshot_hi").alias("least")).join(last).select(F.coalesce("least", "last").cast("long").alias("cutoff"))


def status(log: DataFrame) -> DataFrame:
    """(txn_id, n_writes, status): committed, aborted or active; COMMIT counts before ABORT."""
    return log.groupBy("txn_id").agg(
        F.count_if(F.col("op").isin("PUT", "DELETE")).alias("n_writes"),
        F.when(F.count_if(F.col("op") == "COMMIT") > 0, "committed").when(F.count_if(F.col("op") == "ABORT") > 0, "aborted").otherwise("active").alias("status"),
    )


def next_txn_id(log: DataFrame) -> DataFrame:
    return log.agg((F.coalesce(F.max("txn_id"), F.lit(0)) + 1).alias("next_txn_id"))


def encode(log: DataFrame) -> DataFrame:
    """(lsn, line): a compact JSON object a record, without null fields."""
    return log.select("lsn", F.to_json(F.struct("txn_id", "op", "key", "value")).alias("line"))


def decode(lines: DataFrame) -> DataFrame:
    """The log of (lsn, line); blank lines are skipped, broken ones and unknown ops give no record."""
    parsed = lines.where(F.trim("line") != "").select("lsn", F.from_json("line", "txn_id long, op string, key string, value string", {"mode": "PERMISSIVE"}).alias("r"))
    return parsed.select("lsn", "r.*").where(F.col("op").isin(*OPS))
