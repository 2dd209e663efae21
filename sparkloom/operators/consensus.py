"""Invariants and transitions of a consensus trace (seed, step, node_id, term, state, commit_index,
log_length), as joins, windows and aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.ordered import RANGE_ROWS, previous


def leaders_by_term(trace: DataFrame) -> DataFrame:
    """(seed, term, n_leaders): nodes that led in a term; above 1, the invariant is broken."""
    return trace.where("state = 'LEADER'").groupBy("seed", "term").agg(F.count_distinct("node_id").alias("n_leaders"))


def current_leader(trace: DataFrame) -> DataFrame:
    """(seed, leader): the leader of the highest term, the smallest node id on a tie."""
    return trace.where("state = 'LEADER'").groupBy("seed").agg(F.max_by("node_id", F.struct("term", -F.col("node_id"))).alias("leader"))


def transitions(trace: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Steps at which a node's state or term differs from its step before, and rises of its commit index. Long
    traces of one node are cut into ranges of ``range_rows`` steps."""
    seen = previous(trace, ["seed", "node_id"], "step", ["state", "term", "commit_index"], range_rows).withColumnRenamed("was_commit_index", "was_commit")
    changed = F.col("was_state").isNotNull() & ((F.col("state") != F.col("was_state")) | (F.col("term") != F.col("was_term")))
    return seen.where(changed).select("seed", "node_id", "step", "was_state", "state", "was_term", "term", (F.col("commit_index") > F.col("was_commit")).alias("committed"))


def majority(n: Column) -> Column:
    return F.floor(n / 2).cast("int") + 1


def quorum_commit(trace: DataFrame) -> DataFrame:
    """(seed, term, n_nodes, quorum_index): the largest log length that a majority of the term's nodes holds,
    each by its longest log in the term."""
    lengths = trace.groupBy("seed", "term", "node_id").agg(F.max("log_length").alias("length"))
    # a term has one length a node, and nodes are few
    each = lengths.groupBy("seed", "term").agg(F.count("*").alias("n_nodes"), F.sort_array(F.collect_list("length"), asc=False).alias("lengths"))
    return each.select("seed", "term", "n_nodes", F.element_at("lengths", majority(F.col("n_nodes"))).alias("quorum_index"))


def elections(trace: DataFrame) -> DataFrame:
    """(seed, term, candidates, voters, won): distinct candidates of a term and whether its followers are
    a majority of all nodes seen."""
    c = trace.groupBy("seed", "term").agg(
        F.count_distinct(F.when(F.col("state") == "CANDIDATE", F.col("node_id"))).alias("candidates"),
        F.count_distinct(F.when(F.col("state") == "FOLLOWER", F.col("node_id"))).alias("voters"),
        F.count_distinct("node_id").alias("nodes"),
    )
    return c.select("seed", "term", "candidates", "voters", (F.col("voters") >= majority(F.col("nodes"))).alias("won"))


def up_to_date(trace: DataFrame) -> DataFrame:
    """(seed, node_id, fresh): whether a node's newest (term, log length) is at least every other's of its
    seed, compared in that order."""
    newest = trace.groupBy("seed", "node_id").agg(F.max(F.struct("term", "log_length")).alias("last"))
    best = newest.groupBy("seed").agg(F.max("last").alias("best"))
    return newest.join(best, "seed").select("seed", "node_id", (F.col("last") >= F.col("best")).alias("fresh"))


def blocked(sender: Column, receiver: Column, a: list[int], b: list[int]) -> Column:
    """Whether a message crosses the partition of groups ``a`` and ``b``; nodes in neither are never cut off."""
    return (sender.isin(*a) & receiver.isin(*b)) | (sender.isin(*b) & receiver.isin(*a))


def deliveries(messages: DataFrame, now: int, a: list[int], b: list[int]) -> DataFrame:
    """(from_id, to_id, outcome, n): messages (from_id, to_id, due) that are due are delivered, or dropped if
    the partition cuts them off when due; others are queued."""
    outcome = F.when(F.col("due") > now, "queued").when(blocked(F.col("from_id"), F.col("to_id"), a, b), "dropped").otherwise("delivered")
    return messages.groupBy("from_id", "to_id", outcome.alias("outcome")).agg(F.count("*").alias("n"))


def convergence(entries: DataFrame) -> DataFrame:
    """(seed, n_nodes, n_indexes, n_diverged): indexes of a log (seed, node_id, index, entry) that not all nodes
    of the seed hold alike. None diverges once all live nodes have converged."""
    nodes = entries.groupBy("seed").agg(F.count_distinct("node_id").alias("n_nodes"))
    held = entries.groupBy("seed", "index", "node_id").agg(F.max("entry").alias("hi"), F.min("entry").alias("lo"))
    at = held.groupBy("seed", "index").agg(F.count("*").alias("holders"), F.max("hi").alias("hi"), F.min("lo").alias("lo"))
    told = at.join(nodes, "seed").withColumn("differs", (F.col("holders") < F.col("n_nodes")) | ~F.col("hi").eqNullSafe(F.col("lo")))
    return told.groupBy("seed").agg(F.max("n_nodes").alias("n_nodes"), F.count("*").alias("n_indexes"), F.count_if("differs").alias("n_diverged"))
