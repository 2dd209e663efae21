"""Queries over the write-ahead log, the scans, and the consensus trace."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.text import ancestors, human_size, parent, snake
from sparkloom.operators import consensus, mvcc, scan
from sparkloom.shipping import shared_folder
from sparkloom.sources import tree
from sparkloom.sources.catalog import table, trace, wal


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mvcc.versions(wal(spark, sf_dir))


def _half(versions: DataFrame) -> int:
    return (versions.agg(F.max("commit_order")).first()[0] or 0) // 2


def wal_replay_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mvcc.snapshot(_versions(spark, sf_dir)).select("key", "value", "txn_id", "commit_order")


def snapshot_read_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _versions(spark, sf_dir)
    return mvcc.snapshot(v, _half(v)).select("key", "value", "commit_order")


def version_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _versions(spark, sf_dir)


def write_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each transaction began one to three commits before its own."""
    log = wal(spark, sf_dir)
    begun = mvcc.commits(log).select("txn_id", F.greatest(F.lit(0), F.col("commit_order") - 1 - F.col("txn_id") % 3).alias("snapshot_hi"))
    return mvcc.conflicts(mvcc.versions(log), begun)


def vacuum_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _versions(spark, sf_dir)
    return mvcc.vacuum(v, _half(v)).where("dropped").select("key", "lsn", "commit_order")


def vacuum_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _versions(spark, sf_dir)
    return mvcc.vacuum(v, _half(v)).where("not coalesce(dropped, false)").select("key", "lsn", "commit_order")


def vacuum_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions without a terminal record are active; each sees what was committed a record before it."""
    log = wal(spark, sf_dir)
    open_txns = mvcc.status(log).where("status = 'active'").select("txn_id")
    return mvcc.vacuum_cutoff(log, open_txns.select(F.col("txn_id").alias("snapshot_hi")))


def txn_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mvcc.status(wal(spark, sf_dir))


def next_txn_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mvcc.next_txn_id(wal(spark, sf_dir))


def wal_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mvcc.decode(mvcc.encode(wal(spark, sf_dir)))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "text", (F.col("n_chars") * 100).alias("size"))


def secret_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.findings_of_lines(_files(spark, sf_dir))


def secret_severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.severity_counts(scan.findings_of_lines(_files(spark, sf_dir)))


def large_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document counts a hundred bytes a character here, so that some exceed the limit."""
    return scan.large_files(_files(spark, sf_dir), limit=1024 * 1024).select("file_path", "severity", "message")


def findings_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _files(spark, sf_dir)
    both = scan.findings_of_lines(f).unionByName(scan.large_files(f, limit=1024 * 1024))
    return scan.report(both).withColumn("line_number", F.coalesce("line_number", F.lit(0)))


def human_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", human_size(F.floor(F.col("o_totalprice") * F.pow(F.lit(4.0), F.col("o_orderkey") % 12))).alias("size"))


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    folder = F.element_at(F.array(*[F.lit(x) for x in ("src", "build/out", "node_modules/x", "docs", ".venv/lib")]), (F.col("page_id") % 5 + 1).cast("int"))
    return p.select("page_id", F.concat(folder, F.lit("/"), F.regexp_extract("url", r"^[^:]*://[^/?#]*/([^?#]*)", 1)).alias("path"))


IGNORE_LINES = ["# generated", "build/", "*.html", "!src/**/7*.html", "/docs/fr", "node_modules"]


def path_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).select("page_id", F.posexplode(ancestors(F.col("path"))).alias("pos", "prefix"))


def ignore_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).select("page_id", "path", scan.ignored(F.col("path"), scan.compile_rules(IGNORE_LINES)).alias("ignored"))


def ignore_rules_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules as a table: the lines above, then one for the path of every third page, every other of them negated."""
    paths = _paths(spark, sf_dir)
    lines = spark.createDataFrame(list(enumerate(IGNORE_LINES)), "rule_idx long, line string")
    whole = F.element_at(ancestors(F.col("path")), -1)
    more = paths.where("page_id % 3 = 0").select((F.col("page_id") + 100).alias("rule_idx"), F.concat(F.when(F.col("page_id") % 2 == 0, "!/").otherwise("/"), whole).alias("line"))
    return scan.ignored_by(paths, scan.rule_table(lines.unionByName(more)))


def tree_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in the documents as text files of a tree, read in ranges of 64 KiB: lines by kind of secret."""
    folder = f"{shared_folder(spark)}/tree-{uuid.uuid4().hex}"
    table(spark, sf_dir, "documents").where(~F.contains("text", F.lit("\0"))).select("text").write.text(f"{folder}/texts")
    return tree.findings(spark, folder, range_bytes=1 << 16).groupBy("severity", "message").agg(F.count("*").alias("n"))


def ignore_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.audit(_paths(spark, sf_dir), scan.compile_rules(IGNORE_LINES)).select("file_path", "severity", "message")


def snake_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", snake(F.col("p_type")).alias("name"), parent(F.concat(F.lit("a/"), "p_name")).alias("folder"))


def raft_one_leader_per_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.leaders_by_term(trace(spark, sf_dir))


def raft_current_leader(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.current_leader(trace(spark, sf_dir))


def raft_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.transitions(trace(spark, sf_dir))


def raft_quorum_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.quorum_commit(trace(spark, sf_dir))


def raft_elections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.elections(trace(spark, sf_dir))


def raft_up_to_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.up_to_date(trace(spark, sf_dir))


def raft_convergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the nodes of a seed hold one log, the commit index being the place and the term the entry."""
    t = trace(spark, sf_dir)
    return consensus.convergence(t.select("seed", "node_id", F.col("commit_index").alias("index"), F.col("term").alias("entry")))


def raft_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    messages = e.select((F.col("user_id") % 5).cast("int").alias("from_id"), (F.col("event_id") % 5).cast("int").alias("to_id"), F.floor(F.col("value") * 10).cast("int").alias("due"))
    return consensus.deliveries(messages, 300, [0, 1], [2, 3])


QUERIES = {
    f.__name__: f
    for f in (
        wal_replay_latest, snapshot_read_asof, version_history, write_conflicts, vacuum_dropped, vacuum_kept, vacuum_cutoff, txn_status, next_txn_id, wal_round_trip, secret_findings,
        secret_severity_counts, large_documents, findings_report, human_sizes, path_ancestors, ignore_match, ignore_rules_match, tree_findings, ignore_audit, snake_names, raft_one_leader_per_term, raft_current_leader,
        raft_transitions, raft_quorum_commit, raft_elections, raft_up_to_date, raft_deliveries, raft_convergence,
    )
}

_WAL = """
    w0 AS (SELECT event_id AS lsn, event_id // 4 + 1 AS txn_id, event_type, user_id, value, event_id % 4 = 3 AS last FROM events),
    w1 AS (SELECT *, CASE WHEN last AND txn_id % 7 <> 0 THEN CASE WHEN txn_id % 5 = 0 THEN 'ABORT' ELSE 'COMMIT' END WHEN event_type = 'error' THEN 'DELETE' ELSE 'PUT' END AS op FROM w0),
    w AS (SELECT lsn, txn_id, op, CASE WHEN op IN ('PUT', 'DELETE') THEN 'u' || user_id END AS key, CASE WHEN op = 'PUT' THEN printf('%.2f', value) END AS value FROM w1),
    cm AS (SELECT txn_id, min(lsn) AS commit_lsn, row_number() OVER (ORDER BY min(lsn)) AS commit_order FROM w WHERE op = 'COMMIT' GROUP BY txn_id),
    v AS (SELECT key, value, w.txn_id, commit_order, lsn FROM w JOIN cm ON w.txn_id = cm.txn_id AND lsn < commit_lsn WHERE op IN ('PUT', 'DELETE')),
    h AS (SELECT max(commit_order) // 2 AS h FROM v)"""
_VACUUM = """
    vr AS (SELECT key, lsn, commit_order, row_number() OVER (PARTITION BY key ORDER BY commit_order DESC, lsn DESC) AS r FROM v, h WHERE commit_order <= h),
    dr AS (SELECT key, lsn, commit_order FROM vr WHERE r > 1)"""
_FILES = "f AS (SELECT source || '/' || doc_id || '.txt' AS path, text, n_chars * 100 AS size FROM documents)"
_SECRETS = """
    ln AS (SELECT path, unnest(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))) AS line,
                  generate_subscripts(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), 1) AS n FROM f WHERE NOT contains(text, chr(0))),
    ok AS (SELECT * FROM ln WHERE NOT regexp_matches(line, '(?i)(changeme|example|placeholder|your[_-])')),
    sf AS (
        SELECT path AS file_path, 'high' AS severity, 'Possible AWS access key ID found' AS message, n::INT AS line_number FROM ok WHERE regexp_matches(line, 'AKIA[0-9A-Z]{16}')
        UNION ALL SELECT path, 'high', 'Private key block found', n::INT FROM ok WHERE regexp_matches(line, '-----BEGIN [A-Z ]*PRIVATE KEY-----')
        UNION ALL SELECT path, 'high', 'Possible hard-coded password found', n::INT FROM ok WHERE regexp_matches(line, '(?i)password\\s*[:=]\\s*["''][^"'']{4,}["'']')
        UNION ALL SELECT path, 'medium', 'Possible API key or token found', n::INT FROM ok WHERE regexp_matches(line, '(?i)(api[_-]?key|secret|token)\\s*[:=]\\s*["''][^"'']{8,}["'']'))"""


def _human(x: str) -> str:
    return f"""CASE WHEN {x} >= 1099511627776 THEN printf('%.1f TB', {x} / 1099511627776.0::DOUBLE) WHEN {x} >= 1073741824 THEN printf('%.1f GB', {x} / 1073741824.0::DOUBLE)
        WHEN {x} >= 1048576 THEN printf('%.1f MB', {x} / 1048576.0::DOUBLE) WHEN {x} >= 1024 THEN printf('%.1f KB', {x} / 1024.0::DOUBLE) ELSE printf('%d B', ({x})::BIGINT) END"""


_LARGE = f"lf AS (SELECT path AS file_path, 'medium' AS severity, 'Large file: ' || {_human('size')} AS message FROM f WHERE size > 1048576)"
_PATHS = """
    pt AS (SELECT page_id, ['src', 'build/out', 'node_modules/x', 'docs', '.venv/lib'][page_id % 5 + 1] || '/' || regexp_extract(url, '^[^:]*://[^/?#]*/([^?#]*)', 1) AS path FROM pages),
    sg AS (SELECT page_id, path, list_filter(string_split(path, '/'), lambda s: s <> '') AS seg FROM pt),
    an AS (SELECT page_id, path, (i - 1)::INT AS pos, array_to_string(seg[1:i], '/') AS prefix, i = len(seg) AS whole FROM sg, unnest(range(1, len(seg) + 1)) AS t(i))"""
_IGNORED = """
    m AS (SELECT page_id, path,
        bool_or(NOT whole AND regexp_matches(prefix, '^(?:|.*/)build(?:/.*)?$')) AS r1, bool_or(regexp_matches(prefix, '^(?:|.*/)[^/]*\\.html(?:/.*)?$')) AS r2,
        bool_or(regexp_matches(prefix, '^src/(?:.*/)?7[^/]*\\.html(?:/.*)?$')) AS r3, bool_or(regexp_matches(prefix, '^docs/fr(?:/.*)?$')) AS r4,
        bool_or(regexp_matches(prefix, '^(?:|.*/)node_modules(?:/.*)?$')) AS r5 FROM an GROUP BY ALL)"""
_TRACE = """
    t AS (SELECT (user_id % 10)::INT AS seed, event_id AS step, (user_id % 50 // 10)::INT AS node_id, date_diff('day', DATE '2024-01-01', ts::DATE)::INT AS term,
        CASE event_type WHEN 'purchase' THEN 'LEADER' WHEN 'click' THEN 'CANDIDATE' ELSE 'FOLLOWER' END AS state, (props->>'$.k')::INT AS commit_index,
        ((props->>'$.k')::INT + floor(value)::INT % 10) AS log_length FROM events)"""

ORACLE_SQL = {
    "wal_replay_latest": f"""WITH {_WAL}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY commit_order DESC, lsn DESC) AS r FROM v)
        SELECT key, value, txn_id, commit_order FROM r WHERE r = 1 AND value IS NOT NULL""",
    "snapshot_read_asof": f"""WITH {_WAL}, r AS (SELECT v.*, row_number() OVER (PARTITION BY key ORDER BY commit_order DESC, lsn DESC) AS r FROM v, h WHERE commit_order <= h)
        SELECT key, value, commit_order FROM r WHERE r = 1 AND value IS NOT NULL""",
    "version_history": f"WITH {_WAL} SELECT * FROM v",
    "write_conflicts": f"""WITH {_WAL}, b AS (SELECT txn_id, commit_order AS own, greatest(0, commit_order - 1 - txn_id % 3) AS hi FROM cm), k AS (SELECT DISTINCT key, txn_id, commit_order FROM v)
        SELECT k.txn_id, k.key FROM k JOIN b USING (txn_id)
        WHERE EXISTS (SELECT 1 FROM k o WHERE o.key = k.key AND o.txn_id <> k.txn_id AND o.commit_order > b.hi AND o.commit_order < b.own)""",
    "vacuum_dropped": f"WITH {_WAL}, {_VACUUM} SELECT * FROM dr",
    "vacuum_kept": f"WITH {_WAL}, {_VACUUM} SELECT key, lsn, commit_order FROM v WHERE lsn NOT IN (SELECT lsn FROM dr)",
    "vacuum_cutoff": f"""WITH {_WAL}, o AS (SELECT txn_id FROM w GROUP BY txn_id HAVING count(*) FILTER (op IN ('COMMIT', 'ABORT')) = 0)
        SELECT coalesce((SELECT min(txn_id) FROM o), (SELECT max(commit_order) FROM cm), 0)::BIGINT AS cutoff""",
    "txn_status": f"""WITH {_WAL} SELECT txn_id, count(*) FILTER (op IN ('PUT', 'DELETE')) AS n_writes,
        CASE WHEN bool_or(op = 'COMMIT') THEN 'committed' WHEN bool_or(op = 'ABORT') THEN 'aborted' ELSE 'active' END AS status FROM w GROUP BY txn_id""",
    "next_txn_id": f"WITH {_WAL} SELECT coalesce(max(txn_id), 0) + 1 AS next_txn_id FROM w",
    "wal_round_trip": f"WITH {_WAL} SELECT * FROM w",
    "secret_findings": f"WITH {_FILES}, {_SECRETS} SELECT * FROM sf",
    "secret_severity_counts": f"""WITH {_FILES}, {_SECRETS} SELECT count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium,
        count(*) FILTER (severity = 'low') AS low, count(*) AS total FROM sf""",
    "large_documents": f"WITH {_FILES}, {_LARGE} SELECT * FROM lf",
    "findings_report": f"WITH {_FILES}, {_SECRETS}, {_LARGE} SELECT * FROM sf UNION ALL SELECT *, 0::INT FROM lf",
    "human_sizes": f"WITH x AS (SELECT o_orderkey, floor(o_totalprice * pow(4.0, o_orderkey % 12)) AS s FROM orders) SELECT o_orderkey, {_human('s')} AS size FROM x",
    "path_ancestors": f"WITH {_PATHS} SELECT page_id, pos, prefix FROM an",
    "ignore_match": f"""WITH {_PATHS}, {_IGNORED}
        SELECT page_id, path, CASE WHEN r5 OR r4 THEN true WHEN r3 THEN false WHEN r2 OR r1 THEN true ELSE false END AS ignored FROM m""",
    "ignore_rules_match": f"""WITH {_PATHS}, {_IGNORED},
        x AS (SELECT page_id + 100 AS i, array_to_string(seg, '/') AS p, page_id % 2 <> 0 AS yes FROM sg WHERE page_id % 3 = 0 AND len(seg) > 0),
        l AS (SELECT an.page_id, max_by(yes, i) AS yes FROM an JOIN x ON an.prefix = x.p GROUP BY an.page_id)
        SELECT DISTINCT path, coalesce(yes, CASE WHEN r5 OR r4 THEN true WHEN r3 THEN false WHEN r2 OR r1 THEN true ELSE false END) AS ignored FROM m LEFT JOIN l USING (page_id)""",
    "tree_findings": f"WITH {_FILES}, {_SECRETS} SELECT severity, message, count(*) AS n FROM sf GROUP BY ALL",
    "ignore_audit": f"""WITH {_PATHS}, g AS (SELECT DISTINCT prefix, list_last(string_split(prefix, '/')) AS name FROM an),
        f AS (SELECT name, prefix, row_number() OVER (PARTITION BY name ORDER BY string_split(prefix, '/')) AS r FROM g WHERE name IN ('node_modules', '__pycache__', 'dist', 'build', '.env', '.venv'))
        SELECT prefix AS file_path, 'low' AS severity, 'Generated path is not ignored: ' || name AS message FROM f WHERE r = 1 AND name NOT IN ('node_modules', 'build')""",
    "snake_names": "SELECT p_partkey, lower(regexp_replace(trim(p_type), '[ -]', '_', 'g')) AS name, regexp_replace('a/' || p_name, '/?[^/]*$', '') AS folder FROM part",
    "raft_one_leader_per_term": f"WITH {_TRACE} SELECT seed, term, count(DISTINCT node_id) AS n_leaders FROM t WHERE state = 'LEADER' GROUP BY ALL",
    "raft_current_leader": f"""WITH {_TRACE}, r AS (SELECT seed, node_id, row_number() OVER (PARTITION BY seed ORDER BY term DESC, node_id) AS r FROM t WHERE state = 'LEADER')
        SELECT seed, node_id AS leader FROM r WHERE r = 1""",
    "raft_transitions": f"""WITH {_TRACE}, l AS (SELECT *, lag(state) OVER w AS was_state, lag(term) OVER w AS was_term, lag(commit_index) OVER w AS was_commit FROM t
            WINDOW w AS (PARTITION BY seed, node_id ORDER BY step))
        SELECT seed, node_id, step, was_state, state, was_term, term, commit_index > was_commit AS committed FROM l WHERE was_state IS NOT NULL AND (state <> was_state OR term <> was_term)""",
    "raft_quorum_commit": f"""WITH {_TRACE}, l AS (SELECT seed, term, node_id, max(log_length) AS n FROM t GROUP BY ALL),
        g AS (SELECT seed, term, count(*) AS n_nodes, list(n ORDER BY n DESC) AS ns FROM l GROUP BY ALL)
        SELECT seed, term, n_nodes, ns[n_nodes // 2 + 1] AS quorum_index FROM g""",
    "raft_elections": f"""WITH {_TRACE}, c AS (SELECT seed, term, count(DISTINCT node_id) FILTER (state = 'CANDIDATE') AS candidates, count(DISTINCT node_id) FILTER (state = 'FOLLOWER') AS voters,
            count(DISTINCT node_id) AS n FROM t GROUP BY ALL) SELECT seed, term, candidates, voters, voters >= n // 2 + 1 AS won FROM c""",
    "raft_up_to_date": f"""WITH {_TRACE}, n AS (SELECT seed, node_id, max({{'a': term, 'b': log_length}}) AS x FROM t GROUP BY ALL)
        SELECT seed, node_id, x >= max(x) OVER (PARTITION BY seed) AS fresh FROM n""",
    "raft_convergence": f"""WITH {_TRACE}, n AS (SELECT seed, count(DISTINCT node_id) AS n_nodes FROM t GROUP BY seed),
        i AS (SELECT seed, commit_index, count(DISTINCT node_id) AS holders, count(DISTINCT term) AS kinds FROM t GROUP BY ALL)
        SELECT seed, any_value(n_nodes) AS n_nodes, count(*) AS n_indexes, count(*) FILTER (holders < n_nodes OR kinds <> 1) AS n_diverged FROM i JOIN n USING (seed) GROUP BY seed""",
    "raft_deliveries": """
        WITH m AS (SELECT (user_id % 5)::INT AS from_id, (event_id % 5)::INT AS to_id, floor(value * 10)::INT AS due FROM events)
        SELECT from_id, to_id, CASE WHEN due > 300 THEN 'queued' WHEN (from_id IN (0, 1) AND to_id IN (2, 3)) OR (from_id IN (2, 3) AND to_id IN (0, 1)) THEN 'dropped' ELSE 'delivered' END AS outcome,
               count(*) AS n FROM m GROUP BY ALL""",
}
