import json

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import text
from sparkloom.operators import consensus, metrics, mvcc, scan
from sparkloom.sources import files

LOG = "lsn long, txn_id long, op string, key string, value string"


def log(spark, *records):
    rows = [(i, *r, *[None] * (4 - len(r))) for i, r in enumerate(records)]
    return spark.createDataFrame(rows, LOG)


def state(df):
    return {r["key"]: r["value"] for r in df.collect()}


def test_recovery_keeps_committed_writes_only(spark):
    w = log(spark, (1, "PUT", "a", "1"), (1, "PUT", "b", "2"), (1, "COMMIT"), (2, "PUT", "a", "10"), (2, "COMMIT"), (3, "PUT", "c", "3"), (3, "PUT", "a", "999"))
    assert state(mvcc.snapshot(mvcc.versions(w))) == {"a": "10", "b": "2"}
    assert mvcc.next_txn_id(w).first()[0] == 4
    assert {r["txn_id"]: r["status"] for r in mvcc.status(w).collect()} == {1: "committed", 2: "committed", 3: "active"}


def test_snapshots_and_deletions(spark):
    w = log(spark, (1, "PUT", "k", "1"), (1, "COMMIT"), (2, "PUT", "k", "2"), (2, "COMMIT"), (3, "DELETE", "k"), (3, "COMMIT"))
    v = mvcc.versions(w)
    assert [state(mvcc.snapshot(v, h)) for h in (0, 1, 2, 3)] == [{}, {"k": "1"}, {"k": "2"}, {}]


def test_double_write_and_write_after_commit(spark):
    w = log(spark, (1, "PUT", "k", "old"), (1, "PUT", "k", "new"), (1, "COMMIT"), (1, "PUT", "k", "late"))
    v = mvcc.versions(w)
    assert state(mvcc.snapshot(v)) == {"k": "new"}
    kept = [r["value"] for r in mvcc.vacuum(v, 1).where("not dropped").collect()]
    assert kept == ["new"]


def test_first_committer_wins(spark):
    w = log(spark, (1, "PUT", "x", "1"), (2, "PUT", "x", "2"), (2, "PUT", "y", "2"), (1, "COMMIT"), (2, "COMMIT"))
    begun = spark.createDataFrame([(1, 0), (2, 0)], "txn_id long, snapshot_hi long")
    assert [(r["txn_id"], r["key"]) for r in mvcc.conflicts(mvcc.versions(w), begun).collect()] == [(2, "x")]


def test_vacuum_keeps_what_readers_see(spark):
    w = log(spark, *[r for t in (1, 2, 3, 4) for r in ((t, "PUT", "k", str(t)), (t, "COMMIT"))])
    v = mvcc.vacuum(mvcc.versions(w), 2)
    assert sorted(r["value"] for r in v.where("not dropped").collect()) == ["2", "3", "4"]
    assert mvcc.vacuum_cutoff(w, spark.createDataFrame([(2,)], "snapshot_hi long")).first()[0] == 2
    assert mvcc.vacuum_cutoff(w, spark.createDataFrame([], "snapshot_hi long")).first()[0] == 4


def test_log_lines_round_trip_and_torn_tail(spark, tmp_path):
    w = log(spark, (1, "PUT", "a", "1"), (1, "COMMIT"), (2, "DELETE", "b"))
    assert mvcc.decode(mvcc.encode(w)).exceptAll(w).count() == 0
    torn = spark.createDataFrame([(0, '{"txn_id":1,"op":"PUT","key":"a"'), (1, " "), (2, '{"txn_id":1,"op":"NOPE"}'), (3, '{"txn_id":1,"op":"COMMIT"}')], "lsn long, line string")
    assert [r["lsn"] for r in mvcc.decode(torn).collect()] == [3]
    files.append_log(w, str(tmp_path / "log"))
    assert files.scan_log(spark, str(tmp_path / "log")).count() == 3
    (tmp_path / "log" / "tail.json").write_text('{"lsn":9,"txn_id":3,"op":"PU')
    assert files.scan_log(spark, str(tmp_path / "log")).count() == 3


def test_empty_log(spark):
    w = log(spark).where("false") if False else spark.createDataFrame([], LOG)
    assert mvcc.snapshot(mvcc.versions(w)).count() == 0 and mvcc.next_txn_id(w).first()[0] == 1


def test_ignore_rules(spark):
    rules = scan.compile_rules(["# c", "", "*.log", "!keep.log", "build/", "/top", "a/**/z", "x[!0-9]y", "q[", "d?t"])
    want = {
        "a.log": True, "b/a.log": True, "keep.log": False, "build": False, "build/x": True, "s/build/x": True, "top": True, "s/top": False,
        "a/z": True, "a/b/c/z": True, "a/b": False, "xay": True, "x1y": False, "q[": True, "dot": True, "doot": False, "": False,
    }
    df = spark.createDataFrame([(p,) for p in want], "path string")
    got = {r["path"]: r["i"] for r in df.select("path", scan.ignored(F.col("path"), rules).alias("i")).collect()}
    assert got == want


def test_secrets_report_and_counts(spark):
    key = "AKIA" + "ABCDEFGHIJKLMNOP"
    rows = [("b.py", f'x\npassword = "hunter22"\r\n{key}'), ("a.py", 'token = "changeme12"'), ("c.bin", f"\0{key}"), ("d", None), ("e", 'api_key: "abcdefgh"')]
    found = scan.findings_of_lines(spark.createDataFrame(rows, "path string, text string"))
    got = [(r["file_path"], r["severity"], r["line_number"]) for r in scan.report(found).collect()]
    assert got == [("b.py", "high", 2), ("b.py", "high", 3), ("e", "medium", 1)]
    assert scan.severity_counts(found).first().asDict() == {"high": 2, "medium": 1, "low": 0, "total": 3}


def test_large_files_are_strictly_above_the_limit(spark):
    df = spark.createDataFrame([("a", 5 * 1024 * 1024), ("b", 5 * 1024 * 1024 + 1), ("skip/c", 1 << 40)], "path string, size long")
    got = scan.large_files(df, scan.compile_rules(["skip/"])).collect()
    assert [(r["file_path"], r["message"]) for r in got] == [("b", "Large file: 5.0 MB")]


def test_human_size_and_paths(spark):
    df = spark.createDataFrame([(0,), (1023,), (1024,), (1536 * 1024,), (1 << 40,)], "n long")
    assert [r[0] for r in df.select(text.human_size(F.col("n"))).collect()] == ["0 B", "1023 B", "1.0 KB", "1.5 MB", "1.0 TB"]
    p = spark.createDataFrame([("a/b/c",), ("a",), ("",)], "p string").select(text.ancestors(F.col("p")), text.parent(F.col("p"))).collect()
    assert [r[0] for r in p] == [["a", "a/b", "a/b/c"], ["a"], []] and [r[1] for r in p] == ["a/b", "", ""]


def test_tree_sees_hidden_files_and_audit_finds_generated_paths(spark, tmp_path):
    for name in (".env", "src/a.py", "node_modules/x/i.js", ".git/config", "z/dist/o"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x = 1")
    t = files.tree(spark, str(tmp_path))
    assert {r["path"] for r in t.collect()} == {".env", "src/a.py", "node_modules/x/i.js", "z/dist/o"}
    got = {r["file_path"] for r in scan.audit(t, scan.compile_rules(["dist/"]), has_ignore_file=False).collect()}
    assert got == {".env", "node_modules", ".gitignore"}


def test_loaders(spark, tmp_path):
    import numpy as np

    np.save(tmp_path / "m.npy", np.arange(6.0).reshape(3, 2))
    assert [r["v"] for r in files.load(spark, str(tmp_path / "m.npy")).orderBy("vec_id").collect()] == [[0, 1], [2, 3], [4, 5]]
    (tmp_path / "r.json").write_text(json.dumps({"a": 1}))
    assert files.load(spark, str(tmp_path / "r.json"), "a int").first()["a"] == 1
    (tmp_path / "r.csv").write_text("a,b\n1,x\n")
    assert files.load(spark, str(tmp_path / "r.csv")).first().asDict() == {"a": 1, "b": "x"}
    v = files.random_unit_vectors(spark, 10, 4)
    files.save_index({"nodes": v}, str(tmp_path / "idx"))
    assert files.load_index(spark, str(tmp_path / "idx"), ("nodes",))["nodes"].count() == 10
    with pytest.raises(ValueError):
        files.random_unit_vectors(spark, 1, 0)


def test_metrics(spark):
    df = spark.createDataFrame([(1, 1, 0.9), (1, 0, 0.4), (0, 0, 0.4), (0, 0, 0.1), (None, 1, 0.5)], "label int, predicted int, score double")
    m = metrics.classification(df).first()
    assert (m["tp"], m["fp"], m["fn"], m["tn"], m["precision"], m["recall"]) == (1, 0, 1, 2, 1.0, 0.5)
    assert metrics.auc(df).first()["auc"] == pytest.approx((2 + 1.5) / 4)
    assert metrics.auc(df.where("label = 1")).first()["auc"] is None
    none = metrics.classification(df.where("false")).first()
    assert none["accuracy"] == 0 and none["f1"] == 0


def test_trace_invariants(spark):
    rows = [(1, 0, 0, 1, "LEADER", 0, 3), (1, 1, 1, 1, "FOLLOWER", 0, 2), (1, 2, 2, 1, "FOLLOWER", 0, 1), (1, 3, 1, 1, "LEADER", 1, 2)]
    t = spark.createDataFrame(rows, "seed int, step long, node_id int, term int, state string, commit_index int, log_length int")
    assert consensus.leaders_by_term(t).first()["n_leaders"] == 2
    assert consensus.quorum_commit(t).first()["quorum_index"] == 2
    assert consensus.current_leader(t).first()["leader"] == 0
    x = consensus.transitions(t).collect()
    assert [(r["node_id"], r["state"], r["committed"]) for r in x] == [(1, "LEADER", True)]
    m = spark.createDataFrame([(0, 2, 5), (0, 4, 5), (2, 1, 50)], "from_id int, to_id int, due int")
    assert {(r["from_id"], r["outcome"]) for r in consensus.deliveries(m, 10, [0, 1], [2, 3]).collect()} == {(0, "dropped"), (0, "delivered"), (2, "queued")}


def test_hot_keys_and_long_traces_are_cut_into_ranges(spark):
    """One node with nine tenths of the rows and one key of 10^4 versions, in ranges of a few hundred rows."""
    import random

    rng = random.Random(4)
    steps = [(1, s, 0 if rng.random() < 0.9 else rng.randint(1, 5), rng.randint(0, 3), rng.choice(["LEADER", "FOLLOWER"]), rng.randint(0, 9), 1) for s in range(4000)]
    t = spark.createDataFrame(steps, "seed int, step long, node_id int, term int, state string, commit_index int, log_length int")
    got = sorted(map(tuple, consensus.transitions(t, range_rows=300).collect()))
    assert got == sorted(map(tuple, consensus.transitions(t).collect()))
    want, last = [], {}
    for seed, s, node, term, state, commit, _ in steps:
        if node in last and last[node][:2] != (state, term):
            want.append((seed, node, s, last[node][0], state, last[node][1], term, commit > last[node][2]))
        last[node] = (state, term, commit)
    assert got == sorted(want)
    found = spark.range(10_000).selectExpr("if(id % 10 = 0, concat('k', id % 7), 'hot') as key", "id as txn_id", "id + 1 as commit_order", "id as lsn", "'v' as value")
    begun = spark.range(10_000).selectExpr("id as txn_id", "greatest(0, id - id % 4) as snapshot_hi")
    a, b = (sorted(map(tuple, mvcc.conflicts(found, begun, n).collect())) for n in (700, 1_000_000))
    keys = ["hot" if i % 10 else f"k{i % 7}" for i in range(10_000)]
    plain = [(i, k) for i, k in enumerate(keys) if any(keys[j] == k for j in range(i - i % 4, i))]
    assert a == b == sorted(plain)


def test_ranges_bound_what_a_window_holds(spark):
    from sparkloom.operators import ordered

    df = spark.range(5000).selectExpr("if(id < 4500, 'hot', 'cold') as key", "id")
    sizes = ordered._ranges(df, ["key"], "id", 500).groupBy("key", "range_").count().collect()
    assert max(r["count"] for r in sizes if r["key"] == "hot") <= 600 and [r["count"] for r in sizes if r["key"] == "cold"] == [500]
