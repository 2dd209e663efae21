import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import mixing as M


def brute_targets(sizes):
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: float(k % 3 + 1) for k, s in enumerate(order)}
    total = sum(sizes.values())
    capped: set = set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        free = [s for s in order if s not in capped]
        unit = rest / sum(weight[s] for s in free) if free else 0
        more = {s for s in free if weight[s] * unit > 3 * sizes[s]}
        if not more:
            return {s: 3.0 * sizes[s] if s in capped else weight[s] * unit for s in order}
        capped |= more


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_targets_sizes_and_taken_words(documents):
    rows = M.mix(documents).collect()
    texts = {r["doc_id"]: r for r in documents.collect()}
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in rows:
        assert r["size"] == words(texts[r["doc_id"]]["text"])
        assert r["taken"] == r["size"] * r["copies"] and 0 <= r["copies"] <= 3
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    want = brute_targets(sizes)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in want)


def test_caps_null_source_and_code_points(make_docs):
    rows = [(1, "w " * 5000, "a"), (2, "w w", "￿"), (3, "w", "\U00010000"), (4, "w w w", None), (5, None, None), (6, "", "empty"), (7, "w w", "B")]
    got = M.mix(make_docs(*rows)).collect()
    want = brute_targets({"a": 5000, "￿": 2, "\U00010000": 1, None: 3, "empty": 0, "B": 2})
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]])
    by = {r["doc_id"]: r for r in got}
    assert by[5]["size"] == 0 and by[5]["taken"] == 0 and by[2]["copies"] == 3 and by[3]["copies"] == 3


def test_reruns_agree_and_rows_are_whole(make_docs, documents):
    a, b = ({(r["doc_id"], r["copies"]) for r in M.mix(documents.repartition(n)).collect()} for n in (1, 5))
    assert a == b
    got = M.mixed_rows(documents)
    assert got.columns == documents.columns
    want = {r["doc_id"]: r["copies"] for r in M.mix(documents).collect()}
    counts = {r["doc_id"]: r["n"] for r in got.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert counts == {i: n for i, n in want.items() if n}


def test_many_cells(documents, monkeypatch):
    monkeypatch.setattr(M, "CELL_ROWS", 2)
    rows = M.mix(documents).collect()
    got, size = defaultdict(int), defaultdict(int)
    for r in rows:
        got[r["source"]] += r["taken"]
        size[r["source"]] = max(size[r["source"]], r["size"])
    assert all(abs(got[r["source"]] - r["target"]) <= size[r["source"]] for r in rows)


def test_priors_tilt(make_docs):
    docs = make_docs(*[(i, "w " * 10, "ab"[i % 2]) for i in range(200)])
    rows = M.mix(docs, prior=F.when(F.col("doc_id") < 100, 2.0).otherwise(0.5)).collect()
    total = defaultdict(int)
    for r in rows:
        total[r["source"]] += r["taken"]
    assert all(abs(total[r["source"]] - r["target"]) <= 10 for r in rows)
    mean = lambda keep: sum(r["rate"] for r in rows if keep(r["doc_id"])) / 100
    assert mean(lambda i: i < 100) > 1.5 * mean(lambda i: i >= 100)


def test_empty_table(make_docs):
    assert M.mix(make_docs((1, "a", "s")).where("false")).count() == 0
    assert M.mix(make_docs((1, None, None), (1, None, None))).count() == 2
