"""The stored graph: links against a plain loop, searches, insertion, saving."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import graph_index as gi
from sparkloom.operators import knn
from sparkloom.shipping import checkpoint

SCHEMA = "vec_id long, v array<double>"


def unit(v):
    return v / np.linalg.norm(v, axis=-1, keepdims=True)


def corpus(spark, v, first=0):
    return spark.createDataFrame([(first + i, r) for i, r in enumerate(np.asarray(v, float).tolist())], SCHEMA)


def asked(c, step):
    return c.where(F.col("vec_id") % step == 0).select(F.col("vec_id").alias("qid"), "v")


def plain_links(v, m, cap):
    """The build as a plain loop over nodes: diverse links to the nearest, both ways, selected anew above the cap, kept
    where both ends keep them."""
    x = unit(np.asarray(v)).astype(np.float32)
    d = 1 - x @ x.T

    def pick(i, candidates, most):
        candidates = sorted(candidates, key=lambda j: (d[i, j], j))
        kept = []
        for j in candidates:
            if len(kept) < most and all(d[i, j] < d[j, k] for k in kept):
                kept.append(j)
        return set(kept + [j for j in candidates if j not in kept][: most - len(kept)])

    around = {i: set() for i in range(len(x))}
    for i in range(len(x)):
        nearest = sorted((j for j in range(len(x)) if j != i), key=lambda j: (d[i, j], j))[: 3 * m]
        for j in pick(i, nearest, cap):
            around[i].add(j)
            around[j].add(i)
    kept = {i: pick(i, a, cap) if len(a) > cap else a for i, a in around.items()}
    return {(i, j) for i in kept for j in kept[i] if i in kept[j]}


def test_links_equal_a_plain_loop():
    v = np.random.default_rng(1).normal(size=(150, 12))
    p = gi.Piece(np.arange(150), v, np.zeros(150, np.int8)).build(gi.Settings(m=3))
    got = set(zip(*(a.tolist() for a in p.layers[0].pairs()), strict=True))
    want = plain_links(v, 3, 6)
    assert want <= got and len(got - want) <= 4  # bridges between parts, if any


def test_every_node_is_reached_and_ties_go_by_id(spark):
    rng = np.random.default_rng(2)
    v = np.concatenate((rng.normal(size=(200, 8)), np.tile(rng.normal(size=(1, 8)), (60, 1)), np.zeros((3, 8))))
    c = checkpoint(corpus(spark, v))
    q = asked(c, 13)
    for kind in ("layered", "flat"):
        for metric in ("cosine", "euclidean"):
            index = gi.build(c, gi.Settings(m=4, kind=kind, metric=metric))
            want = {(r["qid"], r["rank"]): r["dist"] for r in knn.knn(q, c, 7, metric).collect()}
            got = {(r["qid"], r["rank"]): r["dist"] for r in gi.search(index, q, 7, ef=300).collect()}
            assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in got)


def test_structure_after_build_and_insertion(spark):
    rng = np.random.default_rng(3)
    c = checkpoint(corpus(spark, rng.normal(size=(900, 16))))
    index = gi.insert(gi.build(c.where("vec_id < 800"), gi.Settings(m=6), piece_rows=250), c.where("vec_id >= 800"))
    assert index.count() == 900 and {r["vec_id"] for r in index.nodes().collect()} == set(range(900))
    level = {r["vec_id"]: r["level"] for r in index.nodes().collect()}
    edges = [(r["layer"], r["src"], r["dst"]) for r in index.edges().collect()]
    assert len(set(edges)) == len(edges) and set(edges) == {(k, b, a) for k, a, b in edges}
    assert all(level[a] >= k and level[b] >= k and a != b for k, a, b in edges)
    most = {k: max(np.bincount([a for j, a, _ in edges if j == k])) for k in {k for k, _, _ in edges}}
    assert most[0] <= 2 * 6 + 4 and all(n <= 6 + 4 for k, n in most.items() if k)


def test_insertion_keeps_recall_and_leaves_other_pieces_alone(spark):
    rng = np.random.default_rng(4)
    base = unit(rng.normal(size=(12, 24)))
    v = unit(base[np.arange(3000) % 12] + 0.25 * rng.normal(size=(3000, 24)))
    near = unit(base[0] + 0.2 * rng.normal(size=(300, 24)))  # all to few cells
    c, more = checkpoint(corpus(spark, v)), checkpoint(corpus(spark, near, 10_000))
    both = checkpoint(c.unionByName(more))
    q = asked(both, 25)
    truth = checkpoint(knn.knn(q, both, 10))
    s = gi.Settings(m=8)
    before = gi.build(c, s, piece_rows=300)
    after = gi.insert(before, more, piece_rows=300)

    def found(index):
        return knn.recall(truth, gi.search(index, q, 10, ef=32), 10).agg(F.avg("recall")).first()[0]

    assert found(after) >= found(gi.build(both, s, piece_rows=300)) - 0.02
    assert found(after) >= 0.9
    old = {(r["cell"], r["code"], r["salt"]): (r["n"], bytes(r["ids"]), [bytes(x["dst"]) for x in r["layers"]]) for r in before.pieces.collect()}
    new = {(r["cell"], r["code"], r["salt"]): (r["n"], bytes(r["ids"]), [bytes(x["dst"]) for x in r["layers"]]) for r in after.pieces.collect()}
    same = sum(new[k] == p for k, p in old.items())
    assert old.keys() <= new.keys() and same >= len(old) // 2 and sum(p[0] for p in new.values()) == 3300


def test_untouched_nodes_keep_their_links():
    rng = np.random.default_rng(5)
    v, s = unit(rng.normal(size=(400, 16))), gi.Settings(m=5)
    level = np.zeros(420, np.int8)
    had = gi.Piece(np.arange(400), v, level[:400]).build(s)
    new = unit(v[:20] + 0.05 * rng.normal(size=(20, 16)))
    out = had.insert(np.arange(400, 420), new, level[400:], s)
    a, b = (set(zip(*(x.tolist() for x in p.layers[0].pairs()), strict=True)) for p in (had, out))
    beside = {j for i, j in b if i >= 400}
    assert all(i in beside or j in beside for i, j in a ^ b if i < 400 and j < 400)
    assert all(any(i == k for i, _ in b) for k in range(400, 420))


def test_crowded_insertions_become_pieces(spark):
    rng = np.random.default_rng(6)
    c = checkpoint(corpus(spark, rng.normal(size=(100, 8))))
    more = checkpoint(corpus(spark, rng.normal(size=(500, 8)) * 0.01 + 1, 1000))
    index = gi.insert(gi.build(c, piece_rows=400), more, piece_rows=120)
    assert index.count() == 600 and max(r["n"] for r in index.pieces.collect()) <= 200
    q = asked(more, 50)
    truth = knn.knn(q, checkpoint(c.unionByName(more)), 5)
    assert knn.recall(truth, gi.search(index, q, 5, ef=200), 5).agg(F.min("recall")).first()[0] == 1


def test_large_cells_are_cut_and_probed(spark):
    """A table with one hot cell of near vectors and pieces far smaller than it keeps its recall, and so does a search of
    the nearest cells where the vectors lie in clusters."""
    rng = np.random.default_rng(7)
    hot = rng.normal(size=16) + 0.3 * rng.normal(size=(1400, 16))
    c = checkpoint(corpus(spark, np.concatenate((hot, 4 * rng.normal(size=(600, 16))))))
    index = gi.build(c, piece_rows=150)
    sizes = [r["n"] for r in index.pieces.collect()]
    assert max(sizes) <= 300 and len(sizes) > 8
    q = asked(c, 40)
    truth = checkpoint(knn.knn(q, c, 10))
    for probes, least in ((None, 0.95), (8, 0.9)):
        assert knn.recall(truth, gi.search(index, q, 10, 48, probes), 10).agg(F.avg("recall")).first()[0] >= least


def test_saved_and_loaded(spark, tmp_path):
    c = checkpoint(corpus(spark, np.random.default_rng(8).normal(size=(300, 8))))
    index = gi.build(c, gi.Settings(m=4, single=True), piece_rows=100)
    gi.save(index, f"{tmp_path}/index")
    again = gi.load(spark, f"{tmp_path}/index")
    q = asked(c, 30)
    rows = lambda i: sorted(map(tuple, gi.search(i, q, 5, 50).collect()))
    assert rows(again) == rows(index) and again.settings == index.settings
    assert gi.insert(again, corpus(spark, [[1.0] * 8], 999)).count() == 301


def test_odd_tables_and_settings(spark):
    none = spark.createDataFrame([], SCHEMA)
    q = spark.createDataFrame([(0, [1.0, 0.0]), (1, None)], "qid long, v array<double>")
    index = gi.build(none)
    assert gi.search(index, q, 3).count() == 0 and index.count() == 0
    one = gi.insert(index, corpus(spark, [[1.0, 0.0]]))
    assert [tuple(r) for r in gi.search(one, q, 3).collect()] == [(0, 1, 0, 0.0)]
    assert gi.build(spark.createDataFrame([(1, None), (None, [1.0])], SCHEMA)).count() == 0
    assert gi.search(one, q.where("false"), 3).count() == 0
    for bad in ({"m": 1}, {"metric": "manhattan"}, {"kind": "round"}):
        with pytest.raises(ValueError):
            gi.Settings(**bad)
    with pytest.raises(ValueError):
        gi.search(one, q, 0)


def test_sweep_reports_recall_and_times(spark):
    c = checkpoint(corpus(spark, np.random.default_rng(9).normal(size=(400, 8))))
    rows = gi.timed_sweep(gi.build(c), asked(c, 20), c, 10, (10, 64), rounds=1)
    assert [r["ef"] for r in rows] == [10, 64] and rows[1]["mean_recall"] >= 0.95 and rows[0]["speedup"] > 0


def test_beams_as_wide_as_a_piece_do_not_walk(spark, monkeypatch):
    """Wide beams take steps that sort them whole, a time that grows with the square of a piece; they compare what the
    links reach at once. Narrow ones walk."""
    c = checkpoint(corpus(spark, np.random.default_rng(10).normal(size=(600, 8))))
    p = gi.Piece(np.arange(600), np.random.default_rng(10).normal(size=(600, 8)), np.zeros(600, np.int8)).build(gi.Settings(m=4))
    walked = []
    monkeypatch.setattr(gi, "_beam", lambda q, x, links, starts, ef, metric: walked.append(ef) or (starts[:, :1], np.zeros((len(q), 1), np.float32)))
    best = knn.Best(p.v[:5], 7, "cosine")
    p.search(best, np.arange(5), 600, gi.Settings(m=4))
    assert not walked
    d = knn.distances(p.v[:5], p.v, "cosine")
    assert best.ids.reshape(5, 7).tolist() == [np.lexsort((p.ids, r))[:7].tolist() for r in d]
    p.search(knn.Best(p.v[:5], 7, "cosine"), np.arange(5), 16, gi.Settings(m=4))
    assert walked == [16]
    assert gi.search(gi.build(c, gi.Settings(m=4)), asked(c, 50), 5, ef=600).count() == 60


def test_wide_beams_find_nothing_that_links_do_not_reach():
    v = np.random.default_rng(11).normal(size=(40, 6))
    p = gi.Piece(np.arange(40), v, np.zeros(40, np.int8)).build(gi.Settings(m=4))
    src, dst = p.layers[0].pairs()
    same = (src < 20) == (dst < 20)
    p.layers[0] = gi.Links.of(40, src[same], dst[same])
    for kind, metric in (("layered", "cosine"), ("flat", "euclidean")):
        s, q = gi.Settings(m=4, kind=kind, metric=metric), np.random.default_rng(12).normal(size=(30, 6))
        best = knn.Best(q, 5, metric)
        p.search(best, np.arange(30), 40, s)
        found, d = p._walk(gi.prepared(q, metric).astype(np.float32), gi.prepared(v, metric).astype(np.float32), s, 40, 0)
        for r in range(30):
            reached = found[r][np.isfinite(d[r])]
            assert len(reached) < 40 and best.ids[best.who == r].tolist() == reached[:5].tolist()


def test_links_of_a_full_piece_take_bounded_memory():
    import tracemalloc

    p = gi.Piece(np.arange(3000), np.random.default_rng(13).normal(size=(3000, 64)), np.zeros(3000, np.int8))
    s = gi.Settings()
    tracemalloc.start()
    p.build(s)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 60 << 20
