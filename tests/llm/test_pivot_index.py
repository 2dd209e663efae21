"""Links of the pivot index against all pairs."""

import numpy as np
import pytest

from sparkloom.llm import pivot_index as pi

SCHEMA = "vec_id long, embedding array<double>, label int"


def unit(v):
    return v / np.linalg.norm(v, axis=-1, keepdims=True)


def near(rng, v, cosine):
    """A vector at exactly this cosine to ``v``."""
    side = rng.normal(size=v.shape)
    side -= (side * v).sum(-1, keepdims=True) * v
    return cosine * v + np.sqrt(1 - cosine**2) * unit(side)


def all_pairs(rows, threshold=0.93):
    """(vec_id, n_links, component_id, kept) by comparing everything."""
    good = [i for i, (_, v, label) in enumerate(rows) if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {i: set() for i in range(len(rows))}
    by = {}
    for i in good:
        by.setdefault((rows[i][2], len(rows[i][1])), []).append(i)
    for who in by.values():
        u = np.array([rows[i][1] for i in who])
        u = unit(u / np.abs(u).max(axis=1, keepdims=True))
        for a, b in zip(*np.nonzero(np.triu(u @ u.T >= threshold, 1)), strict=True):
            links[who[a]].add(who[b])
            links[who[b]].add(who[a])
    out = []
    for i, r in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            more = links[todo.pop()] - seen
            seen |= more
            todo += more
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        least = min(ids, default=None)
        out.append((r[0], len(links[i]), least, least is None or r[0] == least))
    return sorted(out, key=lambda r: tuple((x is None, x or 0) for x in r))


def found(df):
    return sorted((tuple(r) for r in df.select("vec_id", "n_links", "component_id", "kept").collect()), key=lambda r: tuple((x is None, x or 0) for x in r))


@pytest.fixture(scope="module")
def planted():
    """Far vectors, chains, close groups, a large group, copies, and every kind of row that links with nothing."""
    rng = np.random.default_rng(4)
    base = unit(rng.normal(size=(400, 48)))
    vectors = [(v, i % 3) for i, v in enumerate(base)]
    vectors += [(near(rng, base[i], 0.97), i % 3) for i in range(60)]
    vectors += [(near(rng, base[i], 0.97), (i + 1) % 3) for i in range(60)]
    vectors += [(near(rng, base[100], c), 1) for c in np.linspace(0.965, 0.999, 300)]
    vectors += [(base[101], 2)] * 40 + [(5 * base[102], 0)] * 5
    chain = base[103]
    for _ in range(6):
        chain = near(rng, chain, 0.96)
        vectors.append((chain, 1))
    rows = [(i, [float(x) for x in v], label) for i, (v, label) in enumerate(vectors)]
    v = rows[0][1]
    rows += [(2000, None, 1), (2001, [], 1), (2002, [0.0] * 48, 1), (2003, [None, *v[1:]], 0), (2004, [float("nan"), *v[1:]], 0), (2005, [float("inf"), *v[1:]], 0), (2006, v, None), (2007, v[:20], 0), (2008, v[:20], 0)]
    rows += [(None, v, 0), (0, v, 0), (2009, [x * 1e200 for x in v], 0), (2010, [x * 1e-200 for x in v], 0)]
    return rows


def test_equals_all_pairs(spark, planted):
    df = spark.createDataFrame(planted, SCHEMA).selectExpr("*", "1 as row", "2 as u", "'x' as near", "3 as ball", "4 as n", "5 as kept").repartition(4)
    assert found(pi.near_vectors(df)) == all_pairs(planted)


def test_pieces_and_blocks_change_nothing(spark, planted, monkeypatch):
    monkeypatch.setattr(pi, "PIECE_ROWS", 7)
    monkeypatch.setattr(pi, "BLOCK_ROWS", 5)
    assert found(pi.near_vectors(spark.createDataFrame(planted, SCHEMA))) == all_pairs(planted)


def test_recall_of_links_at_the_threshold(spark):
    """Each of 300 vectors has partners at cosines just above the threshold among 3,000 others."""
    rng = np.random.default_rng(6)
    base = unit(rng.normal(size=(3000, 64)))
    rows = [(i, v.tolist(), 0) for i, v in enumerate(base)] + [(10_000 + i, near(rng, base[i], c).tolist(), 0) for i, c in enumerate(np.linspace(0.9301, 0.95, 300))]
    links = sum(r[1] for r in found(pi.near_vectors(spark.createDataFrame(rows, SCHEMA))))
    truth = sum(r[1] for r in all_pairs(rows))
    assert truth >= 600 and 0.9 <= links / truth <= 1


def test_real_tables_and_empty_ones(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    assert found(pi.near_vectors(df)) == all_pairs([tuple(r) for r in df.select("vec_id", "embedding", "label").collect()])
    assert found(pi.near_vectors(df.where("false"))) == []
    assert found(pi.near_vectors(df.limit(3).selectExpr("vec_id", "cast(null as array<float>) as embedding", "label"))) == [(r["vec_id"], 0, r["vec_id"], True) for r in df.limit(3).orderBy("vec_id").collect()]
