import random
from collections import defaultdict

import numpy as np
import pytest

from sparkloom.llm import near_dedup as N


def brute_groups(rows, threshold=0.8):
    """Smallest id of each connected component of exact similarities, over all pairs that share a shingle."""
    sets = {}
    for i, text in rows:
        w = (text or "").split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else {()}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    inverse = defaultdict(list)
    for i in sorted(sets):
        shared = defaultdict(int)
        for s in sets[i]:
            for j in inverse[s]:
                shared[j] += 1
            inverse[s].append(i)
        for j, n in shared.items():
            if n / (len(sets[i]) + len(sets[j]) - n) >= threshold:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


def near(rng, words, share):
    out = list(words)
    for _ in range(int(share * len(words))):
        out[rng.randrange(len(out))] = f"w{rng.random()}"
    return out


@pytest.fixture(scope="module")
def planted():
    """Copies, near copies at many distances, a chain, groups that share a third of their words."""
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(3000)}"
    rows, k = [], 0
    common = [word() for _ in range(60)]
    for g in range(40):
        base = [word() for _ in range(120)] + (common if g % 2 else [])
        for c in range(6):
            rows.append((k, " ".join(near(rng, base, (0, 0.01, 0.02, 0.05, 0.0, 0.01)[c]))))
            k += 1
    link = [word() for _ in range(200)]
    for _ in range(12):
        rows.append((k, " ".join(link)))
        k += 1
        at = rng.randrange(180)
        link[at : at + 3] = [word() for _ in range(3)]
    return rows


@pytest.mark.parametrize("pair_rows, block_rows", [(32, 256), (0, 256), (0, 2)])
def test_groups_equal_brute_force(make_docs, planted, monkeypatch, pair_rows, block_rows):
    """Pairs, whole buckets, and many small blocks."""
    monkeypatch.setattr(N, "PAIR_ROWS", pair_rows)
    monkeypatch.setattr(N, "BLOCK_ROWS", block_rows)
    got = {r["doc_id"]: r["group_id"] for r in N.near_duplicates(make_docs(*planted)).collect()}
    assert got == brute_groups(planted)


def test_nulls_empty_short_and_repeated(make_docs):
    rows = [(4, None), (3, ""), (2, " \n"), (9, "one two"), (8, "one  two"), (None, "one two"), (7, "two one"), (6, "x " * 50_000), (6, "x " * 50_000)]
    got = sorted((r["doc_id"] or 0, r["group_id"], r["kept"]) for r in N.near_duplicates(make_docs(*rows)).collect())
    assert got == [(0, None, True), (2, 2, True), (3, 2, False), (4, 2, False), (6, 6, True), (6, 6, True), (7, 7, True), (8, 8, True), (9, 8, False)]
    assert sorted(r["doc_id"] or 0 for r in N.drop_near_duplicates(make_docs(*rows)).collect()) == [0, 2, 6, 6, 7, 8]
    assert N.near_duplicates(make_docs((1, "a")).where("false")).count() == 0


def test_estimates_follow_weighted_similarity():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 2**63, 3000).astype(np.uint64)
    sets, weights, true = [], [], []
    for _ in range(30):
        n = int(rng.integers(5, 600))
        a = rng.choice(pool, n, replace=False)
        b = np.unique(np.concatenate((a[: int(n * rng.random())], rng.choice(pool, n // 2 + 1))))
        w = dict(zip(pool.tolist(), rng.choice([0.5, 1, 3, 7.5], len(pool)), strict=True))
        wa, wb = np.array([w[x] for x in a.tolist()]), np.array([w[x] * 2 for x in b.tolist()])
        da, db = dict(zip(a.tolist(), wa, strict=True)), dict(zip(b.tolist(), wb, strict=True))
        keys = da.keys() | db.keys()
        true.append(sum(min(da.get(x, 0), db.get(x, 0)) for x in keys) / sum(max(da.get(x, 0), db.get(x, 0)) for x in keys))
        sets += [a, b]
        weights += [wa, wb]
    owner = np.repeat(np.arange(60), [len(s) for s in sets])
    s = N.dart_signatures(np.concatenate(sets), owner, np.concatenate(weights), 60, 512)
    got = np.array([(s[2 * i] == s[2 * i + 1]).mean() for i in range(30)])
    assert np.abs(got - true).max() < 0.09 and abs((got - true).mean()) < 0.02
    alone = N.dart_signatures(sets[5], np.zeros(len(sets[5]), int), weights[5], 1, 512)
    assert (alone[0] == s[5]).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (200, 200)]
    got = {r["node"]: r["component"] for r in N.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 103: 100}
