"""Ranked search against plain counting of all documents."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from sparkloom.llm import lexical_search as ls

ITEMS = "item_id long, text string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def cut(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, k):
    """(item_id, rank, doc_id, score) by the contract's formula, every document scored whole."""
    found = [(i, cut(t)) for i, t in docs]
    n_docs, n_terms = sum(bool(t) for _, t in found), sum(len(t) for _, t in found)
    df = Counter(t for _, ts in found for t in set(ts))
    out = []
    for item, text in items:
        scored = []
        for doc, ts in found:
            tf, score = Counter(ts), 0
            for t in cut(text):
                if tf[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * ((1000000000 * tf[t]) // (1000 * tf[t] + 12 * (100 - 25 + (25 * len(ts) * n_docs) // n_terms)))
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        out += [(item, r + 1, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scored)[:k])]
    return out


def rows(df):
    return [tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()]


def key(r):
    return tuple((x is None, x or 0) for x in r)


@pytest.fixture(scope="module")
def some():
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(60)] + ["Été", "été", "日本", "x_y"]
    p = 1 / np.arange(1, len(words) + 1)
    docs = [(i, " ".join(rng.choice(words, rng.integers(0, 40), p=p / p.sum()))) for i in range(500)]
    docs += [(1000, None), (1001, ""), (1002, "..."), (1003, "w0 " * 30_000), (None, "w1 w2 w3"), (1004, docs[7][1]), (1005, docs[7][1]), (7, docs[7][1]), (7, "w9 w9")]
    items = [(i, " ".join(rng.choice(words, 12))) for i in range(12)] + [(50, None), (51, "!"), (52, "unknown"), (53, "W1 w1 ÉTÉ été"), (None, "w2"), (0, "w3 w4")]
    return docs, items


@pytest.mark.parametrize("k", [1, 20, 700])
def test_equals_plain_counting(spark, make_docs, some, k):
    docs, items = some
    got = rows(ls.search(make_docs(*docs).repartition(5), spark.createDataFrame(items, ITEMS), k))
    assert sorted(got, key=key) == sorted(plain(docs, items, k), key=key)


def test_passes_and_segments_change_nothing(spark, make_docs, some, monkeypatch):
    docs, items = some
    monkeypatch.setattr(ls, "ITEM_BLOCK", 5)
    got = rows(ls.search(make_docs(*docs), spark.createDataFrame(items, ITEMS), 5))
    assert sorted(got, key=key) == sorted(plain(docs, items, 5), key=key)


def test_intervals_close_on_members_ties_and_scores():
    rng = np.random.default_rng(5)
    size, n_terms = 3000, 12
    n = rng.integers(5, 50, size)
    pairs = np.unique(np.stack([rng.integers(0, size, 12_000), rng.integers(0, n_terms, 12_000)]), axis=1)
    tf = rng.integers(1, 3, pairs.shape[1])  # few values, so many equal scores
    made = ls.Segment(n, pairs[0], pairs[1], tf, size, int(n.sum()), n_terms)
    query = [(t, int(w)) for t, w in enumerate(rng.integers(1, 4, n_terms))]
    whole = np.zeros(size, np.int64)
    m = 75 + (25 * n * size) // n.sum()
    for d, t, f in zip(*pairs, tf, strict=True):
        whole[d] += query[t][1] * ((1_000_000_000 * f) // (1000 * f + 12 * m[d]))
    for k in (1, 10, 200):
        docs, scores = made.best(query, k)
        bar = np.sort(whole)[-k]
        assert set(docs) == set(np.flatnonzero(whole >= bar)) and (scores == whole[docs]).all()


def test_other_columns_and_empty_tables(spark, make_docs):
    docs = make_docs((1, "a b"), (2, "b")).selectExpr("*", "1 as n", "2 as raw", "'x' as terms", "3 as rank", "4 as score")
    items = spark.createDataFrame([(5, "b")], ITEMS).selectExpr("*", "1 as item", "2 as raw")
    assert len(rows(ls.search(docs, items))) == 2
    assert rows(ls.search(docs.where("false"), items)) == [] == rows(ls.search(docs, items.where("false")))
    with pytest.raises(ValueError):
        ls.search(docs, items, 0)
