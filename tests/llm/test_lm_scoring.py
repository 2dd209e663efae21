"""The language model against plain loops: counts, probabilities, gradients, normalisation."""

import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sparkloom.llm import lm_scoring as S
from sparkloom.llm import maxent as M


def plain_tokens(text):
    ascii_lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", ascii_lower) + [None]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


def test_base_scores_against_plain_counting(make_docs, documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()] + [(5000, None), (5001, ""), (5002, "THE İ É the"), (5002, "THE İ É the"), (None, "of of"), (5003, "the " * 50_000)]
    got = sorted(S.lm_scores(make_docs(*rows), listed=500, steps=4, slices=4).collect(), key=lambda r: (r["doc_id"] or -1, r["n_tokens"]))
    c = Counter(t for i, x in rows if not held(i) for t in plain_tokens(x))
    n, v = sum(c.values()), len(c)
    assert len(got) == len(rows)
    for r, (i, x) in zip(got, sorted(rows, key=lambda r: (r[0] or -1, len(plain_tokens(r[1])))), strict=True):
        t = plain_tokens(x)
        assert (r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (i, held(i), len(t), sum(k in c for k in t), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[k] + 0.5) / (n + 0.5 * (v + 1))) for k in t))


@pytest.fixture(scope="module")
def trained(spark, make_docs, documents):
    """A model of few listed words, with pairs; its words and counts by plain loops."""
    texts = [r["text"] for r in documents.collect()] + ["alpha beta gamma. " * 40, "alpha beta delta " * 30, None, "alpha delta"]
    df = make_docs(*enumerate(texts)).select("text")
    counts = S.checkpoint(S.word_counts(df))
    lex = S.lexicon(counts, 300)
    words = spark.sparkContext.broadcast(lex)
    model, fits = S.train(df, lex, words, 6, 3)
    shared = spark.sparkContext.broadcast((lex, model))
    norms = S.rare_norms(counts, shared)
    plain = Counter(w for t in texts for w in S.tokens_of(t))
    return counts, lex, model, shared, norms, plain, fits


def plain_class_logs(model, history):
    """log P(class | history) of all classes, features added one by one."""
    c = model.classes
    m = M.ClassModel(c)
    w1, w2, w3 = (np.array([w], np.int32) for w in history)
    total = model.weights[0].astype(float)
    for f in m.features(c.of, w1, w2, w3):
        total = total + model.weights[int(f[0])]
    top = total.max()
    return total - top - math.log(sum(math.exp(x - top) for x in total))


def plain_score(trained, tokens):
    """log10 of the probability of ``tokens`` after each other, a word at a time."""
    _, lex, model, _, _, plain, _ = trained
    c, pairs = model.classes, model.pairs
    values = dict(zip(pairs.keys.tolist(), pairs.values.tolist(), strict=True))
    rests = dict(zip(pairs.heads.tolist(), pairs.rests.tolist(), strict=True))
    rare = {}
    for w, n in plain.items():
        if w not in lex.rank:
            k = c.of[c.n + M.code_of(w)]
            tokens_, distinct = rare.get(k, (0, 0))
            rare[k] = (tokens_ + n, distinct + 1)
    out, history = 0.0, [lex.end] * 3
    for w in tokens:
        place = lex.rank.get(w, c.n + M.code_of(w))
        k = int(c.of[place])
        out += plain_class_logs(model, history)[k] / math.log(10)
        if w in lex.rank:
            head = history[0] << 32
            if history[0] < c.n and head | place in values:
                out += values[head | place]
            else:
                out += float(model.tables[c.cluster[history[0]], place]) + (rests.get(head | k, 0.0) if history[0] < c.n else 0.0)
        else:
            n, distinct = rare.get(k, (0, 0))
            out += math.log10((plain[w] + 0.5) / (n + 0.5 * (distinct + 1)))
        history = [lex.end] * 3 if w == S.END else [place, *history[:2]]
    return out


def test_scores_against_a_word_at_a_time(trained, make_docs):
    counts, lex, model, shared, norms, _, _ = trained
    assert len(model.pairs.keys) > 2  # alpha beta, beta gamma., beta delta
    texts = ["alpha beta gamma. alpha beta delta", "", None, "never-seen alpha the of zzz beta", "alpha " * 2000 + "beta gamma.", "THE the unheard unheard of"]
    got = {r["doc_id"]: r["score"] for r in S.score_texts(make_docs(*enumerate(texts)).select("doc_id", "text"), counts, lex, shared, norms).collect()}
    for i, text in enumerate(texts):
        assert got[i] == pytest.approx(plain_score(trained, S.tokens_of(text)), rel=1e-4), text


def test_all_words_add_up_to_one(trained):
    """All listed words, all others of the training texts, and one unknown word a class of those."""
    _, lex, model, _, norms, plain, _ = trained
    c = model.classes
    others = [(w, n) for w, n in plain.items() if w not in lex.rank]
    places = np.concatenate((np.arange(c.n), [c.n + M.code_of(w) for w, _ in others])).astype(np.int32)
    code = {int(k): i for i, k in enumerate(c.of[c.n :])}  # some place of each class of unlisted words
    for history in ([lex.end] * 3, [lex.rank[b"alpha"], lex.end, lex.end], [lex.rank[b"beta"], lex.rank[b"alpha"], lex.end], [c.n + 77, 5, 9]):
        before = tuple(np.full(len(places), w, np.int32) for w in history)
        logs = model.scores(places, before)
        logs[c.n :] += [math.log10(n + 0.5) - norms[c.of[p] - c.rare] for (_, n), p in zip(others, places[c.n :], strict=True)]
        unknown = sum(math.exp(plain_class_logs(model, history)[c.rare + k]) * 0.5 / 10 ** norms[k] for k in range(c.count - c.rare))
        assert (10.0**logs).sum() + unknown == pytest.approx(1, abs=1e-4)
    assert len(code) <= c.count - c.rare


def test_gradient_is_that_of_the_likelihood(trained):
    model = trained[2]
    c = model.classes
    rng = np.random.default_rng(1)
    words = rng.integers(0, c.n + 50, 60).astype(np.int32)
    before = [rng.integers(0, c.n + 50, 60).astype(np.int32) for _ in range(3)]
    m = M.ClassModel(c)
    m.weights = model.weights.astype(np.float64)

    def fit():
        return M.gradient(m, c, words, before, m.summed())[1]

    parts, at = M.gradient(m, c, words, before, m.summed())
    total = np.zeros(m.weights.shape)
    for rows, error in parts:
        M._add_rows(total, rows, error)
    m.marginals(total)
    on = {0, *(int(f[k]) for f in m.features(c.of, *before) for k in range(3))}
    for row in sorted(on):
        for column in (0, m.count - 1, int(c.of[words[0]])):
            m.weights[row, column] += 1e-4
            assert (fit() - at) / 1e-4 == pytest.approx(total[row, column], abs=5e-3)
            m.weights[row, column] -= 1e-4


def test_words_of_a_class_reach_their_maximum():
    rng = np.random.default_rng(2)
    counts = rng.poisson(rng.gamma(0.3, 20, (5, 40))).astype(float)
    logs = M.train_words(counts, 25, 4.0) * math.log(10)
    assert np.exp(logs).sum(1) == pytest.approx(np.ones(5))
    bias = np.log(counts.sum(0) + 0.5)
    own = logs - bias
    own -= own.mean(1, keepdims=True) - ((counts - counts.sum(1, keepdims=True) * np.exp(logs)) / 4).mean(1, keepdims=True)
    slope = counts - counts.sum(1, keepdims=True) * np.exp(logs) - 4.0 * own
    assert np.abs(slope).max() < 0.02 * counts.max()


def test_clusters_part_texts_of_two_languages():
    rng = np.random.default_rng(3)
    a, b = rng.dirichlet(np.full(M.DIMS, 0.2), 2)
    rows = np.stack([rng.multinomial(60, a if i % 2 else b) for i in range(200)]).astype(float)
    own = M.cluster_words(rows, 2)
    assert len({*own[::2]}) == len({*own[1::2]}) == 1 and own[0] != own[1]
    assert len(M.cluster_words(np.zeros((0, M.DIMS)))) == 0


@pytest.fixture(scope="module")
def held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fit = {n: [r for r in S.lm_scores(docs, steps=n).collect() if r["held_out"]] for n in (S.STEPS // 2, S.STEPS)}
    print("held-out log10 likelihood by steps", {n: sum(r["score"] for r in rows) for n, rows in fit.items()})
    return fit


def test_model_beats_an_interpolated_bigram_on_held_out_texts(spark, held_out):
    docs = {r["doc_id"]: S.tokens_of(r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    one, two, heads, kinds = Counter(), Counter(), Counter(), Counter()
    for i, t in docs.items():
        if not held(i):
            one.update(t)
            for a, b in zip([S.END, *t], t, strict=False):
                kinds[a] += (a, b) not in two
                two[(a, b)] += 1
                heads[a] += 1
    n, v = sum(one.values()), len(one)
    bigram = 0.0
    for r in held_out[S.STEPS]:
        t = docs[r["doc_id"]]
        for a, b in zip([S.END, *t], t, strict=False):
            base = (one[b] + 0.5) / (n + 0.5 * (v + 1))
            bigram += math.log10((max(two[(a, b)] - 0.75, 0) + 0.75 * kinds[a] * base) / heads[a] if heads[a] else base)
    got = sum(r["score"] for r in held_out[S.STEPS])
    print("held-out log10 likelihood: model", got, "bigram", bigram, "base", sum(r["base_score"] for r in held_out[S.STEPS]))
    assert got > bigram


def test_the_stated_steps_fit_better_than_half_of_them(held_out):
    fit = {n: sum(r["score"] for r in rows) for n, rows in held_out.items()}
    assert S.STEPS >= 30 and fit[S.STEPS] > fit[S.STEPS // 2]


def test_lm_on_nothing(make_docs):
    assert S.lm_scores(make_docs((1, "a")).where("false")).count() == 0
    only_held = next(i for i in range(100) if held(i))
    r = S.lm_scores(make_docs((only_held, "a b"))).first()
    assert (r["n_known"], r["train_tokens"], r["n_tokens"]) == (0, 0, 3) and math.isfinite(r["score"])


def test_listed_words_of_tied_counts(spark):
    """Of words with one count a part is listed, not none."""
    counts = spark.createDataFrame([(b"w%d" % i, 3) for i in range(1000)] + [(b"often", 9)], "word binary, c long")
    lex = S.lexicon(counts, 200)
    assert 100 < len(lex.rank) <= 210 and lex.rank[b"often"] == 0 and S.END in lex.rank


def test_columns_with_clashing_names(make_docs):
    df = make_docs((1, "a b a"), (2, "b a b"))
    clash = df.selectExpr("*", "1 as copies", "'x' as word", "2 as tf", "3 as c", "4 as score", "5 as slice")
    key = lambda r: r["doc_id"]
    assert sorted(S.lm_scores(clash).collect(), key=key) == sorted(S.lm_scores(df).collect(), key=key)


def test_words_of_many_texts_are_those_of_each(monkeypatch):
    """White space of all kinds and at edges, bytes that are none, and the codes of words."""
    rng = np.random.default_rng(4)
    kinds = ["a", "B", "Z", "é", "İ", "\0", *" \t\n\v\f\r", "\x1c", "\x1f", "\x85", "\xa0", "\u2003"]
    texts = [None, "", " ", "\n a", "a \t", *("".join(rng.choice(kinds, rng.integers(0, 30))) for _ in range(800))]
    monkeypatch.setattr(S, "PIECE_BYTES", 500)
    got = []
    for part, piece in S.pieces_of(pa.RecordBatch.from_arrays([pa.array(["left out", *texts])], names=["text"]).slice(1), 0):
        words, sizes = S.words_of(piece)
        assert part.num_rows == len(piece) == len(sizes) and len(words) == sizes.sum()
        got += [[w.as_py() for w in words[a : a + n]] + [S.END] for a, n in zip(np.cumsum(sizes) - sizes, sizes, strict=True)]
    assert got == [S.tokens_of(t) for t in texts]
    words = [b"", *(w for t in got for w in t)]
    assert M.codes_of(pa.array(words, pa.binary())[1:]).tolist() == [M.code_of(w) for w in words[1:]]


def test_texts_that_are_not_utf8(spark):
    rows = [r"(2, cast(unhex('61FF2042C3') as string))", "(3, 'a b')", "(4, cast(unhex('FF') as string))"]
    got = {r["doc_id"]: r["n_tokens"] for r in S.lm_scores(spark.sql(f"select * from values {', '.join(rows)} as t(doc_id, text)"), listed=10, steps=1, slices=1).collect()}
    assert got == {2: 3, 3: 3, 4: 2}


def test_places_take_less_than_a_word_at_a_time():
    rng = np.random.default_rng(5)
    known = [b"w%d" % i for i in range(20_000)]
    lex = S.Lexicon({w: i for i, w in enumerate([*known, S.END])}, np.ones(20_001), 1, 1)
    texts = pa.array([" ".join(f"W{i}" for i in rng.integers(0, 25_000, 400)) for _ in range(500)]).cast(pa.binary())

    def plain():
        return [lex.rank.get(w, len(lex.rank) + M.code_of(w) if w not in lex.rank else 0) for t in texts.to_pylist() for w in S.tokens_of(t.decode())]

    def seconds(f):
        start = time.process_time()
        f()
        return time.process_time() - start

    places, sizes, others = lex.encoded(texts)
    assert places.tolist() == plain() and sizes.tolist() == [401] * 500 and len(others) == (places >= len(lex.rank)).sum()
    assert min(seconds(lambda: lex.encoded(texts)) for _ in range(5)) < 0.7 * min(seconds(plain) for _ in range(3))


def test_rows_are_added_in_any_order():
    rng = np.random.default_rng(6)
    rows = rng.normal(size=(500, 7))
    for at in (rng.integers(3, 40, 500), np.sort(rng.integers(3, 40, 500)), np.full(500, 9), np.zeros(0, np.int64)):
        for total in (np.ones((50, 7)), np.ones((7, 50)).T):
            want = np.ones((50, 7))
            np.add.at(want, at, rows[: len(at)])
            M._add_rows(total, at, rows[: len(at)])
            assert total == pytest.approx(want)


def test_pairs_are_passed_on_as_a_row_a_bucket(monkeypatch):
    """Whatever their number, and counted the same when a task holds few at once."""
    rng = np.random.default_rng(7)
    held = [rng.zipf(1.3, 5000).clip(max=65_000) << 32 | rng.zipf(1.3, 5000).clip(max=65_000) for _ in range(40)]
    rows = [M._bucketed(held[a : a + 10]) for a in range(0, 40, 10)]
    assert all(r.num_rows <= M.PAIR_BUCKETS for r in rows)
    table = pa.Table.from_batches(rows).sort_by("bucket").combine_chunks()
    want = Counter(np.concatenate(held).tolist())
    for most in (M.PAIRS_HELD, 50):
        monkeypatch.setattr(M, "PAIRS_HELD", most)
        found = list(M._pair_counts(iter(table.to_batches(max_chunksize=300))))
        assert sum(len(k) for k, _ in found) == len(want)
        assert {int(a): int(b) for k, n in found for a, b in zip(k, n, strict=True)} == want
        assert len(found) == len(set(table.column("bucket").to_pylist())) and all((np.diff(k) > 0).all() for k, _ in found)
