import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sparkloom.llm import packing
from sparkloom.llm.queries import word_vocabulary

ODD = [
    "Ab'S x. don't, ", "<|endoftext|> x<|EndOfText|>", "İI Σας ΑΣ", "á ́b", "x y 　 \x1cz q", "日本語 テスト。、", "'s 'T e.g.,!!", "a..,b ...", "naïve.,", "1234 12.5,", "É. Ünd, ß.", "ŉ ǰ K ﬁ Å", "", " ", "\t\r\n",
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(word_vocabulary())


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_words_give_the_ids_of_whole_texts(tokenizer, documents):
    words = packing.WordIds(word_vocabulary())
    for text in ODD + [r["text"] for r in documents.limit(60).collect()]:
        assert np.frombuffer(words.ids(packing.WordIds.words(text)), "<u4").tolist() == ids_of(tokenizer, text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("aBé'.,!<|>s \t Σİ́end oftx1中"), max_size=40))
def test_any_text(text):
    words = packing.word_ids(word_vocabulary())
    assert np.frombuffer(words.ids(packing.WordIds.words(text)), "<u4").tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids


def check(rows, docs, tokenizer, seq_len):
    """Pieces are those of each document; sequences are gapless and within their length."""
    want = []
    for doc_id, text in docs:
        ids = [*ids_of(tokenizer, text), 0]
        for k, at in enumerate(range(0, len(ids), seq_len)):
            part = np.array(ids[at : at + seq_len], "<u4")
            want.append((doc_id, k, at, len(part), zlib.crc32(part.tobytes())))
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=key) == sorted(want, key=key)
    places = defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= seq_len
    return len(places), [w[3] for w in want]


@pytest.mark.parametrize("rank_rows", [3, 1000])
def test_pieces_and_places(spark, make_docs, documents, tokenizer, monkeypatch, rank_rows):
    monkeypatch.setattr(packing, "RANK_ROWS", rank_rows)
    docs = [(r["doc_id"], r["text"]) for r in documents.collect()] + [(None, None), (7000, ""), (7000, ""), (7001, "word " * 5000)]
    rows = packing.pack_documents(make_docs(*docs), word_vocabulary(), 256).collect()
    n, lengths = check(rows, docs, tokenizer, 256)
    assert n <= best_fit(lengths, 256)


def test_empty_table(make_docs):
    assert packing.pack_documents(make_docs((1, "a")).where("false"), word_vocabulary()).count() == 0


def best_fit(lengths, seq_len):
    rooms: list[int] = []
    for x in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= x]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= x
        else:
            rooms.append(seq_len - x)
    return len(rooms)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=300))
def test_plan_uses_every_document_once_and_few_sequences(lengths):
    histogram = {x: lengths.count(x) for x in set(lengths)}
    slots, used = packing.plan_slots(histogram, 64)
    for x, n in histogram.items():
        first, _, _ = slots[x]
        assert first[0] == 0 and (np.diff(first) > 0).all() and first[-1] < n
    assert -(-sum(lengths) // 64) <= used <= best_fit(lengths, 64) + 1


def test_least_squares_recovers_repeat_counts():
    patterns = [(60, 4), (40, 24), (30, 30, 4), (32, 32)]
    h = np.zeros(65)
    for p, n in zip(patterns, (5, 8, 3, 6), strict=True):
        for x in p:
            h[x] += n
    assert np.allclose(packing.fit_counts(patterns, h, sweeps=500), (5, 8, 3, 6), atol=0.3)


def test_the_fit_places_most_pieces():
    """Of a histogram with many lengths the rounded patterns take most documents, and no more than there are."""
    rng = np.random.default_rng(6)
    lengths = np.minimum(2047, rng.lognormal(5.5, 1.0, 8000).astype(int) + 2)
    h = np.bincount(lengths, minlength=2049)
    patterns = packing.enumerate_patterns([int(x) for x in np.flatnonzero(h)], 2048)
    rest = h.copy()
    counts = packing.round_counts(patterns, packing.fit_counts(patterns, h), rest)
    used = np.zeros_like(h)
    for j in np.flatnonzero(counts):
        np.add.at(used, list(patterns[j]), counts[j])
    assert (used + rest == h).all() and (rest >= 0).all()
    assert used.sum() > 0.6 * h.sum()
    assert packing.plan_slots({int(x): int(n) for x, n in enumerate(h) if n})[1] <= -(-int((h * np.arange(2049)).sum()) // 2048) + 1
