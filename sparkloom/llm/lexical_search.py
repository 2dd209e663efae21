"""Ranked lexical search by NRA: no random access, intervals of scores from sorted reads.

Documents are scanned once for the terms of the items. Each task then indexes segments of its documents: a
list a term, sorted by impact. For an item the lists are read side by side from their largest impacts on. A
document's score lies between what was read of it and that plus the next impacts of the lists in which it was
not met; one whose interval ends below the k-th lower end is dropped. Reading goes on until no document that
was not met can enter and every interval left is a point, so that members, ties and scores are exact. The
best of earlier segments bound those of later ones, and a window merges the best k of all tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.llm.common import col
from sparkloom.shipping import checkpoint

#: Items of one pass, which are broadcast with their terms; more take more passes.
ITEM_BLOCK = 4096
#: A segment ends with the document that reaches one of these.
SEGMENT_DOCS, SEGMENT_POSTINGS = 16_384, 2_000_000
#: Entries of each list that the first round reads; each further round reads twice as many.
FIRST_READ = 128

_IS_TERM = [0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80 for b in range(256)]
#: Bytes of UTF-8: A-Z lower-cased, bytes outside terms become spaces.
_FOLD = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if _IS_TERM[b] else 32 for b in range(256))


def terms(raw: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8: maximal runs of ASCII letters and digits and of all other characters
    beyond ASCII; only A-Z are lower-cased."""
    return (raw or b"").translate(_FOLD).split()


class _Numbers(dict):
    def __missing__(self, _: bytes) -> int:
        return -1


def _count_terms(shared) -> callable:
    """(doc_id, raw) to (doc_id, n, terms, tfs): the number of terms, and the numbered ones with their counts; a
    text without terms gives no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = _Numbers((t, i) for i, t in enumerate(shared.value))
        size = max(1, len(number))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [terms(raw) for raw in part.column(1).to_pylist()]
                n = np.array([len(t) for t in found], np.int64)
                ids = np.fromiter((number[t] for ts in found for t in ts), np.int64, int(n.sum()))
                owner = np.repeat(np.arange(len(n)), n)[ids >= 0]
                key, tf = np.unique(owner * size + ids[ids >= 0], return_counts=True)
                ends = np.searchsorted(key, np.arange(len(n) + 1) * size).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (key % size, tf)]
                some = pa.array(n > 0)
                yield pa.RecordBatch.from_arrays([c.filter(some) for c in (part.column(0), pa.array(n), *lists)], names=["doc_id", "n", "terms", "tfs"])

    return run


class Segment:
    """Impact-sorted lists of some documents: ``n`` terms each, and flat rows (owner, term, tf)."""

    def __init__(self, n: np.ndarray, owner: np.ndarray, term: np.ndarray, tf: np.ndarray, n_docs: int, n_terms: int, size: int) -> None:
        m = 100 - 25 + (25 * n.astype(np.int64) * n_docs) // max(1, n_terms)
        tf = tf.astype(np.int64)
        impact = (1_000_000_000 * tf) // (1000 * tf + 12 * m[owner])
        order = np.lexsort((owner, -impact, term))
        self.size, self.owner, self.impact = len(n), owner[order], impact[order]
        self.ends = np.searchsorted(term[order], np.arange(size + 1))

    def best(self, query: list[tuple[int, int]], k: int, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) that may be among the k best of scores of at least ``least`` for ``query``, rows of
        (term, weight times its occurrences); all that reach the k-th best score, so ties are among them."""
        lists = [(self.owner[a:b], w * self.impact[a:b]) for t, w in query if w > 0 and (a := self.ends[t]) < (b := self.ends[t + 1])]
        lower = np.zeros(self.size, np.int64)
        met = np.zeros((len(lists), self.size), bool)
        alive = np.ones(self.size, bool)
        read, step, left = 0, FIRST_READ, np.array([s[0] for _, s in lists], np.int64)
        live = np.empty(0, np.int64)
        while True:
            for i, (docs, score) in enumerate(lists):
                if read < len(docs):
                    d, s = docs[read : read + step], score[read : read + step]
                    keep = alive[d]
                    d = d[keep]
                    lower[d] += s[keep]
                    met[i, d] = True
                    left[i] = score[read + step] if read + step < len(docs) else 0
            read, step = read + step, 2 * step
            unmet = int(left.sum())
            live = np.flatnonzero(alive & (lower > 0))
            low = lower[live]
            bar = max(least, int(np.partition(low, -k)[-k])) if len(low) >= k else least
            upper = low + unmet - left @ met[:, live]
            out = upper < bar
            alive[live[out]] = False
            live, low, upper = live[~out], low[~out], upper[~out]
            if unmet < bar:  # no document that was not met can enter any more
                mask = np.zeros(self.size, bool)
                mask[live] = True
                alive &= mask
                if (low == upper).all():
                    return live, low


def _answer(shared, k: int) -> callable:
    """(doc_id, n, terms, tfs) to (item, item_id, doc_id, score): each item's best k of the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, size, n_docs, n_terms = shared.value
        best: list[list[tuple[int, bool, int]]] = [[] for _ in items]

        def segment(part: pa.Table) -> None:
            part = part.combine_chunks()
            term, tf = (part.column(c).chunk(0) if part.num_rows else pa.array([], pa.list_(pa.int32())) for c in ("terms", "tfs"))
            sizes = np.diff(term.offsets.to_numpy())
            made = Segment(part.column("n").to_numpy(), np.repeat(np.arange(part.num_rows), sizes), term.flatten().to_numpy(), tf.flatten().to_numpy(), n_docs, n_terms, size)
            ids = part.column("doc_id").to_pylist()
            for i, (_, query) in enumerate(items):
                known = best[i]
                docs, scores = made.best(query, k, -known[-1][0] if len(known) == k else 1)
                if len(docs):
                    best[i] = sorted(known + [(-s, ids[d] is None, ids[d] or 0) for d, s in zip(docs.tolist(), scores.tolist(), strict=True)])[:k]

        held, rows, postings = [], 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                held.append(part)
                rows, postings = rows + part.num_rows, postings + len(part.column(2).flatten())
                if rows >= SEGMENT_DOCS or postings >= SEGMENT_POSTINGS:
                    segment(pa.Table.from_batches(held))
                    held, rows, postings = [], 0, 0
        if held:
            segment(pa.Table.from_batches(held))
        out = [(i, items[i][0], None if none else d, -s) for i in range(len(items)) for s, none, d in best[i]]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["item", "item_id", "doc_id", "score"])

    return run


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's ``k`` documents of the highest scores above 0, ties by
    ascending id (null ids last).

    A term weighs floor(1000 ln((2 N + 2) / (2 df + 1))); a document scores the sum over the item's terms, with
    repeats, of weight * (10^9 tf div (1000 tf + 12 m)), m = 75 + 25 n N div L. Null and empty texts have no terms
    and are not counted in N; they are never found, and such items give no rows. Rows that repeat an id are documents
    of their own, rows that repeat an item id are items of their own. Empty tables give no rows.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    texts = docs.select(col(docs, id_col).cast("long").alias("doc_id"), col(docs, text_col).cast("string").cast("binary").alias("raw")).where("raw is not null")
    asked = items.select(col(items, item_col).cast("long").alias("item_id"), col(items, item_text_col).cast("string").cast("binary").alias("raw")).where("raw is not null")
    passes = max(1, -(-asked.count() // ITEM_BLOCK))
    out = None
    for p in range(passes):
        part = asked if passes == 1 else asked.where(F.pmod(F.xxhash64("item_id", "raw"), F.lit(passes)) == p)
        found = _pass(texts, part.toArrow(), k).withColumn("item", F.col("item") * passes + p)
        if passes > 1:
            found = checkpoint(found)
        out = found if out is None else out.unionByName(found)
    w = W.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def _pass(texts: DataFrame, block: pa.Table, k: int) -> DataFrame:
    sc = texts.sparkSession.sparkContext
    asked = [(i, terms(raw)) for i, raw in zip(block.column("item_id").to_pylist(), block.column("raw").to_pylist(), strict=True)]
    vocabulary = sorted({t for _, ts in asked for t in ts})
    counted = checkpoint(texts.mapInArrow(_count_terms(sc.broadcast(vocabulary)), "doc_id long, n long, terms array<int>, tfs array<int>"))
    total = counted.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    df = {r["t"]: r["n"] for r in counted.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n")).toLocalIterator()}  # at most the items' terms
    number = {t: i for i, t in enumerate(vocabulary)}
    items = []
    for item_id, ts in asked:
        repeats: dict[int, int] = {}
        for t in ts:
            repeats[number[t]] = repeats.get(number[t], 0) + 1
        items.append((item_id, [(t, q * math.floor(1000 * math.log((2 * total["docs"] + 2) / (2 * df[t] + 1)))) for t, q in repeats.items() if t in df]))
    shared = sc.broadcast((items, len(vocabulary), int(total["docs"]), int(total["terms"])))
    return counted.mapInArrow(_answer(shared, k), "item long, item_id long, doc_id long, score long")
