"""Best-fit packing by patterns.

Lengths are at most ``seq_len``, so their histogram has at most ``seq_len`` cells however large the
corpus is. The plan is made on that histogram: patterns of a few documents are enumerated, a
non-negative least-squares fit gives their repeat counts, the counts are rounded down, and what
remains is packed best fit, again by patterns. The plan says, per length, which ranks take which slot
of which pattern; documents find their place by their rank within their length.
"""

from __future__ import annotations

import unicodedata
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from sparkloom.llm.caching import WordCache, kept_by_worker
from sparkloom.llm.common import col
from sparkloom.shipping import checkpoint

SEQ_LEN = 2048
RANK_ROWS = 1_000

PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ]
)


def _byte_letters() -> dict[int, str]:
    """The printable character by which byte-level vocabularies write each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordIds:
    """Token ids of whole texts, looked up by words that ASCII white space separates.

    The tokenizer's pieces never hold white space and its rules look at nothing beyond a piece, so the
    ids of a text are those of its words in order. Ids are kept as little-endian 32-bit bytes.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.letters = _byte_letters()
        self.known = WordCache()

    @staticmethod
    def words(text: str) -> list[bytes]:
        raw = text.encode("utf-8", "replace")
        # special tokens are matched before lower-casing, so texts that may hold one keep their case
        return (raw if b"<|" in raw else raw.lower()).split()

    def _word(self, word: bytes) -> bytes:
        """A word of letters is one piece, which the merges take as it is; others go the whole way."""
        text = word.decode()
        lower = text.lower()
        if lower.isalpha() and unicodedata.is_normalized("NFC", lower) and not (set(text) & {"\u0130", "\u03a3"}):
            return array("I", [x.id for x in self.merge(lower.encode().decode("latin-1").translate(self.letters))]).tobytes()
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def learn(self, word: bytes) -> bytes:
        # a word that ends in a letter and the punctuation after it are separate pieces
        stem = word.rstrip(b".,")
        if stem != word and stem[-1:].isalpha() and b"<|" not in word:
            return self.known.value(stem, self._word) + self.known.value(word[len(stem) :], self._word)
        return self._word(word)

    def ids(self, words: list[bytes]) -> bytes:
        return b"".join(self.known.values(words, self.learn))


def word_ids(path: str) -> WordIds:
    """One per worker process, so that tasks that follow find the words of those before."""
    return kept_by_worker(("word ids", path), lambda: WordIds(path))


def token_pieces(df: DataFrame, tokenizer_path: str, seq_len: int = SEQ_LEN, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32``.

    A document is the ids of its text (null counts as empty) and ``end_id``; only one that is longer
    than ``seq_len`` is cut. An empty text is a piece of one id. Null ids and repeated rows stay rows
    of their own. An empty table gives an empty result.
    """
    end = np.array([end_id], "<u4").tobytes()
    step = 4 * seq_len

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer_path)
        for batch in batches:
            for part in range(0, batch.num_rows, 1000):
                ids = batch.column(0).slice(part, 1000).to_pylist()
                texts = batch.column(1).slice(part, 1000).to_pylist()
                rows = [
                    (doc_id, k, k * seq_len, min(step, len(raw) - at) // 4, zlib.crc32(raw[at : at + step]))
                    for doc_id, text in zip(ids, texts, strict=True)
                    for raw in (words.ids(WordIds.words(text or "")) + end,)
                    for k, at in enumerate(range(0, len(raw), step))
                ]
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                        names=PIECES.names,
                    )

    return df.select(col(df, id_col).cast("long"), col(df, text_col).cast("string")).mapInArrow(pieces, PIECES)


def enumerate_patterns(lengths: list[int], seq_len: int, most: int = 40_000, fill: float = 0.98) -> list[tuple[int, ...]]:
    """Patterns of one to four documents, and repeats of one length, that fill at least ``fill`` of a sequence.

    Singles and pairs are complete up to the best partner; of triples and quadruples, ``most`` drawn
    choices each of the first lengths get the longest last document that still fits. What the
    patterns lack is left to the residuals.
    """
    have = np.array(sorted(lengths))
    longest = np.full(seq_len + 1, -1)  # the longest length that fits a room
    longest[have] = have
    longest = np.maximum.accumulate(longest)
    found: set[tuple[int, ...]] = set()

    def add(*p: int) -> None:
        if p[-1] > 0 and sum(p) >= fill * seq_len:
            found.add(tuple(sorted(p, reverse=True)))

    for a in map(int, have):
        add(a)
        if a < seq_len:
            add(a, int(longest[seq_len - a]))
        if (k := seq_len // a) <= 8:
            add(*[a] * k)
            if seq_len > k * a:
                add(*[a] * k, int(longest[seq_len - k * a]))
    rng = np.random.default_rng(7)
    for size in (3, 4):
        tries = rng.choice(have, size=(most, size - 1))
        room = seq_len - tries.sum(1)
        for p, r in zip(tries[room > 0].tolist(), room[room > 0].tolist(), strict=True):
            add(*p, int(longest[r]))
    return sorted(found, reverse=True)


def fit_counts(patterns: list[tuple[int, ...]], histogram: np.ndarray, sweeps: int = 40) -> np.ndarray:
    """Non-negative least squares: counts x >= 0 that minimise the distance of the lengths used to the
    histogram, by exact coordinate steps."""
    rest = histogram.astype(float).copy()
    x = np.zeros(len(patterns))
    columns = []
    for p in patterns:
        lengths, times = np.unique(p, return_counts=True)
        columns.append((lengths, times.astype(float), float(times @ times)))
    for _ in range(sweeps):
        moved = 0.0
        for j, (lengths, times, norm) in enumerate(columns):
            step = max(-x[j], float(times @ rest[lengths]) / norm)
            if step:
                x[j] += step
                rest[lengths] -= step * times
                moved = max(moved, abs(step))
        if moved < 0.25:
            break
    return x


def round_counts(patterns: list[tuple[int, ...]], fitted: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Whole counts near the fitted ones, which ``rest``, the documents left of each length, allows; it is
    lowered by them. Whole parts come first; then each pattern, the largest remainders first, once more
    while its documents last. So a fit that spreads over many patterns is not rounded away."""
    out = np.zeros(len(patterns), np.int64)
    columns = [np.unique(p, return_counts=True) for p in patterns]
    whole = np.floor(fitted + 1e-9).astype(np.int64)
    for j in np.argsort(-whole, kind="stable"):
        lengths, times = columns[j]
        out[j] = n = max(0, int(min(whole[j], (rest[lengths] // times).min())))
        rest[lengths] -= n * times
    for j in np.argsort(whole - fitted, kind="stable"):
        lengths, times = columns[j]
        if fitted[j] > whole[j] + 1e-9 and (rest[lengths] >= times).all():
            out[j] += 1
            rest[lengths] -= times
    return out


def best_fit_patterns(histogram: np.ndarray, seq_len: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit decreasing on a histogram: each sequence starts with the longest document left and takes
    the longest that fits; equal sequences are made at once. Each step uses up a length."""
    rest = histogram.copy()
    plan = []
    while (have := np.flatnonzero(rest)).size:
        pattern: dict[int, int] = {}
        room = seq_len
        while (k := int(np.searchsorted(have, room, side="right")) - 1) >= 0:
            length = int(have[k])
            free = int(rest[length]) - pattern.get(length, 0)
            if free <= 0:
                have = np.delete(have, k)
                continue
            n = min(free, room // length)
            pattern[length] = pattern.get(length, 0) + n
            room -= n * length
        times = min(int(rest[length]) // n for length, n in pattern.items())
        for length, n in pattern.items():
            rest[length] -= times * n
        plan.append((tuple(length for length, n in sorted(pattern.items(), reverse=True) for _ in range(n)), times))
    return plan


def plan_slots(histogram: dict[int, int], seq_len: int = SEQ_LEN) -> tuple[dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], int]:
    """Per length: first ranks, first sequence numbers and offsets of its slots; and the sequences used.

    Rank r of a length takes the last slot whose first rank is at most r, in sequence
    ``first_sequence + r - first_rank``.
    """
    h = np.zeros(seq_len + 1, dtype=np.int64)
    for length, n in histogram.items():
        h[length] = n
    rest = h.copy()
    plan: list[tuple[tuple[int, ...], int]] = []
    patterns = enumerate_patterns([int(x) for x in np.flatnonzero(h)], seq_len) if h.any() else []
    rounded = round_counts(patterns, fit_counts(patterns, h), rest)
    plan += [(patterns[j], int(rounded[j])) for j in np.argsort(-rounded, kind="stable") if rounded[j]]
    plan += best_fit_patterns(rest, seq_len)
    slots: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    first = 0
    for pattern, n in plan:
        offset = 0
        for length in pattern:
            slots.setdefault(length, []).append((used.get(length, 0), first, offset))
            used[length] = used.get(length, 0) + n
            offset += length
        first += n
    return {length: tuple(np.array(c, dtype=np.int64) for c in zip(*s, strict=True)) for length, s in slots.items()}, first


def pack(pieces: DataFrame, seq_len: int = SEQ_LEN) -> DataFrame:
    """``pieces`` (checkpointed rows of :func:`token_pieces`) with ``sequence_id`` and ``offset``.

    Only the histogram of lengths reaches the driver, ``seq_len`` cells at most. Ranks within a length
    are counted over hashed buckets of about RANK_ROWS rows, so that a length that many documents share
    is dealt over many tasks; only that many rows less of bucket counts are summed per length.
    """
    histogram = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots, _ = plan_slots(histogram, seq_len)
    per_length = pieces.sparkSession.createDataFrame([(x, -(-n // RANK_ROWS)) for x, n in histogram.items()], "length long, buckets long")
    keyed = pieces.join(F.broadcast(per_length), "length").select(*PIECES.names, F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("buckets")).alias("bucket"))
    before = W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = keyed.groupBy("length", "bucket").agg(F.count("*").alias("n")).select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = keyed.withColumn("rank", F.row_number().over(W.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32"))).join(starts, ["length", "bucket"])
    rows = ranked.select(*PIECES.names, (F.col("first") + F.col("rank") - 1).cast("long").alias("rank"))
    return rows.mapInArrow(_placer(slots), T.StructType([*PIECES.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))


def _placer(slots: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(3).to_numpy()
            rank = batch.column(5).to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length):
                at = length == x
                first_rank, first_sequence, offsets = slots[int(x)]
                k = np.searchsorted(first_rank, rank[at], side="right") - 1
                sequence[at] = first_sequence[k] + rank[at] - first_rank[k]
                offset[at] = offsets[k]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*PIECES.names, "sequence_id", "offset"])

    return place


def pack_documents(df: DataFrame, tokenizer_path: str, seq_len: int = SEQ_LEN, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenize, cut and pack: columns of :func:`token_pieces` with ``sequence_id`` and ``offset``.

    The pieces (a few numbers each) are checkpointed, as their histogram must be known before they can
    be placed. Repeated rows are packed each; ties in rank are between equal rows.
    """
    return pack(checkpoint(token_pieces(df, tokenizer_path, seq_len, end_id, id_col, text_col)), seq_len)
