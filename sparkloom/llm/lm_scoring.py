"""LM scoring: a hashed maximum-entropy model with a class-factored softmax.

The model itself is described in :mod:`maxent`. Everything is gathered from all training texts: counts of all words, and
those of features and pairs of words. The LISTED_WORDS most frequent words and the end of a text are words of the model;
all others fall into classes by their first and last letters, and within one of these a word follows
its smoothed relative frequency. So the probability of a text is normalised over all words, with one
unknown word in each of those classes.

Texts are encoded once, as places in the list, and written to the shared folder in slices; each training
step is a distributed pass over a slice that sums gradients. Texts are scored in numpy batches; counts of
words beyond the broadcast list come from a join.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm import maxent
from sparkloom.llm.common import col, id_fold
from sparkloom.shipping import checkpoint, shared_folder

#: The end of a text; words hold no white space, so none equals it.
END = b"\n"
LISTED_WORDS = 65_536
STEPS = 32
SLICES = 32
FLUSH_TOKENS = 1_000_000
#: Tokens of a written row.
ROW_TOKENS = 200_000
#: Bytes of texts whose words are looked up at once.
PIECE_BYTES = 1 << 21


def tokens_of(text: str | None) -> list[bytes]:
    """A-Z in lower case, words by the six white-space characters, then the end."""
    out = (text or "").encode("utf-8", "replace").lower().split()
    out.append(END)
    return out


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of ``texts`` (binary), one after the other, and how many each text has: :func:`tokens_of` without ends."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pa.concat_arrays([texts]).view(pa.string())))
    words, sizes = lists.flatten().view(pa.binary()), pc.list_value_length(lists).to_numpy().astype(np.int64)
    # white space at an edge of a text leaves an empty word, and so does an empty text
    empty = np.flatnonzero(pc.binary_length(words).to_numpy() == 0)
    if len(empty):
        owner = np.repeat(np.arange(len(sizes)), sizes)
        sizes -= np.bincount(owner[empty], minlength=len(sizes))
        words = words.filter(pc.not_equal(pc.binary_length(words), 0))
    return words, sizes


def pieces_of(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Runs of rows of about PIECE_BYTES, a longer text being one of its own, with their texts as bytes; null is empty."""
    texts = pc.fill_null(batch.column(column).cast(pa.binary()), b"")
    upto = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64)
    start = 0
    while start < len(texts):
        most = PIECE_BYTES + (upto[start - 1] if start else 0)
        end = max(start + 1, int(np.searchsorted(upto, most, "right")))
        yield batch.slice(start, end - start), texts.slice(start, end - start)
        start = end


# --- counts -----------------------------------------------------------------------------------------


def word_counts(texts: DataFrame) -> DataFrame:
    """(word binary, c) over all tokens of ``texts`` (one column). Tasks add up their own words first and
    pass on what they have when it exceeds FLUSH_TOKENS words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, ends = [], 0, 0

        def added() -> pa.Table:
            return pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns({"n_sum": "n"}).select(["word", "n"])

        for batch in batches:
            for _, piece in pieces_of(batch, 0):
                found = words_of(piece)[0].value_counts()
                held.append(pa.table([found.field(0), found.field(1)], names=["word", "n"]))
                rows, ends = rows + len(found), ends + len(piece)
                if rows > 2 * FLUSH_TOKENS:
                    held = [added()]
                    rows = held[0].num_rows
                    if rows > FLUSH_TOKENS:
                        yield from held[0].to_batches()
                        held, rows = [], 0
        if ends:
            held.append(pa.table([pa.array([END], pa.binary()), pa.array([ends], pa.int64())], names=["word", "n"]))
            yield from added().to_batches()

    return texts.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


@dataclass
class Lexicon:
    """Listed words, most frequent first, with their counts; END is always one. ``tokens`` and ``distinct``
    are those of all training texts."""

    rank: dict[bytes, int]
    counts: np.ndarray
    tokens: int
    distinct: int
    _listed: pa.Array | None = None

    @property
    def end(self) -> int:
        return self.rank[END]

    def places(self, words: pa.Array) -> np.ndarray:
        """Ranks of ``words`` (binary, no nulls), and codes of those that have none."""
        if self._listed is None:
            self._listed = pa.array(list(self.rank), pa.binary())
        out = pc.fill_null(pc.index_in(words, value_set=self._listed), -1).to_numpy().copy()
        other = np.flatnonzero(out < 0)
        out[other] = len(self.rank) + maxent.codes_of(words.take(pa.array(other)))
        return out

    def encoded(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Places of all tokens of ``texts``, how many each text has, and the words that are not listed."""
        words, sizes = words_of(texts)
        places = self.places(words)
        out = np.full(len(words) + len(sizes), self.end, np.int32)
        out[np.arange(len(words)) + np.repeat(np.arange(len(sizes)), sizes)] = places
        return out, sizes + 1, words.take(pa.array(np.flatnonzero(places >= len(self.rank))))


def lexicon(counts: DataFrame, listed: int = LISTED_WORDS) -> Lexicon:
    """At most about ``listed`` words reach the driver: those above the smallest count that keeps to the
    number, and of those that share the next count a part by their hash.

    The limit comes from a histogram of counts, a cell each up to 1024 and 64 an octave above.
    """
    tokens, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    cell = F.when(F.col("c") <= 1024, F.col("c")).otherwise(1024 + F.floor((F.log2("c") - 10) * 64)).cast("int")
    cells = counts.groupBy(cell.alias("cell")).agg(F.count("*").alias("n")).orderBy(F.desc("cell")).collect()
    least, part, room = 1 << 30, 0, listed
    for r in cells:
        if r["n"] > room:
            part = int((1 << 20) * 0.98 * room / r["n"])
            break
        least, room = r["cell"], room - r["n"]
    tied = F.lit(False) if not part else (cell == r["cell"]) & (F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < part)
    found = counts.where((cell >= least) | tied | (F.col("word") == F.lit(END))).toArrow()
    top = sorted(zip(found.column("word").to_pylist(), found.column("c").to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))
    if all(w != END for w, _ in top):
        top.append((END, 0))
    return Lexicon({w: i for i, (w, _) in enumerate(top)}, np.array([c for _, c in top], np.float64), int(tokens), int(distinct))


def write_encoded(texts: DataFrame, shared, slices: int) -> str:
    """Places of all tokens of ``texts`` (one column), a text after the other, in a folder of ``slices`` parts
    in the shared folder. A text's part follows from its hash."""
    folder = f"{shared_folder(texts.sparkSession)}/lm-{uuid.uuid4().hex}"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shared.value
        held: list[list[np.ndarray]] = [[] for _ in range(slices)]
        sizes = [0] * slices

        def out(k: int) -> pa.RecordBatch:
            data = np.concatenate(held[k]).tobytes()
            held[k], sizes[k] = [], 0
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary()), pa.array([k], pa.int32())], names=["places", "slice"])

        for batch in batches:
            for _, piece in pieces_of(batch, 0):
                places, lengths, _ = lex.encoded(piece)
                for text, data in zip(piece.to_pylist(), np.split(places, np.cumsum(lengths)[:-1]), strict=True):
                    k = xxhash.xxh32_intdigest(text) % slices
                    held[k].append(data.copy())
                    sizes[k] += len(data)
                    if sizes[k] > ROW_TOKENS:
                        yield out(k)
        for k in range(slices):
            if held[k]:
                yield out(k)

    texts.mapInArrow(encode, "places binary, slice int").write.partitionBy("slice").option("compression", "zstd").parquet(folder)
    return folder


def train(texts: DataFrame, lex: Lexicon, shared, steps: int = STEPS, slices: int = SLICES) -> tuple[maxent.Model, list[float]]:
    """The model of the words of ``texts`` (one column), and each step's mean log likelihood of classes."""
    spark = texts.sparkSession
    folder = write_encoded(texts, shared, slices)
    encoded = spark.read.schema("places binary, slice int").parquet(folder)
    # a sum of the model's size comes from each task of a pass, so there are no more than Spark runs at once
    at_once = spark.sparkContext.defaultParallelism

    def part(k: int) -> DataFrame:
        return encoded.where(F.col("slice") == k % slices).select("places").coalesce(at_once)

    whole, n = encoded.select("places").coalesce(at_once), len(lex.rank)
    own = maxent.cluster_words(maxent.neighbour_counts(whole, n, lex.end))
    classes = maxent.make_classes(list(lex.rank), lex.counts, lex.end, own)
    tables = maxent.word_tables(whole, classes)
    pairs = maxent.word_pairs(encoded.select("places"), classes, tables)
    counts = maxent.class_counts(whole, classes, maxent.ClassModel(classes))
    model, fits = maxent.train_classes(part, steps, 1 / slices, classes, counts)
    return maxent.Model(classes, model.weights, tables, pairs), fits


# --- scoring ----------------------------------------------------------------------------------------

_ROW = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text_hash", T.LongType()),
        T.StructField("word", T.BinaryType()),
        T.StructField("tf", T.LongType()),
        T.StructField("tokens", T.LongType()),
        T.StructField("known", T.LongType()),
        T.StructField("logs", T.DoubleType()),
        T.StructField("model", T.DoubleType()),
    ]
)


def rare_norms(counts: DataFrame, shared) -> np.ndarray:
    """log10 of what the smoothed counts of each class of unlisted words add up to, an unknown word's included."""

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, model = shared.value
        c = model.classes
        tokens, distinct = np.zeros(c.count - c.rare), np.zeros(c.count - c.rare)
        for batch in batches:
            place = lex.places(batch.column(0))
            some = place >= c.n
            of = c.of[place[some]] - c.rare
            tokens += np.bincount(of, batch.column(1).to_numpy()[some], len(tokens))
            distinct += np.bincount(of, minlength=len(tokens))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(tokens), dtype=np.int32)), pa.array(tokens), pa.array(distinct)], names=["k", "tokens", "distinct"])

    sums = counts.select("word", "c").mapInArrow(classify, "k int, tokens double, distinct double").groupBy("k").agg(F.sum("tokens").alias("tokens"), F.sum("distinct").alias("distinct"))
    c = shared.value[1].classes
    out = np.full(c.count - c.rare, np.log10(0.5))
    for r in sums.collect():
        out[r["k"]] = np.log10(r["tokens"] + 0.5 * (r["distinct"] + 1))
    return out


def score_texts(docs: DataFrame, counts: DataFrame, lex: Lexicon, shared, norms: np.ndarray) -> DataFrame:
    """(doc_id, text) to (doc_id, n_tokens, n_known, base_score, score).

    A text yields one row with what the listed words give, and one row for each other word.
    Those rows join the counts by word, words that are not frequent by construction, and are summed
    by document. Rows that repeat id and text are summed together and parted again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, model = shared.value
        logs, c, end = np.log10(lex.counts + 0.5), model.classes, lex.end
        seen = lex.counts > 0
        for batch in batches:
            for part, piece in pieces_of(batch, 1):
                places, sizes, others = lex.encoded(piece)
                listed = places < c.n
                n = len(piece)
                owner = np.repeat(np.arange(n), sizes)
                scores = model.scores(places, maxent.histories(places, end))
                scores[~listed] -= norms[c.of[places[~listed]] - c.rare]
                base = np.bincount(owner[listed], logs[places[listed]], n)
                known = np.bincount(owner[listed], seen[places[listed]], n).astype(int)
                score = np.bincount(owner, scores, n)
                ids = part.column(0).to_pylist()
                hashes = [xxhash.xxh64_intdigest(t) >> 1 for t in piece.to_pylist()]
                # a key of its own, which no word equals, keeps these rows from meeting in one task
                own = [b"\n%d %d" % (h, i or 0) for h, i in zip(hashes, ids, strict=True)]
                yield _rows(part.column(0), hashes, pa.array(own, pa.binary()), np.zeros(n, np.int64), pa.array(sizes), pa.array(known), pa.array(base), pa.array(score))
                if len(others):
                    who = owner[~listed]
                    none = [pa.nulls(len(who), pa.int64())] * 2 + [pa.nulls(len(who), pa.float64())] * 2
                    yield _rows(part.column(0).take(pa.array(who)), np.array(hashes, np.int64)[who], others, np.ones(len(who), np.int64), *none)

    rows = docs.mapInArrow(run, _ROW)
    joined = rows.join(counts.where(F.col("c") > 0).select("word", "c"), "word", "left")
    c = F.coalesce("c", F.lit(0))
    contribution = F.when(F.col("tf") > 0, F.col("tf") * F.log10(c + 0.5))
    found = F.when(F.col("c").isNotNull(), F.col("tf"))
    n = F.sum("n_rows_")
    summed = (
        joined.select("doc_id", "text_hash", contribution.alias("rare"), found.alias("found"), *_ROW.names[4:], F.when(F.col("tf") == 0, 1).otherwise(0).alias("n_rows_"))
        .groupBy("doc_id", "text_hash")
        .agg(
            n.alias("copies"),
            F.max("tokens").alias("tokens"),
            F.max("known").alias("known"),
            F.max("logs").alias("logs"),
            F.max("model").alias("model"),
            (F.coalesce(F.sum("rare"), F.lit(0.0)) / n).alias("rare"),
            (F.coalesce(F.sum("found"), F.lit(0)) / n).cast("long").alias("found"),
        )
    )
    norm = float(np.log10(lex.tokens + 0.5 * (lex.distinct + 1)))
    return summed.select(
        "doc_id",
        F.col("tokens").alias("n_tokens"),
        (F.col("known") + F.col("found")).alias("n_known"),
        (F.col("logs") + F.col("rare") - F.col("tokens") * norm).alias("base_score"),
        (F.col("model") + F.col("rare")).alias("score"),
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
    ).drop("copy")


def _rows(ids: pa.Array, hashes: list[int] | np.ndarray, words: pa.Array, tf: np.ndarray, *more: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids, pa.array(hashes, pa.int64()), words, pa.array(tf), *more], names=_ROW.names)


def lm_scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held_fold: int = 1, listed: int = LISTED_WORDS, steps: int = STEPS, slices: int = SLICES) -> DataFrame:
    """One row per row of ``df``: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    The model and all counts come from the rows outside the held-out fold of the id. A null text
    counts as empty: its only token is the end. A null id is in no held-out fold. Repeated rows are
    scored each, and train each. Without training rows all words are unknown and their classes are equally likely. A table without rows gives none. Other columns
    are not read.
    """
    spark = df.sparkSession
    docs = df.select(col(df, id_col).cast("long").alias("doc_id"), col(df, text_col).cast("string").alias("text"))
    texts = docs.where(id_fold(F.col("doc_id"), folds) != held_fold).select("text")
    counts = checkpoint(word_counts(texts))
    lex = lexicon(counts, listed)
    words = spark.sparkContext.broadcast(lex)
    model, _ = train(texts, lex, words, steps, slices)
    words.destroy()
    shared = spark.sparkContext.broadcast((lex, model))
    scored = score_texts(docs, counts, lex, shared, rare_norms(counts, shared))
    return scored.select(
        "doc_id", (id_fold(F.col("doc_id"), folds) == held_fold).alias("held_out"), "n_tokens", "n_known", F.lit(lex.tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )
