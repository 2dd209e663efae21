"""The maximum-entropy model of :mod:`lm_scoring`: classes, features, training.

P(word | history) = P(class | history) * P(word | class, word before). Both factors are log-linear:

* A class is scored by rows of weights, one a feature of the history and a weight a class in each: the word
  before (hashed), the pair of the two words before (hashed), the pair of their classes, each of these
  classes alone, and as skips the word before the last (hashed) and the class of the one before that. Weights start at damped log ratios of counts and are trained by gradients that Spark sums, a
  slice of the texts a step.
* A word within its class is scored by a bias and a weight for each cluster of the word before. Classes
  share none of these weights, so each is trained in a task of its own, on its counts.
* A pair of words that says clearly more than that has a weight of its own. Pairs that begin alike and end in one class
  share a normaliser and nothing else, so their weights have a closed form: each pair's share is met.

Words are places: 0 up to n for listed ones, most frequent first, then a code of the first and last three
bytes for all others. So all that a task needs to know of a place is a lookup in an array.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.shipping import checkpoint

CODE_BITS = 10
CODES = 1 << 2 * CODE_BITS
CLUSTERS = 16
CLASSES = 24
DIMS = 64
WORD_ROWS = 4096
SKIP_ROWS = 1024
PAIR_ROWS = 4096
PAIRS = 1 << 19
#: How far a step moves all weights, as a share of a step that were exact if features did not overlap.
RATE = 0.2
LEAST_GAIN = 2.0
DISCOUNT = 0.75
CHUNK = 1 << 14
#: Tokens whose classes are scored at once, so that their rows stay in a core's cache.
SCORED = 1 << 12
ROWS_A_BLOCK = 256
#: Pairs are counted in so many buckets of words before. Of 65,536 listed words a bucket has about 4.2 million pairs at most.
PAIR_BUCKETS = 1024
#: Pairs that a task holds before it passes on their counts.
PAIRS_HELD = 1 << 21


def code_of(word: bytes) -> int:
    """Of the first and the last three bytes."""
    mask = (1 << CODE_BITS) - 1
    return (zlib.crc32(word[:3]) & mask) << CODE_BITS | zlib.crc32(word[-3:]) & mask


#: What a byte does to a CRC-32.
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, _CRC >> 1 ^ np.uint32(0xEDB88320), _CRC >> 1)


def codes_of(words: pa.Array) -> np.ndarray:
    """:func:`code_of` of every word (binary, no nulls)."""
    if not len(words):
        return np.zeros(0, np.int64)
    words = pa.concat_arrays([words])
    at = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    size = np.minimum(np.diff(at), 3)

    def crc(first: np.ndarray) -> np.ndarray:
        out = np.full(len(first), 0xFFFFFFFF, np.uint32)
        for k in range(3):
            on = np.flatnonzero(size > k)
            out[on] = _CRC[(out[on] ^ data[first[on] + k]) & np.uint32(0xFF)] ^ out[on] >> np.uint32(8)
        return (~out & np.uint32((1 << CODE_BITS) - 1)).astype(np.int64)

    return crc(at[:-1]) << CODE_BITS | crc(at[1:] - size)


# --- sums of blocks -----------------------------------------------------------------------------------


def sum_blocks(blocks: DataFrame, kind: str) -> DataFrame:
    """(block, data) with the sums of the numpy arrays ``data`` (binary, of dtype ``kind``) of each block.

    ``blocks`` has (block int, part int, data binary); arrays are added in the order of ``part``, so reruns
    agree. A task adds as it reads and holds one sum a block.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = np.frombuffer(data.as_buffer(), kind).astype(np.float64)
                if block == at:
                    total += x
                    continue
                if at is not None:
                    yield _block(at, total)
                at, total = block, x
        if at is not None:
            yield _block(at, total)

    return blocks.repartition("block").sortWithinPartitions("block", "part").select("block", "data").mapInArrow(add, "block int, data binary")


def _block(block: int, data: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([data.tobytes()], pa.binary())], names=["block", "data"])


def _parts(blocks: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Rows of :func:`sum_blocks` for a task's blocks; those that are all 0 are left out."""
    part = TaskContext.get().partitionId()
    for k, data in enumerate(blocks):
        if data.any():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part], pa.int32()), pa.array([data.tobytes()], pa.binary())], names=["block", "part", "data"])


_PART = "block int, part int, data binary"


def _gather(sums: DataFrame, sizes: list[int]) -> np.ndarray:
    """The blocks one after the other on the driver; missing ones are 0. The size is that of the model."""
    out = [np.zeros(n) for n in sizes]
    for block, data in zip(*(c.to_pylist() for c in sums.toArrow().columns), strict=True):
        out[block] = np.frombuffer(data, np.float64)
    return np.concatenate(out) if out else np.zeros(0)


def chunks_of(batches: Iterator[pa.RecordBatch], end: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(words, word before, second and third before) of encoded texts (one binary column), in chunks."""
    for batch in batches:
        for data in batch.column(0):
            places = np.frombuffer(data.as_buffer(), np.int32)
            before = histories(places, end)
            for at in range(0, len(places), CHUNK):
                yield tuple(x[at : at + CHUNK] for x in (places, *before))


def histories(places: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The three words before each; those before the beginning of a text count as ends."""
    one, two, three = (np.concatenate((np.full(min(k, len(places)), end, np.int32), places[:-k])) for k in (1, 2, 3))
    two = np.where(one == end, np.int32(end), two)
    return one, two, np.where(two == end, np.int32(end), three)


# --- clusters and classes -----------------------------------------------------------------------------


def neighbour_counts(encoded: DataFrame, n: int, end: int) -> np.ndarray:
    """(n, DIMS): how often a listed word has a neighbour of each kind, left and right. The most frequent
    words are kinds of their own, others are hashed."""
    half = DIMS // 2
    per = max(1, ROWS_A_BLOCK * 16)

    def kinds(places: np.ndarray) -> np.ndarray:
        own = half - 8
        return np.where(places < own, places, own + places % 8)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, one = np.zeros(n * DIMS, np.int32), np.ones(CHUNK, np.int32)  # adding an array is faster than a number
        for words, before, _, _ in chunks_of(batches, end):
            a, b = np.flatnonzero(words < n), np.flatnonzero(before < n)
            np.add.at(total, words[a].astype(np.int64) * DIMS + kinds(before[a]), one[: len(a)])
            np.add.at(total, before[b].astype(np.int64) * DIMS + half + kinds(words[b]), one[: len(b)])
        yield from _parts([total[at * DIMS : (at + per) * DIMS] for at in range(0, n, per)])

    sums = sum_blocks(encoded.mapInArrow(count, _PART), "<i4")
    return _gather(sums, [min(per, n - at) * DIMS for at in range(0, n, per)]).reshape(n, DIMS)


def cluster_words(neighbours: np.ndarray, k: int = CLUSTERS, rounds: int = 15) -> np.ndarray:
    """A cluster of each row such that the clusters' shares of neighbours make the rows likely (hard EM)."""
    n = len(neighbours)
    total = neighbours.sum(1)
    if n == 0:
        return np.zeros(0, np.int64)
    k = min(k, n)
    mean = (neighbours.sum(0) + 1e-3) / (total.sum() + 1e-3 * DIMS)
    shares = (neighbours + 2 * mean) / (total + 2)[:, None]
    known = np.argsort(-total, kind="stable")[:2000]
    roots = np.sqrt(shares[known])
    far = ((roots - np.sqrt(mean)) ** 2).sum(1)
    centres = []
    for _ in range(k):  # frequent words that differ most from those chosen
        j = int(np.argmax(far))
        centres.append(shares[known[j]])
        far = np.minimum(far, ((roots - roots[j]) ** 2).sum(1))
    theta = np.log(np.stack(centres))
    own = np.zeros(n, np.int64)
    for _ in range(rounds):
        new = np.argmax(neighbours @ theta.T + 1e-9 * np.arange(k)[None, ::-1], axis=1)
        if (new == own).all():
            break
        own = new
        sums = np.zeros((k, neighbours.shape[1]))
        np.add.at(sums, own, neighbours)
        theta = np.log((sums + 20 * mean) / (sums.sum(1) + 20)[:, None])
    return own


@dataclass
class Classes:
    """``of`` and ``cluster``: the class and the cluster of every place. The class of END holds END alone, those after it
    words that are not listed, one for each cluster."""

    n: int
    end: int
    of: np.ndarray
    cluster: np.ndarray
    count: int
    rare: int
    clusters: int
    order: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    starts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))


def make_classes(words: list[bytes], counts: np.ndarray, end: int, own: np.ndarray, classes: int = CLASSES) -> Classes:
    """Each cluster is cut by frequency into runs of about equal sums of roots; the codes of words that are not
    listed go to the cluster whose listed words begin and end most alike."""
    n, k = len(words), int(own.max(initial=0)) + 1
    of, cluster = np.zeros(n + CODES, np.int16), np.zeros(n + CODES, np.int16)
    mass = np.sqrt(counts + 1.0)
    mass[end] = 0
    next_class = 0
    for c in range(k):
        mine = np.flatnonzero((own == c) & (np.arange(n) != end))
        mine = mine[np.lexsort((mine, -counts[mine]))]
        if len(mine):
            runs = max(1, min(len(mine), round(classes * mass[mine].sum() / mass.sum())))
            upto = np.cumsum(mass[mine])
            run = np.minimum((runs * (upto - 1e-9) / upto[-1]).astype(int), runs - 1)
            of[mine] = next_class + np.unique(run, return_inverse=True)[1]
            next_class = int(of[mine].max()) + 1
            cluster[mine] = c
    of[end], cluster[end] = next_class, k
    rare = next_class + 1
    mask = (1 << CODE_BITS) - 1
    codes = np.array([code_of(w) for w in words], np.int64)
    first, last, types = np.full((mask + 1, k), 0.3), np.full((mask + 1, k), 0.3), np.full(k, 0.3)
    some = np.arange(n) != end
    np.add.at(first, (codes[some] >> CODE_BITS, own[some]), 1)
    np.add.at(last, (codes[some] & mask, own[some]), 1)
    np.add.at(types, own[some], 1)
    first, last = np.log(first / first.sum(0)) + np.log(types), np.log(last / last.sum(0))
    for a in range(mask + 1):
        best = np.argmax(first[a][None, :] + last, axis=1)
        cluster[n + (a << CODE_BITS) : n + ((a + 1) << CODE_BITS)] = best
    of[n:] = rare + cluster[n:]
    order = np.argsort(of[:n], kind="stable")
    starts = np.searchsorted(of[:n][order], np.arange(rare + 1))
    return Classes(n, end, of, cluster, rare + k, rare, k, order, starts)


# --- classes of the next word -------------------------------------------------------------------------


def _hash(x: np.ndarray, rows: int) -> np.ndarray:
    """``rows`` is a power of two."""
    h = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(32) & np.uint64(rows - 1)).astype(np.int64)


class ClassModel:
    """Rows of weights by feature; row 0 is the bias. What is added to a row of the pair of classes is also
    added to the rows of the two classes, so their sums follow from those of the pairs."""

    def __init__(self, classes: Classes) -> None:
        self.count = n = classes.count
        self.kinds = [WORD_ROWS, PAIR_ROWS, n * n, SKIP_ROWS, n, n, n]
        self.first = 1 + np.concatenate(([0], np.cumsum(self.kinds)))
        self.rows = int(self.first[-1])
        self.weights = np.zeros((self.rows, n), np.float32)

    def features(self, of: np.ndarray, w1: np.ndarray, w2: np.ndarray, w3: np.ndarray) -> list[np.ndarray]:
        """Rows that are on besides the bias; the last two are those of the classes alone."""
        c1, c2, c3 = (of[w].astype(np.int64) for w in (w1, w2, w3))
        x1, x2 = w1.astype(np.int64), w2.astype(np.int64)
        found = [_hash(x1, WORD_ROWS), _hash(x1 << 32 | x2, PAIR_ROWS), c1 * self.count + c2, _hash(x2, SKIP_ROWS), c3, c1, c2]
        return [f + at for f, at in zip(found, self.first, strict=False)]

    def marginals(self, sums: np.ndarray) -> None:
        """Fill in the bias' and the single classes' sums from those of pairs."""
        pairs = sums[self.first[2] : self.first[3]].reshape(self.count, self.count, -1)
        sums[self.first[5] : self.first[6]], sums[self.first[6] : self.first[7]] = pairs.sum(1), pairs.sum(0)
        sums[0] = pairs.sum((0, 1))

    def summed(self) -> np.ndarray:
        """The weights, but in the rows of pairs of classes the sums with the rows of both and the bias."""
        n, out = self.count, self.weights.copy()
        pairs = out[self.first[2] : self.first[3]].reshape(n, n, n)
        pairs += self.weights[self.first[5] : self.first[6]][:, None] + self.weights[self.first[6] : self.first[7]][None, :] + self.weights[0]
        return out

    def scored(self, features: list[np.ndarray], summed: np.ndarray, said: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
        """For each run of SCORED tokens its place, what the classes' probabilities are in proportion to, the sum of
        these, and log P(``said``). The arrays are used again for the next run."""
        rows, more = np.empty((2, min(SCORED, len(said)), self.count), summed.dtype)
        ones = np.ones(self.count, summed.dtype)
        for at in range(0, len(said), SCORED):
            part = slice(at, min(at + SCORED, len(said)))
            size = part.stop - at
            raw, other = rows[:size], more[:size]
            np.take(summed, features[0][part], axis=0, out=raw, mode="clip")
            for f in features[1:-2]:
                np.take(summed, f[part], axis=0, out=other, mode="clip")
                raw += other
            own = raw[np.arange(size), said[part]]
            # weights are log ratios of shares, so powers are far from the limits of floats
            np.exp(raw, out=raw)
            total = raw @ ones
            yield part, raw, total, own - np.log(total)

    def blocks(self) -> list[int]:
        return [min(ROWS_A_BLOCK, self.rows - at) * self.count for at in range(0, self.rows, ROWS_A_BLOCK)]


def _add_rows(total: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """total[at] += rows, where places in ``at`` repeat. A column at a time, which is fast where columns are contiguous."""
    if not len(at):
        return
    if (at[1:] >= at[:-1]).all():
        starts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        total[at[starts]] += np.add.reduceat(rows.T, starts, axis=1).T
        return
    low = int(at.min())
    at = at - low
    for c in range(rows.shape[1]):
        sums = np.bincount(at, rows[:, c])
        total[low : low + len(sums), c] += sums


def class_counts(encoded: DataFrame, classes: Classes, model: ClassModel) -> np.ndarray:
    """(rows, classes): how often each class followed each feature; row 0 holds the classes alone."""
    shared = encoded.sparkSession.sparkContext.broadcast(classes)
    sizes, m = model.blocks(), ClassModel(classes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        total = np.zeros(m.rows * m.count, np.int32)
        held: list[np.ndarray] = []
        for words, w1, w2, w3 in chunks_of(batches, c.end):
            said = c.of[words].astype(np.int64)
            held += [f * m.count + said for f in m.features(c.of, w1, w2, w3)[:-2]]
            if len(held) >= 80:  # as many keys as there are sums, so that these are not gone through for a few
                total += np.bincount(np.concatenate(held), minlength=len(total)).astype(np.int32)
                held = []
        if held:
            total += np.bincount(np.concatenate(held), minlength=len(total)).astype(np.int32)
        yield from _parts(np.split(total, np.cumsum(sizes)[:-1]))

    out = _gather(sum_blocks(encoded.mapInArrow(count, _PART), "<i4"), sizes).reshape(model.rows, model.count)
    shared.destroy()
    model.marginals(out)
    return out


def start_weights(counts: np.ndarray, first: np.ndarray, smooth: float = 8.0) -> np.ndarray:
    """Log ratios of the classes' shares after a feature to those at all, damped, as features overlap."""
    share = (counts[0] + 0.5) / (counts[0] + 0.5).sum()
    ratio = np.log((counts + smooth * share) / (counts.sum(1, keepdims=True) + smooth)) - np.log(share)
    weights = np.zeros_like(ratio)
    for at, end, damp in zip(first, first[1:], (0.3, 0.2, 0.3, 0.1, 0.2, 0.2, 0.1), strict=False):
        weights[at:end] = damp * ratio[at:end]
    weights[0] = np.log(share)
    return weights.astype(np.float32)


def train_classes(slices: Callable[[int], DataFrame], steps: int, share: float, classes: Classes, counts: np.ndarray, prior: float = 4.0) -> tuple[ClassModel, list[float]]:
    """The model after ``steps`` steps; step s takes the gradient over all texts of ``slices(s)``, which are about
    ``share`` of all, and moves all weights. A weight's step is scaled by its curvature,
    which about equals the count of its feature and class, and by ``prior`` more, so rare features
    move little. Also the mean log likelihood of each step's texts before it."""
    model = ClassModel(classes)
    model.weights = start_weights(counts, model.first)
    sizes = [*model.blocks(), 2]
    curvature = (counts * share + prior).astype(np.float32)
    fits = []
    for step in range(steps):
        texts = slices(step)
        shared = texts.sparkSession.sparkContext.broadcast((classes, model.weights))
        sums = _gather(sum_blocks(texts.mapInArrow(_gradient(shared, sizes), _PART), "<f4"), sizes)
        shared.destroy()  # the driver keeps nothing of a step that is done
        n, fit = sums[-2:]
        fits.append(float(fit / max(1.0, n)))
        g = sums[:-2].reshape(model.weights.shape)
        model.marginals(g)
        model.weights += (RATE * min(1.0, 2 * (1 - step / steps)) * g / curvature).astype(np.float32)
    return model, fits


def _gradient(shared, sizes: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, weights = shared.value
        model = ClassModel(c)
        model.weights = weights
        total, n, fit, summed = np.zeros(weights.shape[::-1], np.float32).T, 0, 0.0, model.summed()
        for words, *before in chunks_of(batches, c.end):
            # ordered by the class of the third word before, the feature of the fewest rows
            order = np.argsort(c.of[before[2]].astype(np.uint16), kind="stable")
            g, f = gradient(model, c, words[order], [b[order] for b in before], summed)
            for rows, error in g:
                _add_rows(total, rows, error)
            n, fit = n + len(words), fit + f
        yield from _parts([*np.split(total.reshape(-1), np.cumsum(sizes[:-1])[:-1]), np.array([n, fit], np.float32)])

    return run


def gradient(model: ClassModel, classes: Classes, words: np.ndarray, before: list[np.ndarray], summed: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], float]:
    """Pairs (rows, observed - expected) to be added up, the bias and single classes left to
    :meth:`ClassModel.marginals`, and the log likelihood of the words' classes."""
    said = classes.of[words].astype(np.int64)
    features = model.features(classes.of, *before)
    error, fit = np.empty((model.count, len(words))), 0.0
    for part, odds, total, log_p in model.scored(features, summed, said):
        odds *= (-1 / total)[:, None]
        error[:, part] = odds.T
        fit += float(log_p.sum(dtype=np.float64))
    error[said, np.arange(len(words))] += 1
    return [(f, error.T) for f in features[:-2]], fit


# --- words of a class ---------------------------------------------------------------------------------


def word_tables(encoded: DataFrame, classes: Classes, steps: int = 25, ridge: float = 4.0) -> np.ndarray:
    """(clusters + 1, n): log10 P(word | its class, cluster of the word before).

    Tasks count, a block a class; each class's weights are trained where its counts are added up.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(classes)
    groups = classes.clusters + 1
    width = [int(b - a) for a, b in zip(classes.starts, classes.starts[1:], strict=False)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        total = np.zeros((groups, c.n), np.int32)
        flat, one = total.reshape(-1), np.ones(CHUNK, np.int32)
        for words, before, _, _ in chunks_of(batches, c.end):
            some = np.flatnonzero(words < c.n)
            np.add.at(flat, c.cluster[before[some]].astype(np.int64) * c.n + words[some], one[: len(some)])
        yield from _parts([np.ascontiguousarray(total[:, c.order[a : a + w]]).reshape(-1) for a, w in zip(c.starts, width, strict=False)])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                counts = np.frombuffer(data.as_buffer(), np.float64).reshape(groups, -1)
                yield _block(block, train_words(counts, steps, ridge).reshape(-1))

    sums = sum_blocks(encoded.mapInArrow(count, _PART), "<i4").mapInArrow(train, "block int, data binary")
    out = np.zeros((groups, classes.n), np.float32)
    for w, a in zip(width, classes.starts, strict=False):
        if w:  # words of a class without counts are equally likely
            out[:, classes.order[a : a + w]] = -np.log10(w)
    for block, data in zip(*(c.to_pylist() for c in sums.toArrow().columns), strict=True):
        a = classes.starts[block]
        out[:, classes.order[a : a + width[block]]] = np.frombuffer(data, np.float64).reshape(groups, -1)
    shared.destroy()
    return out


def train_words(counts: np.ndarray, steps: int, ridge: float) -> np.ndarray:
    """log10 P(word | group) for ``counts`` (groups, words): weights bias[word] + own[group, word], the second
    ones held small by ``ridge``. Gradient steps scaled by the diagonal of the curvature."""
    total = counts.sum(0)
    bias = np.log(total + 0.5)
    own = np.zeros_like(counts)
    size = counts.sum(1, keepdims=True)

    def log_p() -> np.ndarray:
        raw = bias + own
        raw = raw - raw.max(1, keepdims=True)
        return raw - np.log(np.exp(raw).sum(1, keepdims=True))

    for _ in range(steps):
        expected = size * np.exp(log_p())
        own += np.clip(0.7 * (counts - expected - ridge * own) / (expected + ridge), -1.0, 1.0)
    return log_p() / np.log(10)


# --- pairs of words -----------------------------------------------------------------------------------


@dataclass
class Pairs:
    """log10 P(word | class, word before) of chosen pairs (``keys`` ascending: before * 2^32 + word), and what
    other words of the class get besides their table's value after that word (``heads``: before * 2^32 + class)."""

    keys: np.ndarray
    values: np.ndarray
    heads: np.ndarray
    rests: np.ndarray


def word_pairs(encoded: DataFrame, classes: Classes, tables: np.ndarray, most: int = PAIRS) -> Pairs:
    """Pairs of listed words whose share in the texts gains LEAST_GAIN in log likelihood over the tables'; where more than ``most`` do, those of the largest gains (a bound on
    the model's size). Counts cover all texts."""
    shared = encoded.sparkSession.sparkContext.broadcast((classes, tables))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, _ = shared.value
        held, size = [], 0
        for words, before, _, _ in chunks_of(batches, c.end):
            some = (words < c.n) & (before < c.n) & (words != c.end)
            held.append(before[some].astype(np.int64) << 32 | words[some])
            size += len(held[-1])
            if size > PAIRS_HELD:
                yield _bucketed(held)
                held, size = [], 0
        if size:
            yield _bucketed(held)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, tables = shared.value
        for keys, n in _pair_counts(batches):
            words = keys & 0xFFFFFFFF
            heads, owner = np.unique(keys >> 32 << 32 | c.of[words].astype(np.int64), return_inverse=True)
            totals = np.bincount(owner, n).astype(np.int64)[owner]
            base = 10.0 ** tables[c.cluster[keys >> 32], words].astype(np.float64)
            gain = n * np.log(np.maximum(n - DISCOUNT, 1e-9) / (totals * base))
            some = gain >= LEAST_GAIN
            yield pa.RecordBatch.from_arrays(
                [pa.array(heads[owner[some]]), pa.array(totals[some]), pa.array(words[some].astype(np.int32)), pa.array(n[some]), pa.array(base[some]), pa.array(gain[some])],
                names=["head", "total", "word", "n", "base", "gain"],
            )

    # dealt by the word before, so that pairs and what begins them are counted in one go
    blocks = encoded.mapInArrow(count, "bucket int, pairs binary, n binary").repartition("bucket").sortWithinPartitions("bucket")
    chosen = blocks.mapInArrow(choose, "head long, total long, word int, n long, base double, gain double")
    chosen = checkpoint(chosen)
    cells = chosen.groupBy(F.floor(F.log2("gain") * 8).cast("int").alias("cell")).agg(F.count("*").alias("n")).orderBy(F.desc("cell")).collect()
    least, held = None, 0
    for r in cells:
        held += r["n"]
        if held > most:
            break
        least = r["cell"]
    rows = chosen.where(F.floor(F.log2("gain") * 8) >= (least if least is not None else 1 << 30)).select("head", "total", "word", "n", "base").toArrow()
    shared.destroy()
    return solve_pairs(*(c.to_numpy() for c in rows.columns))


def _bucketed(held: list[np.ndarray]) -> pa.RecordBatch:
    """A row a bucket: its pairs, ascending, and how often each occurs."""
    keys = np.concatenate(held)
    keys.sort()
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    n = np.diff(np.append(starts, len(keys))).astype(np.int32)
    keys = keys[starts]
    bucket = _hash(keys >> 32, PAIR_BUCKETS).astype(np.uint16)
    order = np.argsort(bucket, kind="stable")
    keys, n, bucket = keys[order], n[order], bucket[order]
    cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    ends = np.append(cuts[1:], len(keys))
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket[cuts].astype(np.int32)), *(pa.array([x[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary()) for x in (keys, n))], names=["bucket", "pairs", "n"]
    )


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs and their counts, a bucket at a time, from rows ordered by bucket; pairs of several rows are added up
    as soon as there are PAIRS_HELD."""
    at, keys, n, size = None, [], [], 0
    for batch in batches:
        for bucket, k, m in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            if bucket != at:
                if at is not None:
                    yield _merged(keys, n)
                at, keys, n, size = bucket, [], [], 0
            keys.append(np.frombuffer(k.as_buffer(), np.int64))
            n.append(np.frombuffer(m.as_buffer(), np.int32))
            size += len(keys[-1])
            if size > PAIRS_HELD:
                keys, n = ([x] for x in _merged(keys, n))
                size = 0
    if at is not None:
        yield _merged(keys, n)


def _merged(keys: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    both, of = np.concatenate(keys), np.concatenate(n)
    order = np.argsort(both, kind="stable")
    both = both[order]
    starts = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1])))
    return both[starts], np.add.reduceat(of[order].astype(np.int64), starts)


def solve_pairs(head: np.ndarray, total: np.ndarray, word: np.ndarray, n: np.ndarray, base: np.ndarray) -> Pairs:
    """The distribution nearest to the table's whose shares of the chosen pairs are the discounted ones."""
    heads, at = np.unique(head, return_inverse=True)
    share = (n - DISCOUNT) / total
    taken = np.bincount(at, share, len(heads))
    was = np.bincount(at, base, len(heads))
    # a class of which every word is chosen leaves nothing for others
    rests = np.log10(np.maximum(1 - taken, 1e-9) / np.maximum(1 - was, 1e-9))
    scale = np.where(was > 1 - 1e-6, 1 / taken, 1.0)
    keys = (head >> 32 << 32) | word.astype(np.int64)
    order = np.argsort(keys)
    return Pairs(keys[order], np.log10(share * scale[at])[order].astype(np.float32), heads, rests.astype(np.float32))


# --- scoring ------------------------------------------------------------------------------------------


@dataclass
class Model:
    classes: Classes
    weights: np.ndarray
    tables: np.ndarray
    pairs: Pairs

    def scores(self, words: np.ndarray, before: tuple[np.ndarray, ...]) -> np.ndarray:
        """log10 P(class | history), with P(word | class, word before) for listed words."""
        c = self.classes
        model = ClassModel(c)
        model.weights = self.weights
        out, summed = np.zeros(len(words)), model.summed()
        said = c.of[words].astype(np.int64)
        for at in range(0, len(words), CHUNK):
            chunk = slice(at, at + CHUNK)
            found = out[chunk]
            for part, _, _, log_p in model.scored(model.features(c.of, *(b[chunk] for b in before)), summed, said[chunk]):
                found[part] = log_p / np.log(10)
        some = np.flatnonzero(words < c.n)
        w, w1 = words[some], before[0][some].astype(np.int64)
        value = self.tables[c.cluster[w1], w].astype(np.float64)
        p = self.pairs
        if len(p.keys):
            at = np.flatnonzero(w1 < c.n)
            at = at[np.argsort(w1[at] << 32 | w[at])]  # what is looked up in order is found in the cache
            head = w1[at] << 32
            value[at] += _looked_up(p.heads, p.rests, head | said[some[at]], 0.0)
            value[at] = _looked_up(p.keys, p.values, head | w[at].astype(np.int64), value[at])
        out[some] += value
        return out


def _looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, otherwise) -> np.ndarray:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], otherwise)
