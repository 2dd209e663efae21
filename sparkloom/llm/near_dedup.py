"""Near-duplicate detection with DartMinHash signatures and banded joins.

Texts are sets of hashed shingles (five words). Darts are thrown into the plane of weight and rank of
each element: every dyadic region of the plane gets a hashed Poisson number of darts, a dart counts
when it lies under the element's weight, and each dart belongs to a hashed coordinate of the
signature. The earliest dart of a coordinate is its value. Ranks are only enumerated up to the bound
at which k coordinates are expected to be hit, so the work is near (elements + k log k) instead of
(elements x k). Two sets agree in a coordinate with the probability of their weighted Jaccard
similarity, and documents that agree in all rows of a band become candidates.

Equal word sequences are one class from the start. In each band's bucket the members are compared
with the bucket's pivot; members of one component need no further comparison. Only pairs of different
components that share a bucket follow, those of large buckets in blocks within tasks, so no link that
joins two groups is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.caching import WordCache, kept_by_worker
from sparkloom.llm.common import col, fresh
from sparkloom.shipping import checkpoint

WORDS = 5
THRESHOLD = 0.8
BANDS = 24
ROWS = 5
PAIR_ROWS = 32
BLOCK_ROWS = 256
BROADCAST_ROWS = 200_000
ELEMENTS_AT_ONCE = 400_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values (the finaliser of splitmix64; its constants are fixed values)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Odd multipliers of a shingle's words, from a rule: mixes of 1, 2, 3, ...
_ODD = mix(np.arange(1, 33, dtype=np.uint64)) | np.uint64(1)


def uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


class Shingler:
    """Sorted distinct hashes of a text's shingles; a shorter text is one shingle, an empty one none."""

    def __init__(self, words: int = WORDS) -> None:
        self.words = words
        self.known = WordCache()

    def __call__(self, text: str) -> np.ndarray:
        tokens = text.encode("utf-8", "replace").split()
        if not tokens:
            return np.empty(0, np.uint64)
        found = self.known.values(tokens, xxhash.xxh64_digest)
        h = np.frombuffer(b"".join(found), np.uint64)
        n = max(1, len(h) - self.words + 1)
        out = np.zeros(n, np.uint64)
        for k in range(min(self.words, len(h))):
            out += h[k : k + n] * _ODD[k % len(_ODD)]
        return np.unique(mix(out))


def dart_signatures(elements: np.ndarray, owner: np.ndarray, weights: np.ndarray, n_sets: int, k: int, seed: int = 1) -> np.ndarray:
    """Signatures of many weighted sets: an array (n_sets, k) of dart identities, 0 where a set is empty.

    ``elements`` are 64-bit hashes, ``owner`` the set that each belongs to, ``weights`` positive.
    """
    total = np.bincount(owner, weights, n_sets)
    signature = np.zeros((n_sets, k), np.uint64)
    ranks = np.full((n_sets, k), np.inf)
    todo = total > 0
    reach = (k * np.log(k) + 2 * k) / np.where(todo, total, 1.0)
    low = np.zeros(n_sets)
    while todo.any():
        _throw(elements, owner, weights, low, np.where(todo, reach, 0.0), k, seed, ranks, signature)
        # a set with an unhit coordinate throws on, from where it stopped; ranks only ever get larger
        low = reach
        todo = todo & np.isinf(ranks).any(axis=1)
        reach = 2 * reach
    return signature


def _throw(elements, owner, weights, low, high, k, seed, ranks, signature) -> None:
    """Darts with ranks in [low, high) of each set. A region is a dyadic weight band times a dyadic rank
    band; its number of darts has the mean of its area, and all is drawn from hashes of the element and
    the region, so equal elements get equal darts in all sets."""
    top_rank, top_weight = float(high.max(initial=0.0)), float(weights.max(initial=0.0))
    if top_rank <= 0:
        return
    first = 2.0**-4
    rank_bands = [(0.0, first)]
    while rank_bands[-1][1] < top_rank:
        rank_bands.append((rank_bands[-1][1], 2 * rank_bands[-1][1]))
    weight_bands = [(0.0, 1.0)]
    while weight_bands[-1][1] < top_weight:
        weight_bands.append((weight_bands[-1][1], 2 * weight_bands[-1][1]))
    thrown: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for v, (w0, w1) in enumerate(weight_bands):
        for r, (r0, r1) in enumerate(rank_bands):
            at = np.flatnonzero((weights > w0) & (high[owner] > r0) & (low[owner] < r1))
            if not at.size:
                continue
            # a wide band is cut so that each cell has a mean of at most one
            cells = max(1, int(np.ceil((w1 - w0) * (r1 - r0))))
            width = (r1 - r0) / cells
            mean = (w1 - w0) * width
            steps = np.cumsum([np.exp(-mean) * mean**n / float(np.prod(np.arange(1, n + 1))) for n in range(13)])
            none = np.uint64(min(float(steps[0]), 1 - 2.0**-53) * 2.0**64)
            part, all_inside = elements[at], bool((weights[at] >= w1).all())
            for c in range(cells):
                base = mix(part ^ mix(np.full(1, (seed << 48) ^ (v << 40) ^ (r << 32) ^ c, np.uint64)))
                some = np.flatnonzero(base >= none)  # the others have no dart here
                count = np.searchsorted(steps, uniform(base[some]))
                for d in range(int(count.max(initial=0))):
                    hit = some[count > d]
                    dart = mix(base[hit] + np.uint64(2 * d + 1))
                    who = owner[at[hit]]
                    rank = r0 + width * (c + uniform(mix(dart ^ np.uint64(1))))
                    inside = (rank < high[who]) & (rank >= low[who])
                    if not all_inside:
                        inside &= w0 + (w1 - w0) * uniform(mix(dart ^ np.uint64(2))) < weights[at[hit]]
                    thrown.append((who[inside] * k + (dart[inside] % np.uint64(k)).astype(np.int64), rank[inside], dart[inside]))
    if thrown:
        slot, rank, dart = (np.concatenate(x) for x in zip(*thrown, strict=True))
        order = np.argsort(-rank, kind="stable")  # of those assigned to a coordinate, the last and earliest stays
        order = order[rank[order] < ranks.reshape(-1)[slot[order]]]
        signature.reshape(-1)[slot[order]] = dart[order]
        ranks.reshape(-1)[slot[order]] = rank[order]


def signatures_of_texts(texts: list[str], shingler: Shingler, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures and numbers of shingles; a dart counts by its hash, so 0 stands for an empty text."""
    sets = [shingler(t) for t in texts]
    sizes = np.array([len(s) for s in sets], np.int64)
    elements = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    return dart_signatures(elements, owner, np.ones(len(elements)), len(sets), k), sizes


def shingler_of(words: int) -> Shingler:
    """One per worker process."""
    return kept_by_worker(("shingles", words), lambda: Shingler(words))


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) // 5
        if size > ELEMENTS_AT_ONCE:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


SIGNED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("digest", T.BinaryType()),
        T.StructField("keys", T.ArrayType(T.LongType())),
    ]
)


def _sign(words: int, bands: int, rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(id, text) to (id, digest of the word sequence, one hash a band); no hashes for a text without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = shingler_of(words)
        for batch in batches:
            for part in range(0, batch.num_rows, 1000):
                ids, texts = batch.column(0).slice(part, 1000), [t or "" for t in batch.column(1).slice(part, 1000).to_pylist()]
                for a, b in _chunks(texts):
                    sig, sizes = signatures_of_texts(texts[a:b], shingler, bands * rows)
                    keys = np.zeros((len(sig), bands), np.uint64)
                    for r in range(rows):
                        keys = mix(keys * np.uint64(31) + sig[:, r * bands : (r + 1) * bands] + np.uint64(r + 1))
                    keys = mix(keys + np.arange(1, bands + 1, dtype=np.uint64)).view(np.int64)
                    some = sizes > 0
                    digests = [hashlib.sha256(b" ".join(t.encode("utf-8", "replace").split())).digest() for t in texts[a:b]]
                    yield pa.RecordBatch.from_arrays(
                        [
                            ids.slice(a, b - a),
                            pa.array(digests, pa.binary()),
                            pa.array([k if x else None for k, x in zip(keys, some, strict=True)], pa.list_(pa.int64())),
                        ],
                        names=SIGNED.names,
                    )

    return run


def _jaccard(words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(a, b, text_a, text_b) to (a, b, similarity), exact up to collisions of 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = shingler_of(words)
        last, last_set = None, None
        for batch in batches:
            out = []
            for part in range(0, batch.num_rows, 200):
                for x, y in zip(batch.column(2).slice(part, 200).to_pylist(), batch.column(3).slice(part, 200).to_pylist(), strict=True):
                    if x != last:
                        last, last_set = x, shingler(x or "")
                    other = shingler(y or "")
                    both = len(np.intersect1d(last_set, other, assume_unique=True))
                    either = len(last_set) + len(other) - both
                    out.append(both / either if either else 1.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], names=["a", "b", "similarity"])

    return run


def small(df: DataFrame) -> DataFrame:
    """``df``, a checkpointed one, marked for broadcast if it has at most BROADCAST_ROWS rows (of a few
    numbers each); else as it is, so that the join shuffles."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _compare(pairs: DataFrame, docs: DataFrame, words: int, threshold: float) -> DataFrame:
    """Links among the checkpointed pairs (a, b). Texts of documents in pairs are shuffled, once a pair; those
    of others too only if the pairs are too many to be broadcast."""
    p = small(pairs)
    left = docs.join(p, docs["doc_id"] == p["a"]).select("a", "b", F.coalesce("text", F.lit("")).alias("text_a"))
    right = docs.join(p, docs["doc_id"] == p["b"]).select("a", "b", F.coalesce("text", F.lit("")).alias("text_b"))
    joined = left.join(right, ["a", "b"]).select("a", "b", "text_a", "text_b").dropDuplicates(["a", "b"])  # an id may repeat
    found = joined.mapInArrow(_jaccard(words), "a long, b long, similarity double")
    return found.where(F.col("similarity") >= threshold).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (a, b): rows (node, component), the smallest node of each.

    Every node takes the smallest label of its neighbours and itself; from the third round on also the
    label of its label, which halves what is left of long chains. Only whether anything changed
    reaches the driver.
    """
    both = checkpoint(edges.where("a <> b").select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b").distinct())
    labels = checkpoint(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")))
    rounds = 0
    while True:
        known = small(labels)
        sent = both.join(known, both["b"] == known["node"]).select(F.col("a").alias("node"), "component", F.lit(None).cast("long").alias("was"))
        own = labels.select("node", "component", F.col("component").alias("was"))
        new = sent.unionByName(own).groupBy("node").agg(F.min("component").alias("component"), F.max("was").alias("was"))
        if rounds >= 2:
            jump = known.select(F.col("node").alias("component"), F.col("component").alias("further"))
            new = new.join(jump, "component", "left").select("node", "was", F.least("component", F.coalesce("further", "component")).alias("component"))
        new = checkpoint(new)
        labels, rounds = new.select("node", "component"), rounds + 1
        if new.where("component <> was").isEmpty():
            return labels


def similar_pairs(classes: DataFrame, docs: DataFrame, words: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Links (a, b), and their components, of a similarity of at least ``threshold`` between classes
    (rep, keys).

    At the end any two classes that share a bucket are in one component or have been compared. First
    every bucket's members are compared with its smallest. Then only pairs of different components
    matter: those of buckets of up to PAIR_ROWS members are compared as distinct pairs, larger buckets
    in blocks of BLOCK_ROWS members, whose pairs never leave the task.
    """
    members = classes.where("keys is not null").select("rep", F.explode("keys").alias("key"))
    shared = checkpoint(members.groupBy("key").agg(F.min("rep").alias("pivot"), F.count("*").alias("n")).where("n > 1").select("key", "pivot"))
    buckets = checkpoint(members.join(small(shared), "key").where("rep <> pivot"))
    tried = checkpoint(buckets.select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct())
    links = checkpoint(_compare(tried, docs, words, threshold))
    labels = components(links)
    placed = buckets.select("key", "rep").join(small(labels).withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
    mixed = checkpoint(placed.groupBy("key").agg(F.count("*").alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key", "n"))
    rest = checkpoint(placed.join(small(mixed), "key"))
    few, many = rest.where(F.col("n") <= PAIR_ROWS), rest.where(F.col("n") > PAIR_ROWS)
    other = few.select("key", F.col("rep").alias("b"), F.col("component").alias("other"))
    pairs = few.select("key", F.col("rep").alias("a"), "component").join(other, "key").where("component <> other and a < b")
    new = checkpoint(pairs.select("a", "b").distinct().join(small(tried), ["a", "b"], "left_anti"))
    more = _compare(new, docs, words, threshold)
    if not many.isEmpty():
        more = more.unionByName(_compare_blocks(many, docs, words, threshold))
    more = checkpoint(more)
    if more.isEmpty():
        return links, labels
    links = checkpoint(links.unionByName(more).distinct())
    return links, components(links)


def _compare_blocks(rows: DataFrame, docs: DataFrame, words: int, threshold: float) -> DataFrame:
    """Links that join components of ``rows`` (key, rep, component, n), bucket by bucket.

    A bucket's members are dealt to blocks by their hash, and every two blocks meet in one task, which
    holds those two only. There the pairs of different components are compared, sizes first (sets
    whose sizes differ too much cannot be similar), and a link merges its two components, so a
    component is compared on only until one link is found.
    """
    last = F.ceil(F.col("n") / BLOCK_ROWS).cast("int") - 1
    block = F.pmod(F.xxhash64("rep", "key"), last + 1).cast("int")
    each = rows.select("key", "rep", "component", block.alias("block"), F.explode(F.sequence(F.lit(0), last)).alias("with"))
    placed = each.select("key", "rep", "component", "block", F.least("block", "with").alias("x"), F.greatest("block", "with").alias("y"))
    some = checkpoint(rows.select("rep").distinct())
    texts = docs.join(small(some), docs["doc_id"] == some["rep"], "left_semi").select(F.col("doc_id").alias("rep"), F.coalesce("text", F.lit("")).alias("text"))
    texts = checkpoint(texts)

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        shingler = shingler_of(words)
        frame = frame.drop_duplicates("rep").sort_values("rep")
        reps, blocks = frame["rep"].tolist(), frame["block"].tolist()
        sets = [shingler(t) for t in frame["text"]]
        parent = {c: c for c in frame["component"]}
        component = frame["component"].tolist()
        apart = frame["x"].iloc[0] != frame["y"].iloc[0]
        out = []

        def root(c: int) -> int:
            while parent[c] != c:
                parent[c] = c = parent[parent[c]]
            return c

        order = sorted(range(len(reps)), key=lambda i: len(sets[i]))
        for at, i in enumerate(order):
            for j in order[at + 1 :]:
                if len(sets[i]) < threshold * len(sets[j]):
                    break
                if apart and blocks[i] == blocks[j]:
                    continue  # these two meet in their own block's task
                u, v = root(component[i]), root(component[j])
                if u != v:
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if both >= threshold * (len(sets[i]) + len(sets[j]) - both):
                        parent[u] = v
                        out.append((min(reps[i], reps[j]), max(reps[i], reps[j])))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return placed.join(texts, "rep").groupBy("key", "x", "y").applyInPandas(compare, "a long, b long")


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """One row per row of ``df``: ``doc_id, rep_id, group_id, n_links, kept``.

    Texts whose words are the same sequence are one class, ``rep_id`` its smallest id; classes joined
    by links of a similarity of at least ``threshold`` are one group, ``group_id`` its smallest id.
    ``n_links`` counts the links found at the class; links between documents that others join already
    need not be among them. A null text counts as empty; all empty texts are
    one class. A text of fewer words than a shingle is one shingle. Rows without an id are in no group
    (``group_id`` null) and stay. Rows that repeat an id and a text share their result. A table
    without rows gives none.
    """
    docs = df.select(col(df, id_col).cast("long").alias("doc_id"), col(df, text_col).cast("string").alias("text"))
    return groups_of(docs, words, threshold, bands, rows)


def groups_of(docs: DataFrame, words: int, threshold: float, bands: int, rows: int) -> DataFrame:
    known = docs.where("doc_id is not null")
    signed = checkpoint(known.mapInArrow(_sign(words, bands, rows), SIGNED))
    # equal word sequences have equal keys
    classes = checkpoint(signed.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys")))
    members = signed.select("doc_id", "digest").join(small(classes.select("digest", F.col("rep").alias("rep_id"))), "digest").select("doc_id", "rep_id")
    links, labels = similar_pairs(classes, known, words, threshold)
    degree = links.select(F.col("a").alias("node")).union(links.select("b")).groupBy("node").agg(F.count("*").alias("n_links"))
    found = checkpoint(labels.join(degree, "node").withColumnRenamed("node", "rep_id"))
    out = members.join(small(found), "rep_id", "left").select(
        "doc_id",
        "rep_id",
        F.coalesce("component", "rep_id").alias("group_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )
    none = docs.where("doc_id is null").select("doc_id", *(F.lit(None).cast("long").alias(c) for c in ("rep_id", "group_id")), F.lit(0).cast("long").alias("n_links"))
    return out.unionByName(none).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("group_id"), F.lit(True)))


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """The rows of ``df`` that stay: of each group the one with the smallest id; rows without an id too."""
    (kept_id,) = fresh(df, "kept_id")
    found = near_duplicates(df, id_col, text_col, **parameters).where("kept and doc_id is not null").select(F.col("doc_id").alias(kept_id)).distinct()
    at = col(df, id_col)
    return df.join(found, at == F.col(kept_id), "left_semi").unionByName(df.where(at.isNull()))
