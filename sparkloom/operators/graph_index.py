"""A sharded, layered graph index that is stored, searched in one pass, and inserted into.

Cells around centres, cut by planes where they are large, deal the vectors to pieces of a bounded size. A piece is
one row: ids, vectors and the links of its layers as packed arrays. A search ships its queries to the pieces of
their nearest cells; there all hops of all queries run inside the task, on arrays, so that nothing but each piece's
best is shuffled. An insertion routes new vectors to their pieces alike, finds each one's neighbours by a beam
search of the stored graph, links both ways and selects anew only where a node's links changed; pieces without new
vectors pass through unchanged.

Two kinds: ``layered`` (diverse links, capped, nodes of upper levels linked in layers of their own) and ``flat`` (one
layer, links to the nearest without a cap, entered at a hashed node).
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.functions.draws import digest_number
from sparkloom.functions.vectors import METRICS, NORM_FLOOR
from sparkloom.operators.ann import centres
from sparkloom.operators.knn import DIGITS, QUERY_BLOCK, Best, distances, knn, matrix, recall
from sparkloom.operators.runs import runs
from sparkloom.shipping import checkpoint

PIECE_ROWS = 4096
#: Rows of a piece whose candidates are compared at once.
BLOCK = 256
#: Pairs of vectors that are held at once.
PAIRS = 1 << 14
#: Queries that walk a piece at once, and nodes that each of them expands in a step.
WALKERS, EXPAND = 256, 8
MOST_CELLS = 4096
#: Planes that may cut a cell: into 2^PLANES pieces at most, before what is left is dealt by hash.
PLANES = 24


@dataclass(frozen=True)
class Settings:
    m: int = 16
    metric: str = "cosine"
    kind: str = "layered"
    ef_construction: int = 100
    seed: int = 0
    #: Keep vectors in single precision. Without it, those that lose nothing thereby are.
    single: bool = False

    def __post_init__(self) -> None:
        if self.m < 2:
            raise ValueError("m must be at least 2")
        if self.metric not in METRICS:
            raise ValueError(f"unknown metric {self.metric!r}; known: {', '.join(sorted(METRICS))}")
        if self.kind not in ("layered", "flat"):
            raise ValueError("kind is layered or flat")

    def cap(self, layer: int) -> int:
        """Most links of a node."""
        return (1 << 30) if self.kind == "flat" else 2 * self.m if layer == 0 else self.m


@dataclass
class Links:
    """Neighbours of ``n`` nodes: those of node i are dst[off[i]:off[i + 1]], ascending."""

    off: np.ndarray
    dst: np.ndarray

    @classmethod
    def of(cls, n: int, src: np.ndarray, dst: np.ndarray) -> Links:
        key = np.unique(src.astype(np.int64) * n + dst)
        return cls(np.searchsorted(key, np.arange(n + 1) * n).astype(np.int32), (key % max(n, 1)).astype(np.int32))

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(np.arange(len(self.off) - 1), np.diff(self.off)), self.dst.astype(np.int64)

    def around(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``nodes``, neighbour) of all neighbours of ``nodes``."""
        first, n = self.off[nodes], self.off[nodes + 1] - self.off[nodes]
        at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return np.repeat(np.arange(len(nodes)), n), self.dst[at]


def prepared(v: np.ndarray, metric: str) -> np.ndarray:
    """Rows that the metric compares: unit ones for the cosine."""
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), NORM_FLOOR) if metric == "cosine" else v


def gap(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distances along the last axis of prepared rows, in an order that serves ranking (squares for euclidean)."""
    if metric == "cosine":
        return 1 - np.einsum("...j,...j->...", a, b)
    d = a - b
    return np.einsum("...j,...j->...", d, d)


def gaps(x: np.ndarray, a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """:func:`gap` of the rows ``a`` and ``b`` of ``x``, some pairs at a time."""
    out = np.empty(len(a), x.dtype)
    for at in range(0, len(a), PAIRS):
        out[at : at + PAIRS] = gap(x[a[at : at + PAIRS]], x[b[at : at + PAIRS]], metric)
    return out


def select(x: np.ndarray, nodes: np.ndarray, around: np.ndarray, own: np.ndarray, m: int, metric: str) -> np.ndarray:
    """Which of each node's candidates (positions ``around``, ascending distances ``own``, infinite where there is none)
    stay: those closer to the node than to every one kept before, then the nearest others, up to ``m``."""
    y = x[around]
    inner = np.einsum("bij,bkj->bik", y, y)
    if metric == "cosine":
        among = 1 - inner
    else:
        square = np.einsum("bij,bij->bi", y, y)
        among = square[:, :, None] + square[:, None, :] - 2 * inner
    kept, real = np.zeros(own.shape, bool), np.isfinite(own)
    closest, count = np.full(own.shape, np.inf, among.dtype), np.zeros(len(own), int)
    for i in range(own.shape[1]):
        ok = real[:, i] & (own[:, i] < closest[:, i]) & (count < m)
        kept[:, i] = ok
        count += ok
        closest = np.where(ok[:, None], np.minimum(closest, among[:, i, :]), closest)
    others = real & ~kept
    return kept | (others & (np.cumsum(others, axis=1) <= (m - count)[:, None]))


def nearest(x: np.ndarray, rows: np.ndarray, to: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """(positions, distances) of the k of ``to`` nearest to each of ``rows``, not itself, ascending."""
    a, b = x[rows], x[to]
    d = 1 - a @ b.T if metric == "cosine" else (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    d[rows[:, None] == to[None, :]] = np.inf
    k = min(k, len(to))
    some = np.argpartition(d, k - 1, axis=1)[:, :k]
    near = np.take_along_axis(d, some, 1)
    order = np.lexsort((some, near), axis=1)
    return to[np.take_along_axis(some, order, 1)], np.take_along_axis(near, order, 1)


def chosen(x: np.ndarray, nodes: np.ndarray, src: np.ndarray, dst: np.ndarray, cap: int, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Links (src, dst) of ``nodes`` without those that :func:`select` does not keep, and each of the rest only where
    both its ends keep it; links between other nodes stay."""
    n = len(x)
    count = np.bincount(src, minlength=n)
    full = nodes[count[nodes] > cap]
    if not len(full):
        return src, dst
    over = np.zeros(n, bool)
    over[full] = True
    mine = over[src]
    s, t = src[mine], dst[mine]
    d = gaps(x, s, t, metric)
    order = np.lexsort((t, d, s))
    s, t, d = s[order], t[order], d[order]
    place = np.arange(len(s)) - np.searchsorted(s, s)
    dropped = []
    for at in range(0, len(full), BLOCK):
        some = full[at : at + BLOCK]
        row = np.full(n, -1)
        row[some] = np.arange(len(some))
        here = (row[s] >= 0) & (place < 4 * cap)
        around, own = np.zeros((len(some), int(place[here].max()) + 1), np.int64), np.full((len(some), int(place[here].max()) + 1), np.inf)
        around[row[s[here]], place[here]] = t[here]
        own[row[s[here]], place[here]] = d[here]
        stay = select(x, some, around, own, cap, metric)
        keep = np.zeros(len(s), bool)
        keep[np.flatnonzero(here)] = stay[row[s[here]], place[here]]
        out = (row[s] >= 0) & ~keep
        dropped.append(s[out] * n + t[out])
    gone = np.concatenate(dropped)
    gone = np.concatenate((gone, gone % n * n + gone // n))
    left = ~np.isin(src * n + dst, gone)
    return src[left], dst[left]


def parted(n: int, links: Links) -> np.ndarray:
    """For each of ``n`` nodes the smallest node that paths join it to."""
    src, dst = links.pairs()
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, src, label[dst])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def bridged(x: np.ndarray, nodes: np.ndarray, links: Links, metric: str) -> Links:
    """``links`` with one more link for each part of ``nodes`` that no path joins to the largest."""
    n = len(x)
    src, dst = links.pairs()
    label = parted(n, links)
    parts, size = np.unique(label[nodes], return_counts=True)
    if len(parts) < 2:
        return links
    main = parts[np.argmax(size)]
    more_s, more_t = [], []
    while len(parts := np.unique(label[nodes])) > 1:
        part = nodes[label[nodes] == next(p for p in parts if p != main)]
        to, d = nearest(x, part, nodes[label[nodes] != label[part[0]]], 1, metric)
        a = part[np.argmin(d[:, 0])]
        b = to[np.argmin(d[:, 0]), 0]
        more_s += [a, b]
        more_t += [b, a]
        label[label == label[a]] = label[b]
        main = label[b] if label[b] != main and not (label[nodes] == main).any() else main
    return Links.of(n, np.concatenate((src, more_s)), np.concatenate((dst, more_t)))


@dataclass
class Piece:
    ids: np.ndarray
    v: np.ndarray
    level: np.ndarray
    layers: list[Links] = field(default_factory=list)

    def nodes(self, layer: int) -> np.ndarray:
        return np.flatnonzero(self.level >= layer)

    def build(self, s: Settings) -> Piece:
        """Links from the exact nearest neighbours within the piece."""
        x = prepared(self.v, s.metric).astype(np.float32)
        self.layers = []
        for layer in range(1 if s.kind == "flat" else int(self.level.max(initial=0)) + 1):
            nodes = self.nodes(layer)
            src, dst = [], []
            for at in range(0, len(nodes) if len(nodes) > 1 else 0, BLOCK):
                some = nodes[at : at + BLOCK]
                around, own = nearest(x, some, nodes, s.m if s.kind == "flat" else 3 * s.m, s.metric)
                own = np.where(around == some[:, None], np.inf, own)
                stay = np.isfinite(own) if s.kind == "flat" else select(x, some, around, own, s.cap(layer), s.metric)
                i, j = np.nonzero(stay)
                src.append(some[i])
                dst.append(around[i, j])
            self.layers.append(self._closed(x, nodes, np.concatenate(src) if src else np.empty(0, np.int64), np.concatenate(dst) if dst else np.empty(0, np.int64), s, layer))
        return self

    def _closed(self, x, nodes, src, dst, s: Settings, layer: int) -> Links:
        n = len(self.ids)
        both = Links.of(n, np.concatenate((src, dst)), np.concatenate((dst, src)))
        a, b = chosen(x, nodes, *both.pairs(), s.cap(layer), s.metric)
        return bridged(x, nodes, Links.of(n, a, b), s.metric)

    def insert(self, ids: np.ndarray, v: np.ndarray, level: np.ndarray, s: Settings) -> Piece:
        """New vectors, linked to what a beam search of the stored graph and the other new ones offer."""
        old = len(self.ids)
        if not old:
            return Piece(ids, v, level).build(s)
        out = Piece(np.concatenate((self.ids, ids)), np.concatenate((self.v.astype(np.float64), v)), np.concatenate((self.level, level)))
        x = prepared(out.v, s.metric).astype(np.float32)
        n, new = len(x), np.arange(old, len(out.ids))
        for layer in range(max(len(self.layers), 1 if s.kind == "flat" else int(level.max(initial=0)) + 1)):
            had = self.layers[layer] if layer < len(self.layers) else Links.of(old, np.empty(0, np.int64), np.empty(0, np.int64))
            src, dst = had.pairs()
            mine = new if s.kind == "flat" else new[level >= layer]
            if len(mine):
                pool, per = [], []
                there = self.nodes(layer)
                if len(there):
                    for at in range(0, len(mine), WALKERS):
                        some = mine[at : at + WALKERS]
                        found, d = self._walk(x[some], x[:old], s, s.ef_construction, layer)
                        pool.append(found)
                        per.append(d)
                beside, near = nearest(x, mine, mine, min(3 * s.m, len(mine)), s.metric)
                near = np.where(beside == mine[:, None], np.inf, near)
                around = np.concatenate((np.concatenate(pool), beside), axis=1) if pool else beside
                own = np.concatenate((np.concatenate(per), near), axis=1) if pool else near
                order = np.lexsort((around, own), axis=1)[:, : max(3 * s.m, 1)]
                around, own = np.take_along_axis(around, order, 1), np.take_along_axis(own, order, 1)
                around = np.where(np.isfinite(own), around, 0)
                for at in range(0, len(mine), BLOCK):
                    part = slice(at, at + BLOCK)
                    stay = np.isfinite(own[part]) & (np.arange(own.shape[1]) < s.m) if s.kind == "flat" else select(x, mine[part], around[part], own[part], s.m, s.metric)
                    i, j = np.nonzero(stay)
                    a, b = mine[part][i], around[part][i, j]
                    src, dst = np.concatenate((src, a, b)), np.concatenate((dst, b, a))
            both = Links.of(n, src, dst)
            touched = np.unique(np.concatenate((mine, dst[src >= old], src[dst >= old]))).astype(np.int64)
            a, b = chosen(x, touched, *both.pairs(), s.cap(layer), s.metric)
            out.layers.append(bridged(x, out.nodes(layer) if s.kind != "flat" else np.arange(n), Links.of(n, a, b), s.metric))
        return out

    def search(self, best: Best, rows: np.ndarray, ef: int, s: Settings) -> None:
        """Offer to ``best`` what beams of width ``ef`` find for its queries ``rows``.

        A beam as wide as the piece drops no node, so it ends with all that links reach from where it entered. Beams of
        half that width or more cost more than this set: it is compared as a whole, which misses nothing that they find.
        """
        p, small = prepared(best.q[rows], s.metric), prepared(self.v, s.metric).astype(np.float32, copy=False)
        if 2 * ef >= len(self.ids):
            for some, nodes in self._reached(p, small, s):
                for at in range(0, len(nodes), 2048):
                    part = nodes[at : at + 2048]
                    best.add(self.ids[part], self.v[part].astype(np.float64), rows[some])
            return
        for at in range(0, len(p), WALKERS):
            found, d = self._walk(p[at : at + WALKERS].astype(np.float32), small, s, max(ef, best.k), 0)
            i, j = np.nonzero(np.isfinite(d))
            who = found[i, j]
            exact = gap(p[at + i], prepared(self.v[who].astype(np.float64), s.metric), s.metric)
            exact = np.round(np.clip(exact, 0, 2) if s.metric == "cosine" else np.sqrt(exact), DIGITS)
            best.merge(rows[at + i], self.ids[who], exact)

    def _reached(self, q: np.ndarray, x: np.ndarray, s: Settings) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows of ``q``, nodes): the nodes that links of the lowest layer reach from these rows' entries."""
        label = parted(len(x), self.layers[0])
        if not label.any():  # one part, which all entries are in
            yield np.arange(len(q)), np.arange(len(x))
            return
        for at in range(0, len(q), WALKERS):
            own = np.sort(label[self._entries(q[at : at + WALKERS].astype(np.float32), x, s, 0)], axis=1)
            sets, of = np.unique(own, axis=0, return_inverse=True)
            for i, parts in enumerate(sets):
                yield at + np.flatnonzero(of.reshape(-1) == i), np.flatnonzero(np.isin(label, parts))

    def _walk(self, q: np.ndarray, x: np.ndarray, s: Settings, ef: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """(positions, distances) of a beam of ``ef`` at layer ``floor``, down from the top layer."""
        return _beam(q, x, self.layers[floor], self._entries(q, x, s, floor), ef, s.metric)

    def _entries(self, q: np.ndarray, x: np.ndarray, s: Settings, floor: int) -> np.ndarray:
        """Where each row of ``q`` enters layer ``floor``."""
        top = len(self.layers) - 1
        while top > floor and not len(self.nodes(top)):
            top -= 1
        if s.kind == "flat":
            starts = (np.abs(q).sum(axis=1) * 1e6).astype(np.int64)[:, None] % len(x)
        else:
            starts = np.tile(self.nodes(max(top, floor))[:8], (len(q), 1))
        for layer in range(top, floor, -1):
            found, d = _beam(q, x, self.layers[layer], starts, 4, s.metric)
            starts = np.where(np.isfinite(d), found, found[:, :1])
        return starts


def _beam(q: np.ndarray, x: np.ndarray, links: Links, starts: np.ndarray, ef: int, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """A beam of width ``ef`` for every row of ``q``: in each step the nearest EXPAND nodes of it that were not followed
    yet are, until there are none."""
    n = len(x)
    seen, first = np.zeros(len(q) * n, bool), np.zeros(len(q) * n, np.int32)
    who, dist, done = np.zeros((len(q), ef), np.int64), np.full((len(q), ef), np.inf, np.float32), np.ones((len(q), ef), bool)
    rows, to = np.repeat(np.arange(len(q)), starts.shape[1]), starts.reshape(-1)
    while True:
        key = rows * n + to
        fresh = np.flatnonzero(~seen[key])
        key = key[fresh]
        first[key] = fresh
        fresh = fresh[first[key] == fresh]  # a node that two expanded ones share, once
        rows, to = rows[fresh], to[fresh]
        seen[rows * n + to] = True
        d = gap(q[rows], x[to], metric)
        near = d < dist[rows, -1]
        rows, to, d = rows[near], to[near], d[near]
        if len(rows):
            count = np.bincount(rows, minlength=len(q))
            some = np.flatnonzero(count)
            place = np.arange(len(rows)) - np.searchsorted(rows, rows)
            wide = int(count.max())
            w = np.concatenate((who[some], np.zeros((len(some), wide), np.int64)), axis=1)
            e = np.concatenate((dist[some], np.full((len(some), wide), np.inf, np.float32)), axis=1)
            f = np.concatenate((done[some], np.zeros((len(some), wide), bool)), axis=1)
            at = np.searchsorted(some, rows)
            w[at, ef + place], e[at, ef + place] = to, d
            order = np.argsort(e, axis=1, kind="stable")[:, :ef]
            who[some], dist[some], done[some] = (np.take_along_axis(c, order, 1) for c in (w, e, f))
            done |= ~np.isfinite(dist)
        rank = np.cumsum(~done, axis=1)
        r, c = np.nonzero(~done & (rank <= EXPAND))
        if not len(r):
            return who, dist
        done[r, c] = True
        i, to = links.around(who[r, c])
        rows = r[i]


STORED = "cell int, code int, salt int, n int, dim int, ids binary, vectors binary, levels binary, layers array<struct<off: binary, dst: binary>>"
_KEY = ["cell", "code", "salt"]
_SCHEMA = pa.schema([("cell", pa.int32()), ("code", pa.int32()), ("salt", pa.int32()), ("n", pa.int32()), ("dim", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary()), ("levels", pa.binary()), ("layers", pa.list_(pa.struct([("off", pa.binary()), ("dst", pa.binary())])))])


def _pack(key: tuple[int, int, int], p: Piece, single: bool) -> pa.RecordBatch:
    v = p.v.astype(np.float32)
    v = v if single or (v == p.v).all() else p.v.astype(np.float64)
    layers = [{"off": x.off.tobytes(), "dst": x.dst.tobytes()} for x in p.layers]
    row = [*key, len(p.ids), v.shape[1], p.ids.astype(np.int64).tobytes(), v.tobytes(), p.level.astype(np.int8).tobytes(), layers]
    return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _SCHEMA, strict=True)], schema=_SCHEMA)


def _unpack(batch: pa.RecordBatch, i: int) -> Piece:
    def array(column: str, kind) -> np.ndarray:
        return np.frombuffer(batch.column(column)[i].as_buffer(), kind)

    ids = array("ids", np.int64)
    layers = [Links(np.frombuffer(x["off"].as_buffer(), np.int32), np.frombuffer(x["dst"].as_buffer(), np.int32)) for x in batch.column("layers")[i].values]
    level = array("levels", np.int8)
    raw = batch.column("vectors")[i].as_buffer()
    dim = batch.column("dim")[i].as_py()
    v = np.frombuffer(raw, np.float32 if raw.size == 4 * dim * len(ids) else np.float64)
    return Piece(ids, v.reshape(len(ids), dim), level, layers)


@dataclass
class Index:
    """``pieces`` as STORED; ``centres`` of the cells; ``bits`` cut each cell, ``salts`` deal what stays too large."""

    pieces: DataFrame
    centres: np.ndarray
    bits: np.ndarray
    salts: np.ndarray
    settings: Settings

    def count(self) -> int:
        return self.pieces.agg(F.sum("n")).first()[0] or 0

    def nodes(self) -> DataFrame:
        """(vec_id, level, v)."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    p = _unpack(batch, i)
                    v = pa.ListArray.from_arrays(pa.array(np.arange(len(p.ids) + 1, dtype=np.int32) * p.v.shape[1]), pa.array(p.v.reshape(-1).astype(np.float64)))
                    yield pa.RecordBatch.from_arrays([pa.array(p.ids), pa.array(p.level.astype(np.int32)), v], names=["vec_id", "level", "v"])

        return self.pieces.mapInArrow(run, "vec_id long, level int, v array<double>")

    def edges(self) -> DataFrame:
        """(layer, src, dst, dist), each link from both its ends."""
        metric = self.settings.metric

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    p = _unpack(batch, i)
                    x = prepared(p.v.astype(np.float64), metric)
                    for k, links in enumerate(p.layers):
                        a, b = links.pairs()
                        d = gaps(x, a, b, metric)
                        d = np.round(np.clip(d, 0, 2) if metric == "cosine" else np.sqrt(d), DIGITS)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), k, np.int32)), pa.array(p.ids[a]), pa.array(p.ids[b]), pa.array(d)], names=["layer", "src", "dst", "dist"])

        return self.pieces.mapInArrow(run, "layer int, src long, dst long, dist double")


def _placed(corpus: DataFrame, cells: np.ndarray, s: Settings) -> DataFrame:
    """(vec_id, v, level, cell, side): the nearest cell, and on which sides of planes through its centre a vector lies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes, powers = np.random.default_rng(s.seed).normal(size=(PLANES, cells.shape[1])), 1 << np.arange(PLANES)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                v = matrix(part.column(1))
                near = np.argmin(distances(v, cells, s.metric), axis=1) if len(cells) > 1 else np.zeros(len(v), int)
                side = ((v - cells[near]) @ planes.T > 0) @ powers
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(near.astype(np.int32)), pa.array(side.astype(np.int32))], names=["vec_id", "v", "level", "cell", "side"])

    u = (digest_number(F.col("vec_id"), str(s.seed)) + 1) / float(1 << 32)
    level = F.floor(-F.ln(u) / math.log(s.m)).cast("int") if s.kind == "layered" else F.lit(0)
    rows = corpus.where("v is not null and vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "v", level.alias("level"))
    return rows.mapInArrow(run, "vec_id long, v array<double>, level int, cell int, side int")


def _keyed(placed: DataFrame, bits: np.ndarray, salts: np.ndarray) -> DataFrame:
    """With ``code`` and ``salt``, by the cell's entries of two small arrays."""
    spark = placed.sparkSession
    cells = spark.createDataFrame([(i, int((1 << b) - 1), int(n)) for i, (b, n) in enumerate(zip(bits, salts, strict=True))], "cell int, mask int, salts int")
    dealt = placed.join(F.broadcast(cells), "cell")  # at most MOST_CELLS rows
    return dealt.select("cell", F.col("side").bitwiseAND(F.col("mask")).alias("code"), F.pmod(F.xxhash64("vec_id"), F.col("salts")).cast("int").alias("salt"), "vec_id", "v", "level")


def _pieces(rows: DataFrame, s: Settings, tasks: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in runs(batches, _KEY):
            key = tuple(part.column(c)[0].as_py() for c in _KEY)
            yield _pack(key, Piece(part.column("vec_id").to_numpy(), matrix(part.column("v").combine_chunks()), part.column("level").to_numpy().astype(np.int8)).build(s), s.single)

    return rows.repartition(tasks, *_KEY).sortWithinPartitions(*_KEY, "vec_id").mapInArrow(run, STORED)


def _tasks(spark: SparkSession, n: int, most: int) -> int:
    """As many tasks as pieces of ``n`` vectors there may be, so that a task has few of them however many there are."""
    return max(spark.sparkContext.defaultParallelism, -(-2 * n // most))


def build(corpus: DataFrame, settings: Settings | None = None, piece_rows: int | None = None) -> Index:
    """An index of ``corpus`` (vec_id, v); rows without an id or a vector are left out."""
    s, most = settings or Settings(), piece_rows or PIECE_ROWS
    good = corpus.where("v is not null and vec_id is not null")
    n = good.count()
    spark = corpus.sparkSession
    if not n:
        return Index(spark.createDataFrame([], STORED), np.zeros((1, 1)), np.zeros(1, int), np.ones(1, int), s)
    cells = centres(good, max(1, min(MOST_CELLS, -(-n // most))), seed=s.seed)
    placed = checkpoint(_placed(good, cells, s))
    sizes = {r["cell"]: r["n"] for r in placed.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # one a cell
    bits = np.array([min(PLANES, max(0, math.ceil(math.log2(max(1, sizes.get(i, 0)) / most)))) for i in range(len(cells))])
    codes = _keyed(placed, bits, np.ones(len(cells), int)).groupBy("cell", "code").agg(F.count("*").alias("n")).groupBy("cell").agg(F.max("n").alias("n"))
    largest = {r["cell"]: r["n"] for r in codes.collect()}
    salts = np.array([max(1, -(-largest.get(i, 0) // (2 * most))) for i in range(len(cells))])
    return Index(checkpoint(_pieces(_keyed(placed, bits, salts), s, _tasks(spark, n, most))), cells, bits, salts, s)


def insert(index: Index, more: DataFrame, piece_rows: int | None = None) -> Index:
    """``index`` with the rows of ``more`` (vec_id, v), whose ids must be new. Only pieces that get vectors are written
    anew. Where a piece gets more than ``piece_rows``, they become pieces of their own."""
    s, most = index.settings, piece_rows or PIECE_ROWS
    if index.pieces.isEmpty():
        return build(more, s, piece_rows)
    rows = checkpoint(_keyed(_placed(more, index.centres, s), index.bits, index.salts))
    taken = index.pieces.groupBy("cell", "code").agg(F.max("salt").alias("last"))
    crowds = rows.groupBy(*_KEY).agg(F.count("*").alias("n")).where(F.col("n") > most).withColumn("parts", F.ceil(F.col("n") / most).cast("int")).drop("n")
    crowds = checkpoint(crowds.join(taken, ["cell", "code"], "left").withColumn("last", F.coalesce("last", F.lit(0))))
    placed = rows.join(F.broadcast(crowds) if crowds.limit(100_001).count() <= 100_000 else crowds, _KEY, "left")
    own = F.col("last") + 1 + F.col("salt") * F.col("parts") + F.pmod(F.xxhash64("vec_id", "v"), F.col("parts")).cast("int")
    placed = placed.select("cell", "code", F.coalesce(own, F.col("salt")).alias("salt"), "vec_id", "v", "level")
    keys = checkpoint(placed.select(*_KEY).distinct())
    touched = index.pieces.join(keys, _KEY, "left_semi")
    both = touched.select(*_KEY, F.lit(None).cast("long").alias("vec_id"), F.lit(None).cast("array<double>").alias("v"), F.lit(None).cast("int").alias("level"), "dim", "ids", "vectors", "levels", "layers")
    both = both.unionByName(placed, allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in runs(batches, _KEY):
            key = tuple(part.column(c)[0].as_py() for c in _KEY)
            stored = part.column("vec_id").is_null().to_numpy()
            new = part.slice(int(stored.sum())).combine_chunks()
            had = _unpack(part.slice(0, 1).combine_chunks().to_batches()[0], 0) if stored.any() else Piece(np.empty(0, np.int64), np.empty((0, 0)), np.empty(0, np.int8))
            yield _pack(key, had.insert(new.column("vec_id").to_numpy(), matrix(new.column("v").combine_chunks()), new.column("level").to_numpy().astype(np.int8), s), s.single)

    order = [F.col(c) for c in _KEY] + [F.col("vec_id").asc_nulls_first()]
    made = both.repartition(_tasks(index.pieces.sparkSession, index.count(), most), *_KEY).sortWithinPartitions(*order).mapInArrow(run, STORED)
    rest = index.pieces.join(keys, _KEY, "left_anti")
    return replace(index, pieces=checkpoint(rest.unionByName(made)))


def search(index: Index, queries: DataFrame, k: int, ef: int = 64, probes: int | None = None) -> DataFrame:
    """(qid, rank, vec_id, dist): for each query (qid, v) the best ``k`` that beams of width ``ef`` find in the pieces of
    its ``probes`` nearest cells (all, if None). Ties go by id."""
    if k < 1:
        raise ValueError("k must be at least 1")
    s = index.settings
    queries = queries.where("qid is not null and v is not null").select(F.col("qid").cast("long").alias("qid"), "v")
    passes = max(1, -(-queries.count() // QUERY_BLOCK))
    out = None
    for p in range(passes):
        part = queries if passes == 1 else queries.where(F.pmod(F.xxhash64("qid"), F.lit(passes)) == p)
        block = part.toArrow()
        qid, q = block.column("qid").to_numpy(), matrix(block.column("v").combine_chunks())
        near = None
        pieces = index.pieces
        if len(qid) and probes is not None and probes < len(index.centres):
            near = np.argsort(distances(q, index.centres, s.metric), axis=1, kind="stable")[:, :probes]
            asked = np.unique(near).tolist()
            pieces = pieces.where(F.col("cell").isin(asked)) if len(asked) < len(index.centres) else pieces
        found = _searched(pieces, index.pieces.sparkSession.sparkContext.broadcast((qid, q, near)), k, ef, s)
        if passes > 1:
            found = checkpoint(found)
        out = found if out is None else out.unionByName(found)
    w = W.partitionBy("qid").orderBy("dist", "vec_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("qid", "rank", "vec_id", "dist")


def _searched(pieces: DataFrame, shared, k: int, ef: int, s: Settings) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, q, near = shared.value
        best = Best(q, k, s.metric)
        for batch in batches:
            for i in range(batch.num_rows if len(qid) else 0):
                mine = np.arange(len(qid)) if near is None else np.flatnonzero((near == batch.column("cell")[i].as_py()).any(axis=1))
                if len(mine):
                    _unpack(batch, i).search(best, mine, ef, s)
        if best.who.size:  # the best of all pieces of the task
            yield pa.RecordBatch.from_arrays([pa.array(qid[best.who]), pa.array(best.ids), pa.array(best.dist)], names=["qid", "vec_id", "dist"])

    return pieces.select("cell", "dim", "ids", "vectors", "levels", "layers").mapInArrow(run, "qid long, vec_id long, dist double")


def recall_sweep(index: Index, queries: DataFrame, corpus: DataFrame, k: int, widths: tuple[int, ...]) -> DataFrame:
    """(ef, n_queries, mean_recall) against exact search."""
    truth = checkpoint(knn(queries, corpus, k, index.settings.metric))
    out = None
    for ef in widths:
        told = recall(truth, search(index, queries, k, ef), k).agg(F.count("*").alias("n_queries"), F.round(F.avg("recall"), 6).alias("mean_recall"))
        rows = told.select(F.lit(ef).alias("ef"), "n_queries", "mean_recall")
        out = rows if out is None else out.unionByName(rows)
    return out


def timed_sweep(index: Index, queries: DataFrame, corpus: DataFrame, k: int, widths: tuple[int, ...], rounds: int = 3) -> list[dict]:
    """For each width ``ef, mean_recall, query_ms, exact_ms, speedup``: wall-clock milliseconds a query of whole
    batches, the least of ``rounds``."""

    def timed(make: Callable[[], DataFrame]) -> float:
        took = []
        for _ in range(rounds):
            start = time.perf_counter()
            make().write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - start)
        return min(took) * 1000

    queries = checkpoint(queries)
    n = max(1, queries.count())
    exact = timed(lambda: knn(queries, corpus, k, index.settings.metric))
    told = {r["ef"]: r["mean_recall"] for r in recall_sweep(index, queries, corpus, k, widths).collect()}
    rows = [(ef, timed(lambda ef=ef: search(index, queries, k, ef))) for ef in widths]
    return [{"ef": ef, "mean_recall": told[ef], "query_ms": round(ms / n, 3), "exact_ms": round(exact / n, 3), "speedup": round(exact / ms, 3)} for ef, ms in rows]


def save(index: Index, path: str) -> None:
    """Pieces, cells and settings as tables under ``path``, which may not exist."""
    spark, s = index.pieces.sparkSession, index.settings
    n = index.pieces.count()
    tasks = spark.sparkContext.defaultParallelism
    index.pieces.repartition(-(-n // max(1, n // tasks))).write.parquet(f"{path}/pieces")  # evenly, for the searches to come
    cells = [(i, c.tolist(), int(b), int(n)) for i, (c, b, n) in enumerate(zip(index.centres, index.bits, index.salts, strict=True))]
    spark.createDataFrame(cells, "cell int, centre array<double>, bits int, salts int").coalesce(1).write.parquet(f"{path}/cells")
    spark.createDataFrame([(s.m, s.metric, s.kind, s.ef_construction, s.seed, s.single)], "m int, metric string, kind string, ef_construction int, seed int, single boolean").coalesce(1).write.json(f"{path}/settings")


def load(spark: SparkSession, path: str) -> Index:
    cells = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()
    row = spark.read.schema("m int, metric string, kind string, ef_construction int, seed int, single boolean").json(f"{path}/settings").first()
    return Index(spark.read.parquet(f"{path}/pieces"), np.array([r["centre"] for r in cells]), np.array([r["bits"] for r in cells]), np.array([r["salts"] for r in cells]), Settings(**row.asDict()))
