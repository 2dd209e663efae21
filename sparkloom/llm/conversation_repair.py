"""Repair of conversation structure: cheapest edits by the auction algorithm for shortest paths.

The nodes of a conversation's lattice are (rows consumed, what the output ends with); its arcs are edits with
integer costs. Every node has a price, at first 0, that never exceeds an arc's cost plus the price behind it. A
path starts at an origin: where its last node's price is below the best arc's, the price rises and the path
contracts, else it extends by that arc. Origins are taken from the last row back, and a path ends at a
destination, which the end and all nodes with a converged price are. Then prices are exact distances, the arcs
of cheapest repairs are the tight ones, and following the least letter through sets of nodes spells the least
of all cheapest edit strings. Such a string fixes the roles: the outputs alternate, and only an odd number
begins with a system turn.

Conversations of at most SEGMENT_ROWS rows are repaired in one go, several a task. Longer ones are sorted
by range and cut into segments: a segment's costs between its entries and exits are a small matrix, a chain of
those prices all borders, each segment then spells its edits for every set of entry nodes, and a second chain
picks the pieces that meet. Only the digest of a repaired conversation, which is sequential, is one stream.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import col
from sparkloom.llm.near_dedup import small
from sparkloom.operators.runs import runs
from sparkloom.shipping import checkpoint

SEGMENT_ROWS = 2048
SEGMENT_BYTES = 8 << 20

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: What the output ends with: nothing, a system, a user or an assistant turn.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
_NEXT = {("s", NOTHING): SYSTEM, ("u", NOTHING): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
ENDS = (NOTHING, ASSISTANT)
FAR = 1 << 60
_WORD = re.compile(r"[^\x20\x09-\x0D]")

Arc = tuple[int, str, int]


def _row_arcs(initial: str, must_go: bool, truncated: bool) -> tuple[tuple[Arc, ...], ...]:
    """(cost, letter, next state) of each state."""
    extra = TRUNCATED if truncated else 0
    out = []
    for state in STATES:
        arcs: list[Arc] = [(DELETE, "D", state)]
        if not must_go:
            arcs += [(KEEP + extra, "K", _NEXT[initial, state])] if (initial, state) in _NEXT else []
            arcs += [(REROLE + extra, "R", _NEXT[r, state]) for r in "ua" if (r, state) in _NEXT]
        out.append(tuple(arcs))
    return tuple(out)


#: By (initial or "", must go, truncated): a few kinds of rows only.
ROW_ARCS = {(i, g, t): _row_arcs(i, g, t) for i in ("s", "u", "a", "") for g in (False, True) for t in (False, True)}
INSERT_ARCS = tuple(tuple((INSERT, "I", _NEXT[r, state]) for r in "ua" if (r, state) in _NEXT) for state in STATES)


class Lattice:
    """Converged prices of the nodes before each of ``kinds`` rows and behind the last. ``exit`` gives the prices
    behind a segment that is not its conversation's last; without it, the output must end there."""

    def __init__(self, kinds: list[tuple[str, bool, bool]], exit: tuple[int, ...] | None = None) -> None:
        self.rows, self.last = [ROW_ARCS[k] for k in kinds], exit is None
        n = len(kinds)
        self.price = [[0, 0, 0, 0] for _ in range(n + 1)]
        # states from which no exit with a price can be reached are no nodes: with none behind a user or an
        # assistant turn, those; with none behind a system turn either, that
        states = STATES if exit is None or min(exit[USER:]) < FAR else [s for s in (NOTHING, SYSTEM) if min(exit[s : SYSTEM + 1]) < FAR]
        if exit is not None:
            self.price[n] = list(exit)
        for p in self.price[:n] if exit is not None else self.price:
            for s in STATES:
                if s not in states:
                    p[s] = FAR
        for i in range(n if exit is None else n - 1, -1, -1):
            self._auction(i, states)

    def arcs(self, i: int, state: int) -> Iterator[tuple[int, str, int, int]]:
        """(cost, letter, layer, state) of a node's arcs; the end is layer -1."""
        if i == len(self.rows):
            if not self.last:
                return
            if state in ENDS:
                yield 0, "", -1, 0
        else:
            for cost, letter, to in self.rows[i][state]:
                yield cost, letter, i + 1, to
        for cost, letter, to in INSERT_ARCS[state]:
            yield cost, letter, i, to

    def _auction(self, i: int, states) -> None:
        """Prices of layer ``i``; those of the layer behind it have converged."""
        price, done = self.price[i], [s not in states for s in STATES]
        onward = self.price[i + 1] if i < len(self.rows) else None
        for origin in states:
            path = [origin]
            while not done[path[-1]]:
                at = path[-1]
                best, to, ends = FAR, -1, False
                if onward is None:
                    if at in ENDS:
                        best, ends = 0, True
                else:
                    for cost, _, s in self.rows[i][at]:
                        if cost + onward[s] < best:
                            best, ends = cost + onward[s], True
                for cost, _, s in INSERT_ARCS[at]:
                    if cost + price[s] < best:
                        best, to, ends = cost + price[s], s, False
                if price[at] < best:
                    price[at] = best
                    if len(path) > 1:
                        path.pop()  # contraction
                elif ends:
                    break  # extension to a destination
                else:
                    path.append(to)
            for s in path:
                done[s] = True

    def trace(self, entries: set[int]) -> tuple[str, set[int]]:
        """The least letters along tight arcs from any of ``entries``, and the nodes at which they end."""
        at, i, out = entries, 0, []
        while self.last or i < len(self.rows):
            tight = [(letter, j, to) for s in at if self.price[i][s] < FAR for cost, letter, j, to in self.arcs(i, s) if self.price[i][s] == cost + (self.price[j][to] if j >= 0 else 0)]
            letter = min(t[0] for t in tight)
            if not letter:
                return "".join(out), set()
            out.append(letter)
            (i,) = {j for x, j, _ in tight if x == letter}
            at = {to for x, _, to in tight if x == letter}
        return "".join(out), at


@dataclass
class Seen:
    """Counts of consecutive rows, which add up over segments."""

    rows: int = 0
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    turns: int = 0
    first_turn: int | None = None
    last_turn: int | None = None
    first: str = ""
    last: str = ""

    def add(self, other: Seen) -> Seen:
        if not self.rows:
            return other
        both = self.last_turn is not None and self.last_turn == other.first_turn
        return Seen(
            self.rows + other.rows,
            self.blank + other.blank,
            self.duplicate + other.duplicate,
            self.truncated + other.truncated,
            self.illegal + other.illegal + (self.last + other.first not in ("su", "ua", "au")),
            self.turns + other.turns - both,
            self.first_turn if self.first_turn is not None else other.first_turn,
            other.last_turn if other.last_turn is not None else self.last_turn,
            self.first,
            other.last,
        )

    @property
    def gaps(self) -> int:
        return self.last_turn - self.first_turn + 1 - self.turns if self.turns else 0


@dataclass
class Rows:
    """Rows of one conversation in order, judged as they come."""

    seen: Seen = field(default_factory=Seen)
    kinds: list[tuple[str, bool, bool]] = field(default_factory=list)
    roles: list[str] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)

    def put(self, turn: int | None, role: str, text: str, repeated: bool) -> None:
        words = _WORD.search(text)
        blank, duplicate = not words, bool(words) and repeated
        truncated = not blank and not duplicate and text.rstrip("\x20\x09\x0a\x0b\x0c\x0d")[-1] not in ".!?"
        self.seen = self.seen.add(Seen(1, int(blank), int(duplicate), int(truncated), 0, int(turn is not None), turn, turn, role[:1], role[:1]))
        self.kinds.append((role[:1] if role[:1] in ("s", "u", "a") else "", blank or duplicate, truncated))
        self.roles.append(role)
        self.texts.append(text)

    def rendered(self, audit: str, place: int, system: bool) -> Iterator[str]:
        """role:text of what ``audit`` leaves; ``place`` outputs come before, and the first is a system turn or not."""
        k = 0
        for letter in audit:
            role = ("user", "assistant")[(place - system) % 2]
            if letter == "I":
                yield f"{role}:"
            else:
                if letter == "K":
                    yield f"{self.roles[k]}:{self.texts[k]}"
                elif letter == "R":
                    yield f"{role}:{self.texts[k]}"
                k += 1
            place += letter != "D"


def outputs(audit: str) -> int:
    return len(audit) - audit.count("D")


def damaged(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text) after the contract's damage, drawn by crc32 of ``conv_id:turn`` modulo 20."""
    raw = conversations.select(*(col(conversations, c).cast(t).alias(a) for c, t, a in ((conv_col, "long", "conv_id"), (turn_col, "long", "turn"), (role_col, "string", "role"), (text_col, "string", "text"))))

    def space(c: Column) -> Column:
        return F.coalesce(c.cast("string"), F.lit(" "))

    k = F.crc32(F.concat(space(F.col("conv_id")), F.lit(":"), space(F.col("turn"))).cast("binary")) % 20
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = raw.select("conv_id", "turn", space(F.col("role")).alias("role"), space(F.col("text")).alias("text"), k.alias("k")).where("k <> 0")
    rows = rows.select("conv_id", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("k") == 3, 2).otherwise(1).alias("times"))
    return rows.withColumn("times", F.explode(F.sequence(F.lit(1), "times"))).drop("times")


RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repaired(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``rows`` (conv_id, turn, role, text) without nulls in role and text: faults, cheapest
    edits and the digest of the repaired ``role:text`` lines. Rows go by turn (nulls first), then role and text."""
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("n"))
    long = checkpoint(sizes.where(F.col("n") > SEGMENT_ROWS).select(F.col("conv_id").alias("long_id")))
    if long.isEmpty():
        return _short(rows)
    long = small(long)
    same = F.col("conv_id").eqNullSafe(F.col("long_id"))
    return _short(rows.join(long, same, "left_anti")).unionByName(_long(rows.join(long, same, "left_semi")))


def _short(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for part in runs(batches, ["conv_id"]):
            conv, turns, roles, texts = (c.to_pylist() for c in part.columns)
            have, known = Rows(), set()
            for turn, role, text in zip(turns, roles, texts, strict=True):
                have.put(turn, role, text, (role, text) in known)
                known.add((role, text))
            lattice = Lattice(have.kinds)
            audit, _ = lattice.trace({NOTHING})
            n = outputs(audit)
            digest = hashlib.sha256("\n".join(have.rendered(audit, 0, n % 2 == 1)).encode("utf-8", "replace")).hexdigest()
            s = have.seen
            out.append((conv[0], s.gaps, s.blank, s.duplicate, s.truncated, s.illegal, lattice.price[0][NOTHING], audit, digest))
            if len(out) == 1000:
                yield _batch(out, _RESULT)
                out = []
        if out:
            yield _batch(out, _RESULT)

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, RESULT)


_RESULT = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


_SEEN = [*((c, pa.int64()) for c in ("rows", "blank", "duplicate", "truncated", "illegal", "turns", "first_turn", "last_turn")), ("first", pa.string()), ("last", pa.string())]
_SEGMENT = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("seq", pa.int64()), *_SEEN, ("kinds", pa.list_(pa.int32())), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("within", pa.list_(pa.int64())), ("closing", pa.list_(pa.int64()))])
_KINDS = list(ROW_ARCS)


def _spark(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.list_(pa.int64()): "array<long>", pa.list_(pa.int32()): "array<int>", pa.list_(pa.string()): "array<string>", pa.bool_(): "boolean"}
    return ", ".join(f"`{f.name}` {names[f.type]}" for f in schema)


def _segments(rows: DataFrame) -> DataFrame:
    """Segments of long conversations in order of (part, seq). A row's first equal in role and text is found by a
    join, as it may be in another segment; equal rows of one turn are one row with a number."""
    each = checkpoint(rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("times")).withColumn("same", F.sha2("text", 256)))
    turns = each.groupBy("conv_id", "role", "same").agg(F.count("*").alias("n"), F.min("turn").alias("since"), F.max(F.col("turn").isNull()).alias("none")).where("n > 1")
    often = small(checkpoint(turns.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("same").alias("s"), "since", "none")))
    on = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("same") == F.col("s"))
    first = F.col("s").isNull() | F.when(F.col("none"), F.col("turn").isNull()).otherwise(F.col("turn") == F.col("since"))
    judged = each.join(often, on, "left").select("conv_id", "turn", "role", "text", "times", (~first).alias("repeated"), F.substring("text", 1, 64).alias("head"))
    by = ["conv_id", "turn", "role", "head"]
    ordered = checkpoint(judged).repartitionByRange(*by).sortWithinPartitions(*by, "text").drop("head")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0

        def made(conv: int | None, have: Rows) -> pa.RecordBatch:
            nonlocal seq
            seq += 1
            columns = [tuple(FAR if s != e else 0 for s in STATES) for e in STATES]
            towards = [Lattice(have.kinds, c).price[0] for c in columns]
            within = [min(towards[e][s], FAR) for s in STATES for e in STATES]
            s = have.seen
            kinds = [_KINDS.index(k) for k in have.kinds]
            return _batch([(conv, part, seq, *(getattr(s, c) for c, _ in _SEEN), kinds, have.roles, have.texts, within, Lattice(have.kinds).price[0])], _SEGMENT)

        have, conv, size = Rows(), None, 0
        for batch in batches:
            for c, turn, role, text, times, repeated in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                for k in range(times):
                    if have.kinds and (c != conv or len(have.kinds) >= SEGMENT_ROWS or size >= SEGMENT_BYTES):
                        yield made(conv, have)
                        have, size = Rows(), 0
                    have.put(turn, role, text, repeated or k > 0)
                    conv, size = c, size + len(role) + len(text)
        if have.kinds:
            yield made(conv, have)

    return checkpoint(ordered.mapInArrow(run, _spark(_SEGMENT)))


_ORDER = ["conv_id", "part", "seq"]
_PRICED = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("seq", pa.int64()), ("exit", pa.list_(pa.int64()))])
_SPELT = pa.schema([*_PRICED, ("leads", pa.list_(pa.int32())), ("outs", pa.list_(pa.int64()))])
_PICKED = pa.schema([*_PRICED, ("entries", pa.int32()), ("place", pa.int64()), ("system", pa.bool_())])
_DRAWN = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("seq", pa.int64()), *_SEEN, ("cost", pa.int64()), ("audit", pa.string()), ("lines", pa.string())])


def _long(rows: DataFrame) -> DataFrame:
    segments = _segments(rows)

    def chained(df: DataFrame, run, schema: pa.Schema) -> DataFrame:
        """``run`` over the rows of whole conversations, a small row a segment."""

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in runs(batches, ["conv_id"]):
                yield _batch(run(part.to_pylist()), schema)

        return checkpoint(df.repartition("conv_id").sortWithinPartitions(*_ORDER).mapInArrow(each, _spark(schema)))

    def prices(parts: list[dict]) -> list[tuple]:
        out, behind = [], None
        for p in reversed(parts):
            out.append((p["conv_id"], p["part"], p["seq"], behind))
            if behind is None:
                behind = p["closing"]
            else:
                behind = [min(p["within"][4 * s + e] + behind[e] for e in STATES) for s in STATES]
        return out

    priced = chained(segments.select(*_ORDER, "within", "closing"), prices, _PRICED)

    def at(df: DataFrame) -> DataFrame:
        other = small(df)
        names = {c: f"o_{c}" for c in _ORDER}
        for a, b in names.items():
            other = other.withColumnRenamed(a, b)
        on = F.col("conv_id").eqNullSafe(F.col("o_conv_id")) & (F.col("part") == F.col("o_part")) & (F.col("seq") == F.col("o_seq"))
        return segments.join(other, on).drop(*names.values())

    def lattice(p: dict) -> Lattice:
        return Lattice([_KINDS[k] for k in p["kinds"]], tuple(p["exit"]) if p["exit"] else None)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.to_pylist():
                made = lattice(p)
                found = [made.trace({s for s in STATES if mask >> s & 1}) for mask in range(1, 16)]
                yield _batch([(p["conv_id"], p["part"], p["seq"], p["exit"], [sum(1 << s for s in ends) for _, ends in found], [outputs(a) for a, _ in found])], _SPELT)

    spelt = checkpoint(at(priced).select(*_ORDER, "kinds", "exit").mapInArrow(spell, _spark(_SPELT)))

    def picks(parts: list[dict]) -> list[tuple]:
        mask, place, out = 1 << NOTHING, 0, []
        for p in parts:
            out.append([p["conv_id"], p["part"], p["seq"], p["exit"], mask, place])
            place, mask = place + p["outs"][mask - 1], p["leads"][mask - 1]
        return [(*o, place % 2 == 1) for o in out]

    picked = chained(spelt, picks, _PICKED)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.to_pylist():
                made = lattice(p)
                audit, _ = made.trace({s for s in STATES if p["entries"] >> s & 1})
                lines = Rows(roles=p["roles"], texts=p["texts"]).rendered(audit, p["place"], p["system"])
                text = "\n".join(lines) if outputs(audit) else None
                yield _batch([(p["conv_id"], p["part"], p["seq"], *(p[c] for c, _ in _SEEN), made.price[0][NOTHING], audit, text)], _DRAWN)

    drawn = at(picked).drop("within", "closing").mapInArrow(draw, _spark(_DRAWN))

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A stream of segments: digests and counts are carried, texts are not."""
        state = None

        def result() -> pa.RecordBatch:
            s = state["seen"]
            return _batch([(state["conv"], s.gaps, s.blank, s.duplicate, s.truncated, s.illegal, state["cost"], "".join(state["audit"]), state["hash"].hexdigest())], _RESULT)

        for batch in batches:
            for k in range(batch.num_rows):
                p = batch.slice(k, 1).to_pylist()[0]
                if state is None or state["conv"] != p["conv_id"]:
                    if state is not None:
                        yield result()
                    state = {"conv": p["conv_id"], "seen": Seen(), "cost": p["cost"], "audit": [], "hash": hashlib.sha256(), "some": False}
                state["seen"] = state["seen"].add(Seen(*(p[c] for c, _ in _SEEN)))
                state["audit"].append(p["audit"])
                if p["lines"] is not None:
                    state["hash"].update((("\n" if state["some"] else "") + p["lines"]).encode("utf-8", "replace"))
                    state["some"] = True
        if state is not None:
            yield result()

    return drawn.repartition("conv_id").sortWithinPartitions(*_ORDER).mapInArrow(close, RESULT)


def repair(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Damage, then one row per original conv_id: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256``.

    Nulls in a damage key, a role or a text count as one space; a null turn sorts first and is in no gap; a null conv_id is
    a conversation of its own. Rows of one turn go by role, then text (bytes). A conversation without rows after damage
    has zeros, an empty audit and the digest of the empty string. Repeated rows are rows. No rows give none.
    """
    ids = conversations.select(col(conversations, conv_col).cast("long").alias("conv_id")).distinct()
    found = repaired(damaged(conversations, conv_col, turn_col, role_col, text_col)).withColumnRenamed("conv_id", "found_id")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    empty = hashlib.sha256(b"").hexdigest()
    return ids.join(found, F.col("conv_id").eqNullSafe(F.col("found_id")), "left").select(
        "conv_id",
        *(F.coalesce(c, F.lit(0)).alias(c) for c in counts),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"),
    )
