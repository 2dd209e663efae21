"""Repairs against a plain backward recursion over all edits, and damage against plain Python."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest

from sparkloom.llm import conversation_repair as cr

TURNS = "conv_id long, turn long, role string, text string"
NEXT = {("s", "^"): "s", ("u", "^"): "u", ("u", "s"): "u", ("u", "a"): "u", ("a", "u"): "a"}


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def plain_repair(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, digest) of one conversation's rows."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    turns = {r[1] for r in rows} - {None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    faults, seen = [], set()
    for _, _, role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]", "", text)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    worst = (10**9, "~", ())
    behind = {s: ((0, "", ()) if s in "^a" else worst) for s in "^sua"}

    def inserts(best):
        for _ in range(6):  # as often as it could ever help
            for s in "^sua":
                for r in "ua":
                    if (r, s) in NEXT:
                        c, audit, lines = best[NEXT[r, s]]
                        best[s] = min(best[s], (c + 5, "I" + audit, ({"u": "user", "a": "assistant"}[r] + ":", *lines)))
        return best

    behind = inserts(behind)
    for (_, _, role, text), fault in reversed(list(zip(rows, faults, strict=True))):
        now = {}
        for s in "^sua":
            c, audit, lines = behind[s]
            found = [(c + 2, "D" + audit, lines)]
            if fault not in ("blank", "duplicate"):
                extra = 5 if fault == "truncated" else 0
                if (role[:1], s) in NEXT:
                    c, audit, lines = behind[NEXT[role[:1], s]]
                    found.append((c + extra, "K" + audit, (f"{role}:{text}", *lines)))
                for r, name in (("u", "user"), ("a", "assistant")):
                    if (r, s) in NEXT:
                        c, audit, lines = behind[NEXT[r, s]]
                        found.append((c + 1 + extra, "R" + audit, (f"{name}:{text}", *lines)))
            now[s] = min(found)
        behind = inserts(now)
    cost, audit, lines = behind["^"]
    return gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def plain(rows):
    left = plain_damage(rows)
    return sorted(((c, *plain_repair([r for r in left if r[0] == c])) for c in {r[0] for r in rows}), key=lambda r: (r[0] is None, r[0] or 0))


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0] is None, r[0] or 0))


def random_rows(rng, convs, most):
    rows = []
    for c in convs:
        for t in range(rng.integers(1, most)):
            text = str(rng.choice(["Yes.", "No!", "cut off", "", " \t", "Why?  ", "ok.", "é", f"{t}."]))
            rows.append((c, t if rng.random() < 0.9 else None, str(rng.choice(["system", "user", "assistant", "tool", "user", "assistant"])), text))
    return rows


def test_equals_plain_recursion(spark):
    rows = random_rows(np.random.default_rng(1), range(300), 10)
    rows += [(None, 1, "user", "Hi."), (None, None, None, None), (900, None, "user", None), (901, 5, None, "Hi."), (902, 1, "", "x."), (903, 2**40, "user", "a. " * 50_000), (903, 2**40 + 1, "assistant", "ok.")]
    rows += rows[:30]  # repeated rows
    df = spark.createDataFrame(rows, TURNS)
    got = found(cr.repair(df.selectExpr("*", "1 as n", "2 as k", "'x' as audit", "3 as cost", "4 as found_id")))
    assert got == plain(rows)
    assert cr.repair(df.where("false")).count() == 0


def test_a_conversation_that_loses_all_rows(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert found(cr.repair(spark.createDataFrame([(gone, 0, "user", "Hi.")], TURNS))) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


@pytest.mark.parametrize("rows_a_segment", [1, 3, 16])
def test_segments_of_long_conversations_change_nothing(spark, monkeypatch, rows_a_segment):
    rng = np.random.default_rng(rows_a_segment)
    rows = random_rows(rng, [1, 2, None], 90) + random_rows(rng, range(10, 30), 5) + [(1, 3, "user", "Yes.")] * 25
    df = spark.createDataFrame(rows, TURNS).repartition(3)
    monkeypatch.setattr(cr, "SEGMENT_ROWS", rows_a_segment)
    assert found(cr.repair(df)) == plain(rows)


def test_prices_are_feasible_exact_and_tight():
    """An arc's cost plus the price behind it is never below a node's price, and some arc is tight."""
    rng = np.random.default_rng(2)
    kinds = list(cr.ROW_ARCS)
    for n in (0, 1, 7, 40):
        made = cr.Lattice([kinds[k] for k in rng.integers(0, len(kinds), n)])
        for i in range(n + 1):
            for s in cr.STATES:
                slack = [cost + (made.price[j][to] if j >= 0 else 0) - made.price[i][s] for cost, _, j, to in made.arcs(i, s)]
                assert min(slack) == 0


def test_whole_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    assert found(cr.repair(df)) == plain([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
