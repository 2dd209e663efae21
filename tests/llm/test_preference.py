import pytest

from sparkloom.llm import preference as P
from sparkloom.llm.queries import op6_preference_pairs

TURNS = "conv_id long, turn long, role string, text string"


def one(role, text):
    return f"<|im_start|>{role or ''}\n{text or ''}<|im_end|>\n"


def brute(chosen, rejected):
    k = 0
    while k < min(len(chosen), len(rejected)) and chosen[k] == rejected[k]:
        k += 1

    def completion(turns):
        at, text, spans = 0, "", []
        for role, t in turns:
            text += one(role, t)
            if role == "assistant":
                spans.append((at + len(one(role, "")) - len("<|im_end|>\n"), at + len(one(role, t)) - 1))
            at = len(text)
        return text, spans

    return "".join(one(*t) for t in chosen[:k]), *completion(chosen[k:]), *completion(rejected[k:]), k


def worse(turns):
    at = [i for i, t in enumerate(turns) if t[0] == "assistant"]
    if not at:
        return turns[:-1]
    text = turns[at[-2]][1] if len(at) > 1 else ""
    return [*turns[: at[-1]], ("assistant", text), *turns[at[-1] + 1 :]]


def told(r):
    return r["prompt"], r["chosen"], [tuple(s) for s in r["chosen_spans"]], r["rejected"], [tuple(s) for s in r["rejected_spans"]], r["prompt_turns"]


@pytest.fixture(scope="module")
def convs():
    return {
        1: [("user", "hi"), ("assistant", "a"), ("user", "more"), ("assistant", "b")],
        2: [("user", "hi"), ("assistant", "a"), ("user", "less"), ("assistant", "c")],
        3: [("user", "hi"), ("assistant", "a"), ("user", "more"), ("assistant", "b")],
        4: [("user", "hi")],
        5: [("system", None), ("user", "éü😀"), ("assistant", "x" * 100_000)],
        6: [("user", "hello")],
        7: [(None, None), ("assistant", "")],
    }


def test_pairs_against_plain_python(spark, convs):
    rows = [(c, t, *turn) for c, turns in convs.items() for t, turn in enumerate(turns)]
    got = {r["conv_id"]: r for r in P.preference_pairs(spark.createDataFrame(rows[::-1], TURNS)).collect()}
    partner = {2: 1, 3: 1, 4: 1}
    assert set(got) == set(convs)
    for c, turns in convs.items():
        assert got[c]["rejected_id"] == partner.get(c)
        assert told(got[c]) == brute(turns, convs[partner[c]] if c in partner else worse(turns)), c
    assert got[3]["identical"] and not got[2]["identical"]


def test_null_ids_repeated_rows_and_order(spark):
    rows = [(None, 0, "user", "a"), (None, 1, "assistant", "b"), (1, 1, "assistant", "z"), (1, None, "user", "first"), (1, 1, "assistant", "z")]
    got = P.preference_pairs(spark.createDataFrame(rows, TURNS)).collect()
    assert sorted((r["conv_id"] or 0) for r in got) == [0, 0, 1]
    r = next(r for r in got if r["conv_id"] == 1)
    assert told(r) == brute([("user", "first"), ("assistant", "z"), ("assistant", "z")], [("user", "first"), ("assistant", "z"), ("assistant", "z")])
    assert P.preference_pairs(spark.createDataFrame(rows, TURNS).where("false")).count() == 0


def test_given_pairs_keep_other_columns(spark):
    kind = "array<struct<role:string,text:string>>"
    df = spark.createDataFrame([(1, None, [("user", "a")], "p"), (2, [("user", "a")], None, "q")], f"id int, chosen {kind}, rejected {kind}, note string")
    got = {r["id"]: r for r in P.format_pairs(df).collect()}
    assert got[1]["chosen"] == "" and got[1]["rejected"] == one("user", "a") and got[2]["note"] == "q" and got[2]["chosen_spans"] == []


def test_query_covers_the_table(spark, sf_dir):
    turns = {}
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    got = {r["conv_id"]: r for r in op6_preference_pairs(spark, sf_dir).collect()}
    assert set(got) == set(turns)
    for c, r in got.items():
        other = turns[r["rejected_id"]] if r["rejected_id"] is not None else worse(turns[c])
        assert told(r) == brute(turns[c], other)
