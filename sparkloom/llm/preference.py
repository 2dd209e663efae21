"""Preference formatting of conversations. DataFrame functions only.

A pair is a chosen and a rejected conversation. Their longest common prefix of turns is rendered once,
as the prompt; what follows in each is its completion, with the spans of characters that a loss should
count (the assistant's texts and their end marks).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import col, fresh
from sparkloom.shipping import checkpoint

START, END = "<|im_start|>", "<|im_end|>"
TRAINED_ROLE = "assistant"
_TURN = "struct<role:string,text:string>"


def conversations(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turns array<role, text>), turns by number, then role and text; null numbers come first.

    Rows without an id are conversations of one turn each, with a null id. Repeated rows stay repeated
    turns. A conversation is one row of the result, so its turns are gathered; nothing else is.
    """
    rows = df.select(
        col(df, id_col).alias("conv_id"), F.struct(col(df, turn_col).cast("long").alias("turn"), col(df, role_col).cast("string").alias("role"), col(df, text_col).cast("string").alias("text")).alias("t")
    )

    def strip(turns: Column) -> Column:
        return F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))

    whole = rows.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    single = rows.where("conv_id is null").select("conv_id", F.array("t").alias("turns"))
    return whole.unionByName(single).select("conv_id", strip(F.col("turns")).alias("turns"))


def render(turns: Column) -> Column:
    """Each turn as start mark, role, line feed, text, end mark, line feed; null role or text: empty."""
    return F.array_join(F.transform(turns, _one), "")


def _one(t: Column) -> Column:
    return F.concat(F.lit(START), F.coalesce(t["role"], F.lit("")), F.lit("\n"), F.coalesce(t["text"], F.lit("")), F.lit(END + "\n"))


def trained_spans(turns: Column) -> Column:
    """Half-open character spans of the rendered turns that a loss counts: texts of TRAINED_ROLE with
    their end marks."""
    lengths = F.transform(turns, lambda t: F.length(_one(t)))
    ends = F.transform(
        F.sequence(F.lit(1), F.size(turns)),
        lambda k: F.aggregate(F.slice(lengths, F.lit(1), k), F.lit(0), lambda a, x: a + x),
    )
    spans = F.zip_with(
        turns,
        ends,
        lambda t, e: F.when(t["role"] == TRAINED_ROLE, F.struct((e - 1 - len(END) - F.length(F.coalesce(t["text"], F.lit("")))).alias("start"), (e - 1).alias("end"))),
    )
    return F.when(F.size(turns) == 0, F.array().cast("array<struct<start:int,end:int>>")).otherwise(F.filter(spans, lambda s: s.isNotNull()))


def common_turns(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two arrays of turns; nulls equal nulls."""
    n = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.eqNullSafe(y))
    first = F.array_position(same, False).cast("int")
    return F.when(first > 0, first - 1).otherwise(n)


def _after(turns: Column, n: Column) -> Column:
    return F.slice(turns, n + 1, F.greatest(F.size(turns) - n, F.lit(0)))


def format_pairs(pairs: DataFrame) -> DataFrame:
    """``pairs`` has arrays ``chosen`` and ``rejected`` of turns (role, text); null counts as no turns.
    Its other columns stay, followed by ``prompt, chosen, rejected`` (texts), ``chosen_spans,
    rejected_spans, prompt_turns`` and ``identical``.

    Identical conversations have an empty completion each; without a common turn the prompt is empty. Where
    a column that stays has one of these names, ours is lengthened by ``_``.
    """
    none = F.array().cast(f"array<{_TURN}>")
    kept = [c for c in pairs.columns if c not in ("chosen", "rejected")]
    a, b = F.coalesce(pairs["chosen"], none), F.coalesce(pairs["rejected"], none)
    whole = F.struct(*[col(pairs, c) for c in kept]) if kept else F.struct(F.lit(0))
    cut = pairs.select(whole.alias("row"), a.alias("a"), b.alias("b")).withColumn("k", common_turns(F.col("a"), F.col("b")))
    parts = cut.select("row", "k", F.slice("a", F.lit(1), F.col("k")).alias("p"), _after(F.col("a"), F.col("k")).alias("a"), _after(F.col("b"), F.col("k")).alias("b"))
    made = {
        "prompt": render(F.col("p")),
        "chosen": render(F.col("a")),
        "rejected": render(F.col("b")),
        "chosen_spans": trained_spans(F.col("a")),
        "rejected_spans": trained_spans(F.col("b")),
        "prompt_turns": F.col("k"),
        "identical": (F.size("a") == 0) & (F.size("b") == 0),
    }
    names = fresh(pairs.select(*[col(pairs, c) for c in kept]), *made)
    both = parts.select("row", F.struct(*[c.alias(n) for n, c in zip(names, made.values(), strict=True)]).alias("made"))
    return both.select(*(["row.*"] if kept else []), "made.*")


def degraded(turns: Column) -> Column:
    """A worse variant: the last assistant turn repeats the assistant's turn before it, or says nothing
    if there is none. Without an assistant turn the variant lacks the last turn."""
    places = F.filter(F.sequence(F.lit(1), F.size(turns)), lambda k: F.element_at(turns, k)["role"] == TRAINED_ROLE)
    last = F.element_at(places, -1)
    before = F.when(F.size(places) > 1, F.element_at(turns, F.element_at(places, -2))["text"]).otherwise(F.lit(""))
    changed = F.transform(turns, lambda t, i: F.when(i + 1 == last, F.struct(t["role"].alias("role"), before.alias("text"))).otherwise(t))
    return F.when(F.size(turns) == 0, turns).when(F.size(places) > 0, changed).otherwise(F.slice(turns, F.lit(1), F.size(turns) - 1))


def preference_pairs(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One formatted pair per conversation: ``conv_id, rejected_id`` and the columns of :func:`format_pairs`.

    Conversations that open with the same turn answer the same request: each is chosen over the one
    with the smallest id, its ``rejected_id``. That one, and any that opens alone, is chosen over its
    degraded variant (``rejected_id`` null). So a group of n gives n pairs, however large it is; the
    joins have one row a group or an id on their right side, and Spark splits a group that holds a
    large share of the rows (AQE skew join).
    """
    convs = conversations(df, id_col, turn_col, role_col, text_col)
    first = F.element_at("turns", 1)
    key = F.sha2(F.to_json(F.struct(first["role"].alias("r"), first["text"].alias("t"))), 256)
    keyed = convs.withColumn("opening", key)
    # apart from the join, so that Spark can split an opening that many conversations share
    least = checkpoint(keyed.groupBy("opening").agg(F.min("conv_id").alias("partner")))
    placed = keyed.join(least, "opening").withColumn("rejected_id", F.when(~F.col("conv_id").eqNullSafe(F.col("partner")), F.col("partner")))
    others = convs.where("conv_id is not null").select(F.col("conv_id").alias("rejected_id"), F.col("turns").alias("other"))
    joined = placed.join(others, "rejected_id", "left")
    return format_pairs(joined.select("conv_id", "rejected_id", F.col("turns").alias("chosen"), F.coalesce("other", degraded(F.col("turns"))).alias("rejected")))
