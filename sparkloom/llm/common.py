"""Expressions shared by the operators: whitespace, folds, fresh column names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A run of white space in the contracts: space, tab, line feed, vertical tab, form feed, return.
WS_RUN = r"[\x20\x09-\x0D]+"


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def collapse_ws(text: Column) -> Column:
    """Each run of white space becomes one space; null becomes empty."""
    return F.regexp_replace(text_or_empty(text), WS_RUN, " ")


def collapse_ws_bytes(raw: bytes) -> bytes:
    """collapse_ws for UTF-8 bytes; ``bytes.split`` cuts at the same six characters."""
    words = raw.split()
    if not words:
        return b" " if raw else b""
    body = b" ".join(words)
    return (b" " if raw[:1].isspace() else b"") + body + (b" " if raw[-1:].isspace() else b"")


def id_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(0)).cast("int")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened by ``_`` until no column of ``df`` has them (case is ignored)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def col(df: DataFrame, name: str) -> Column:
    """A column by its literal name, dots and quotes included."""
    return df["`" + name.replace("`", "``") + "`"]
