"""Scalar functions on strings and paths."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def snake(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(name), "[ -]", "_"))


def snake_name(name: str) -> str:
    """:func:`snake` of one name, as those of columns."""
    return re.sub("[ -]", "_", name.strip(" ")).lower()


def human_size(size: Column) -> Column:
    """Bytes as they are, larger units with one digit, in steps of 1024, up to TB; exact
    halves go to the even digit."""
    units = ["KB", "MB", "GB", "TB"]
    steps = [(u, 1024.0 ** (i + 1)) for i, u in enumerate(units)]
    return reduce(
        lambda out, step: F.when(size >= step[1], F.format_string(f"%.1f {step[0]}", F.bround(size / step[1], 1))).otherwise(out),
        steps,
        F.format_string("%d B", size.cast("long")),
    )


def ancestors(path: Column) -> Column:
    """Every prefix of a path at a segment end, the path itself last; empty segments do not count."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).otherwise(F.array().cast("array<string>"))


def parent(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")
