"""Draws that any engine repeats: numbers from the digest of a seed and a key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest_number(key: Column, seed: str) -> Column:
    """A whole number below 2^32 from the first eight hexadecimal digits of md5(seed:key); null for a null key."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), key.cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")


def uniform(key: Column, seed: str) -> Column:
    """In [0, 1)."""
    return digest_number(key, seed) / float(1 << 32)
