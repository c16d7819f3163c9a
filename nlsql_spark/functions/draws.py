"""Repeatable random draws: a hash of the keys, the same on any partitioning."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", *[part.cast("string") for part in parts]).cast("binary"))


def uniform(*parts: Column) -> Column:
    """A draw in (0, 1) from the first 32 bits of the digest."""
    bits = F.conv(F.substring(digest(*parts), 1, 8), 16, 10).cast("double")
    return (bits + F.lit(0.5)) / F.lit(4294967296.0)


def pick_except(items: Column, skipped: Column, draw: Column) -> Column:
    """A uniformly drawn element that differs from ``skipped`` (NULL when there is none)."""
    pool = F.filter(items, lambda x: x != skipped)
    return F.get(pool, F.floor(draw * F.size(pool)).cast("int"))
