"""Ordered positions over whole tables, without one task or one group holding them."""

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nlsql_spark.session import cut_lineage

ROWS_PER_RANGE = 500_000
_MID, _PID, _FIRST = "__row", "__range", "__first"


def _columns(items: Sequence[str | Column]) -> list[Column]:
    return [F.col(item) if isinstance(item, str) else item for item in items]


def ordered_position(
    df: DataFrame,
    order: Sequence[str],
    keys: Sequence[str] = (),
    name: str = "position",
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """0-based position of each row in ``order`` (within ``keys`` if given).

    Small tables take a plain window. Larger ones are range-partitioned on (keys, order), so a hot key
    spreads over many partitions; each partition is numbered locally and shifted by the row count of
    the partitions before it. ``order`` must end in something unique for the result to be repeatable.
    """
    ranges = math.ceil(df.count() / rows_per_range)
    sort = [*keys, *order]
    if ranges <= 1:
        window = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
        return df.withColumn(name, F.row_number().over(window.orderBy(*order)).cast("long") - 1)

    ranged = df.repartitionByRange(ranges, *sort).sortWithinPartitions(*sort)
    # the id packs (partition, row in partition); the cut keeps both fixed for the two passes below
    ranged = cut_lineage(ranged.withColumn(_MID, F.monotonically_increasing_id()))
    ranged = ranged.withColumn(_PID, F.shiftright(F.col(_MID), 33))
    counts = ranged.groupBy(_PID).count()
    before = Window.partitionBy(F.lit(0)).orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(_PID, F.coalesce(F.sum("count").over(before), F.lit(0)).alias(_FIRST))
    # one row per range: its size is fixed by the partition count
    numbered = ranged.join(F.broadcast(shifts), _PID).withColumn(
        name, F.col(_MID).bitwiseAND((1 << 33) - 1) + F.col(_FIRST)
    )
    numbered = numbered.drop(_MID, _PID, _FIRST)
    if not keys:
        return numbered
    # keys may be NULL, so they are renamed and compared null-safely
    starts = numbered.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.min(name).alias(_FIRST))
    match = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    shifted = numbered.join(starts, match).withColumn(name, F.col(name) - F.col(_FIRST))
    return shifted.drop(_FIRST, *[f"__{k}" for k in keys])


def with_document_id(df: DataFrame, order: Sequence[str], name: str = "document_id", **kwargs) -> DataFrame:
    """Sequential ids in (database, table, column) order."""
    return ordered_position(df, order, name=name, **kwargs)


def chunk(df: DataFrame, key: str, size: int, name: str = "chunk", **kwargs) -> DataFrame:
    """Fixed-size chunks in key order."""
    placed = ordered_position(df, [key], name="__pos", **kwargs)
    return placed.withColumn(name, F.floor(F.col("__pos") / size).cast("long")).drop("__pos")


def head(df: DataFrame, n: int, *order: str) -> DataFrame:
    return df.orderBy(*order).limit(n)


def sort_by_int_id(df: DataFrame, col: str) -> DataFrame:
    return df.orderBy(F.col(col).cast("bigint"))


def sort_by_question(df: DataFrame, col: str = "question_id") -> DataFrame:
    return df.orderBy(col)


def union_all(dfs: Sequence[DataFrame]) -> DataFrame:
    out = dfs[0]
    for df in dfs[1:]:
        out = out.unionByName(df)
    return out
