"""Gapless numbers in a global or per-key order, without one task for one key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.operators.distributed import materialize

ROWS_PER_RANGE = 50_000


def in_ranges(df: DataFrame, order: list[str], rows: int, label: str) -> DataFrame:
    """Written in ranges of the order (nulls first), with the number of the range as the column ``range``."""
    parts = max(1, -(-rows // ROWS_PER_RANGE))
    placed = df.repartitionByRange(parts, *[F.col(c).asc_nulls_first() for c in order])
    return materialize(placed.withColumn("range", F.spark_partition_id()), label)


def numbered(df: DataFrame, keys: list[str], order: list[str], rows: int, label: str, out: str) -> DataFrame:
    """Adds ``out``: 0, 1, ... inside each key (no nulls among the keys) in the given order.

    Ranges of the whole order are counted first, so a key with most of the rows is numbered by many tasks.
    """
    ranged = in_ranges(df, [*keys, *order], rows, label)
    counts = ranged.groupBy(*keys, "range").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    inside = Window.partitionBy(*keys, "range").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    number = (F.col("offset") + F.row_number().over(inside) - 1).alias(out)
    return ranged.join(offsets, [*keys, "range"]).select(*df.columns, number)


def with_id(id_col: Column) -> list[Column]:
    """The id without nulls and a flag for them: pandas would turn a nullable 64-bit id into a float."""
    value = id_col.cast("long")
    return [F.coalesce(value, F.lit(0)).alias("doc_id"), value.isNull().alias("no_id")]


def restored(df: DataFrame) -> DataFrame:
    """Undoes ``with_id``."""
    return df.withColumn("doc_id", F.when(~F.col("no_id"), F.col("doc_id"))).drop("no_id")
