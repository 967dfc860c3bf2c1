"""Positions in a total order over rows of any number, without a task that sees all of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginloom.session import materialize

# `monotonically_increasing_id` has the partition in its upper and the row in its lower 33 bits.
ROW_BITS = 33


def ranged(df: DataFrame, order: Sequence[str], pieces: int | None = None) -> DataFrame:
    """The rows in stored ranges of the order, with their `_range` and their place `_at` in it.

    The splitters are sampled from the values themselves, so values with a long common prefix are
    spread like any others. Rows that are equal in the order share a range.
    """
    if pieces is None:
        pieces = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.monotonically_increasing_id()
    cut = df.repartitionByRange(pieces, *order).sortWithinPartitions(*order).select(
        "*", F.shiftright(place, ROW_BITS).cast("int").alias("_range"),
        place.bitwiseAND(F.lit((1 << ROW_BITS) - 1)).alias("_at"))
    # Stored, since the places hold only for these splitters.
    return materialize(cut, "ranges")


def with_ordinal(df: DataFrame, order: Sequence[str], ordinal: str = "ordinal", start: int = 1,
                 pieces: int | None = None) -> DataFrame:
    """Every row with its position in the order, counted from `start`; NULL sorts first.

    The rows of a range are counted, and the counts are summed over the earlier ranges; only these
    few counts meet in one task. Rows that are equal in the order get different positions.
    """
    stored = ranged(df, order, pieces)
    counts = stored.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_range", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    position = (F.col("_before") + F.col("_at") + start).cast("long")
    return stored.join(before, "_range").withColumn(ordinal, position).drop("_range", "_at", "_before")
