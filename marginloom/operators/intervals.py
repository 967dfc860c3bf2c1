"""Overlap of date intervals by dyadic cells, without comparing all versions of a key.

A half-open interval is the disjoint union of at most two maximal cells of each size 2**k days. A day
lies in one cell of every size. So "this day lies in that interval" is an equality of cells that holds
once, and two intervals overlap if and only if one of them begins inside the other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = 22  # 2**22 days reach beyond the year 9999
_EPOCH = 719_528  # days from year 0 to 1970, so that no day is negative
_OPEN_END = "9999-12-31"


def day_number(date: Column) -> Column:
    return F.unix_date(date) + _EPOCH


def open_end(date: Column) -> Column:
    """An interval without an end reaches to the last day that can be written."""
    return F.coalesce(date, F.lit(_OPEN_END).cast("date"))


def _top_level(days: Column) -> Column:
    """Largest level of a cell that fits into so many days; NULL if none does."""
    return F.when(days > 0, F.least(F.floor(F.log2(days + 0.5)), F.lit(LEVELS - 1)).cast("int"))


def _addressed(df: DataFrame, keys: Sequence[str], cell: Column) -> DataFrame:
    """`_at` is level and cell; `_slot`, a hash of it and the keys, decides a merge sort by one long."""
    at = F.shiftleft(F.col("_level").cast("long"), 32) + cell
    return df.withColumn("_at", at).withColumn("_slot", F.xxhash64(*keys, "_at"))


def with_cover(df: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Each row once for every maximal cell inside [start, end); not at all if end <= start."""
    first, last = F.col("_first"), F.col("_last")
    rows = df.withColumns({"_first": day_number(F.col(start)), "_last": day_number(open_end(F.col(end)))}).withColumn(
        "_level", F.explode(F.sequence(F.lit(0), _top_level(last - first))))
    ends = {}
    for name, level in (("", "_level"), ("_above", "_level + 1")):
        ends[f"_low{name}"] = F.expr(f"shiftright(_first + shiftleft(1, {level}) - 1, {level})")
        ends[f"_high{name}"] = F.expr(f"shiftright(_last, {level}) - 1")
    rows = rows.withColumns(ends)
    cells = F.when(F.col("_low") < F.col("_high"), F.array("_low", "_high")).when(
        F.col("_low") == F.col("_high"), F.array("_low"))
    rows = rows.withColumn("_cell", F.explode(cells)).filter(
        ~F.shiftright("_cell", 1).between(F.col("_low_above"), F.col("_high_above")))
    return _addressed(rows, keys, F.col("_cell")).drop("_first", "_last", "_level", "_cell", *ends)


def with_cells(df: DataFrame, keys: Sequence[str], day: str, top: Column) -> DataFrame:
    """Each row once for the cell of every size up to `top` that holds the day."""
    rows = df.withColumn("_day", day_number(F.col(day))).withColumn(
        "_level", F.explode(F.when(top >= 0, F.sequence(F.lit(0), top))))
    return _addressed(rows, keys, F.expr("shiftright(_day, _level)")).drop("_day", "_level")


def containing(points: DataFrame, intervals: DataFrame, keys: Sequence[str], point: str, start: str,
               end: str) -> DataFrame:
    """Rows of both sides with equal keys where the point lies in [start, end).

    Columns other than the keys must differ between the sides. A key with very many rows is spread
    over its cells. Points take only the sizes that fit into the longest interval. Neither side is
    broadcast: the planner sees them before they are multiplied by their cells.
    """
    longest = intervals.agg(F.max(day_number(open_end(F.col(end))) - day_number(F.col(start)))).scalar()
    left = with_cells(points, keys, point, _top_level(longest))
    right = with_cover(intervals, keys, start, end)
    return left.join(right.hint("merge"), ["_slot", "_at", *keys]).drop("_slot", "_at")


def overlapping(left: DataFrame, right: DataFrame, keys: Sequence[str], first: tuple[str, str],
                second: tuple[str, str]) -> DataFrame:
    """Pairs of rows with equal keys whose intervals overlap and begin on different days, each once.

    An interval that ends where it begins, or earlier, counts as the day on which it begins.
    """
    later_right = containing(right, left, keys, second[0], *first).filter(F.col(second[0]) > F.col(first[0]))
    later_left = containing(left, right, keys, first[0], *second).filter(F.col(first[0]) > F.col(second[0]))
    return later_right.unionByName(later_left)
