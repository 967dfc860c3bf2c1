"""Exact comparison of counted cells and of records."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compare_margins(expected: DataFrame, actual: DataFrame, keys: Sequence[str],
                    n: str = "n") -> DataFrame:
    """Full outer comparison, missing cells count as zero.

    Both sides must hold one row per key. Keep explicit zeros on the expected side only, or drop
    them on both sides: an absent cell and a zero cell compare equal, but counting comparisons
    needs one convention.
    """
    left = expected.select(*keys, F.col(n).alias("expected"))
    right = actual.select(*keys, F.col(n).alias("actual"))
    return left.join(right, list(keys), "full").select(
        *keys,
        F.coalesce("expected", F.lit(0)).cast("long").alias("expected"),
        F.coalesce("actual", F.lit(0)).cast("long").alias("actual"),
    )


def margin_summary(comparison: DataFrame, by: Sequence[str]) -> DataFrame:
    return comparison.groupBy(*by).agg(
        F.count(F.lit(1)).alias("cells"),
        F.sum("expected").cast("long").alias("expected"),
        F.sum("actual").cast("long").alias("actual"),
        F.count_if(F.col("expected") != F.col("actual")).alias("mismatched_cells"),
        F.max(F.abs(F.col("expected") - F.col("actual"))).alias("max_absolute_error"),
    )


def attach_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row frame to every row, as an uncorrelated scalar subquery."""
    value = one_row.select(F.struct(*one_row.columns)).scalar()
    names = [F.col(f"_scalar.{c}").alias(c) for c in one_row.columns]
    return df.withColumn("_scalar", value).select(*df.columns, *names)


def any_differs(columns: Sequence[str], left: str = "l", right: str = "r") -> Column:
    return reduce(
        lambda a, b: a | b,
        [~F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns],
    )


def row_diff(before: DataFrame, after: DataFrame, identity: Sequence[str],
             attributes: Sequence[str]) -> DataFrame:
    """Identities that exist on one side only, or whose attributes differ (NULL-safe)."""
    left = before.select(*identity, F.struct(*attributes).alias("before"))
    right = after.select(*identity, F.struct(*attributes).alias("after"))
    return left.join(right, list(identity), "full").filter(
        ~F.col("before").eqNullSafe(F.col("after")))


def hierarchy_margins(cells: DataFrame, levels: Sequence[Sequence[str]], keys: Sequence[str],
                      n: str = "n", level: str = "level") -> DataFrame:
    """Totals of `n` by (level columns, keys) for every level of a hierarchy in one pass.

    `levels` are the column sets of each level, e.g. [["region"], ["province"], []]; columns that
    are not part of a level are NULL in its rows and `level` holds the position.
    """
    columns = list(dict.fromkeys(c for names in levels for c in names))
    sets = [[F.col(c) for c in [*names, *keys]] for names in levels]
    grouping = F.grouping_id()
    masks = {}
    for position, names in enumerate(levels):
        mask = 0
        for c in [*columns, *keys]:
            mask = mask * 2 + (0 if c in names or c in keys else 1)
        masks[mask] = position
    if len(masks) != len(levels):
        raise ValueError("Levels must differ in their columns")
    position = F.create_map(*[F.lit(v) for pair in masks.items() for v in pair])
    return (
        cells.groupingSets(sets, *columns, *keys)
        .agg(F.sum(n).cast("long").alias(n), grouping.cast("int").alias("_gid"))
        .withColumn(level, F.element_at(position, F.col("_gid")))
        .drop("_gid")
    )
