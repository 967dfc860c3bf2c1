"""Deterministic ranks inside groups of any size, and operators built on them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginloom.functions.hashing import hash_piece

# A group with more rows than this is ranked in several pieces, each in its own task.
ROWS_PER_PIECE = 1_000_000


def join_groups(df: DataFrame, groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on the keys where NULL equals NULL."""
    right = groups.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    match = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])
    return df.join(right, match, "left").drop(*[f"_of_{k}" for k in keys])


def with_group_size(df: DataFrame, group: Sequence[str], size: str = "group_size") -> DataFrame:
    """Attach the number of rows of each group (partial counts first, then a join).

    Rows with a NULL in the group form a group like any other.
    """
    return join_groups(df, df.groupBy(*group).agg(F.count(F.lit(1)).alias(size)), group)


def rank_within(df: DataFrame, group: Sequence[str], key: str, ties: Sequence[str] = (),
                size: str = "group_size", rank: str = "rank",
                rows_per_piece: int = ROWS_PER_PIECE,
                counts_from: DataFrame | None = None, largest: int | None = None) -> DataFrame:
    """`row_number` by (key, ties) inside each group, without putting a large group in one task.

    `key` is a `hash_key` and `size` the number of rows of the group. A group above `rows_per_piece`
    is cut into hash-range pieces; since pieces follow the order of the key, rank = rows in earlier
    pieces + row number inside the piece. Only groups that are cut are counted, and that filter on
    `size` reaches the source, so ordinary groups cost one shuffle and one sort. `counts_from` may
    give a cheaper frame with the same group, key and size columns to count from. `largest` is the
    size of the largest group when the caller knows it: if no group has to be cut, the plan is a
    plain window. A NULL in the group is a value like any other; only rows without a size are not cut.
    """
    group = list(group)
    if largest is not None and largest <= rows_per_piece:
        whole = Window.partitionBy(*group).orderBy(key, *ties)
        return df.withColumn(rank, F.row_number().over(whole).cast("long"))
    pieces = F.ceil(F.col(size) / F.lit(rows_per_piece)).cast("long")
    piece = F.when(F.col(size) > rows_per_piece, hash_piece(F.col(key), pieces)).otherwise(
        F.lit(0).cast("long"))
    source = (df if counts_from is None else counts_from).filter(F.col(size) > rows_per_piece)
    counts = (
        source.select(*group, piece.alias("_piece"))
        .groupBy(*group, "_piece").agg(F.count(F.lit(1)).alias("_rows"))
    )
    # Window and merge join want the same partitioning and order: the large side moves once.
    earlier = Window.partitionBy(*group).orderBy("_piece").rowsBetween(
        Window.unboundedPreceding, -1)
    starts = counts.select(*group, "_piece", F.sum("_rows").over(earlier).alias("_before"))
    local = Window.partitionBy(*group, "_piece").orderBy(key, *ties)
    # Without the repartition, rows that arrive hashed by the group alone would satisfy the window as
    # they are, and a large group would stay in one task although it is cut.
    numbered = df.withColumn("_piece", piece).repartition(*group, "_piece").withColumn(
        "_local", F.row_number().over(local))
    return join_groups(numbered, starts.hint("merge"), [*group, "_piece"]).withColumn(
        rank, F.col("_local") + F.coalesce("_before", F.lit(0))).drop("_piece", "_local", "_before")


def select_n_per_cell(df: DataFrame, group: Sequence[str], key: str, quota: str,
                      ties: Sequence[str] = (), **options: object) -> DataFrame:
    """The first `quota` rows of each group, the quota being a column."""
    ranked = rank_within(df, group, key, ties, rank="_rank", **options)
    return ranked.filter(F.col("_rank") <= F.col(quota)).drop("_rank")


def match_by_rank(units: DataFrame, slots: DataFrame, group: Sequence[str],
                  rank: str = "rank", how: str = "inner") -> DataFrame:
    """Pair the k-th unit with the k-th slot of its group.

    Joining on the rank as well as the group spreads even a dominant group over all tasks, and with
    the rank first the merge sort is decided by that one long almost everywhere. The merge
    hint is needed: both sides usually come from `expand_counts`, whose size estimate is that of
    the unexpanded cells, so the planner would broadcast a side that is far too large for it.
    """
    return units.join(slots.hint("merge"), [rank, *group], how)
