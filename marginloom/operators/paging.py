"""Keyset pages: stable order on any allowed column, NULL last both ways, identity as tie-break."""

from __future__ import annotations

from collections.abc import Collection, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginloom.operators.ordering import with_ordinal

MAX_LIMIT = 500


def check_page(sort_by: str, allowed: Collection[str], direction: str, limit: int,
               maximum: int = MAX_LIMIT + 1) -> None:
    """`maximum` leaves room for the one extra row that tells whether a next page exists."""
    if sort_by not in allowed:
        raise ValueError(f"Unknown sort column: {sort_by}")
    if direction not in ("asc", "desc"):
        raise ValueError("Direction must be asc or desc")
    if not 1 <= limit <= maximum:
        raise ValueError(f"Limit must be between 1 and {maximum}")


def keyset_page(df: DataFrame, order: Column | str, identity: str, direction: str = "asc",
                after: int | None = None, limit: int = MAX_LIMIT) -> DataFrame:
    """The `limit` rows that follow the row whose identity is `after`.

    The anchor row is looked up inside the same filtered frame, as a scalar subquery; an unknown
    anchor gives an empty page. Ordering and limit run as one top-k, never a full sort.
    """
    check_page("", [""], direction, limit, maximum=2**31 - 1)
    value = F.col(order) if isinstance(order, str) else order
    keyed = df.withColumn("_order", value)
    page = keyed
    if after is not None:
        # A struct tells "no such row" (NULL) from "the anchor's value is NULL".
        anchor = keyed.filter(F.col(identity) == after).agg(
            F.first(F.struct(F.col("_order").alias("v"))).alias("a"))
        page = keyed.withColumn("_anchor", anchor.scalar())
        at = F.col("_anchor.v")
        later = F.col(identity) > after
        beyond = F.col("_order") < at if direction == "desc" else F.col("_order") > at
        from_value = beyond | ((F.col("_order") == at) & later) | F.col("_order").isNull()
        from_null = F.col("_order").isNull() & later
        page = page.filter(
            F.col("_anchor").isNotNull() & F.when(at.isNull(), from_null).otherwise(from_value))
    ordering = (F.desc_nulls_last if direction == "desc" else F.asc_nulls_last)("_order")
    return page.orderBy(ordering, F.asc(identity)).limit(limit).select(*df.columns)


def id_page(df: DataFrame, identity: str, after: int = 0, limit: int = MAX_LIMIT) -> DataFrame:
    """Page by the identity alone: the filter reaches the scan."""
    return df.filter(F.col(identity) > after).orderBy(identity).limit(limit)


def equals(df: DataFrame, **values: object) -> DataFrame:
    """Equality filters for the arguments that were given; None means no filter."""
    for name, value in values.items():
        if value is not None:
            df = df.filter(F.col(name) == F.lit(value))
    return df


def matches(search: str | None, columns: Sequence[Column | str]) -> Column:
    """Literal, case-insensitive substring in any of the columns; no pattern characters."""
    if not search:
        return F.lit(True)
    found = F.lit(False)
    for column in columns:
        text = F.col(column) if isinstance(column, str) else column
        found = found | F.contains(F.lower(text), F.lower(F.lit(search)))
    return found


def next_cursor(rows: list, limit: int, identity: str) -> tuple[list, int | None]:
    """Split rows fetched with limit+1 into one page and the cursor of the next."""
    page = rows[:limit]
    return page, (page[-1][identity] if len(rows) > limit else None)


def text_order(*columns: DataFrame, pieces: int | None = None) -> DataFrame:
    """(value, ordinal) of the distinct non-NULL texts in binary order.

    The ordinal is only a stored form of the engine's own binary text order; queries sort by the
    text itself.
    """
    values = reduce(DataFrame.union, [c.toDF("value") for c in columns]).filter(
        "value is not null").distinct()
    return with_ordinal(values, ["value"], pieces=pieces)
