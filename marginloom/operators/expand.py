"""Counts to records: long margins, prefix-sum identifiers and row expansion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows one source row may produce in a single task. A cell larger than this is first split into
# chunk rows that are spread over the cluster, so one huge cell never expands in one place.
CHUNK_ROWS = 100_000


def array_margins(df: DataFrame, keys: Sequence[str], arrays: dict[str, str], category: str,
                  label: str, first: int = 0, n: str = "n", keep_zeros: bool = False) -> DataFrame:
    """One row per (keys, label, category) from parallel count arrays.

    `arrays` maps an array column to its label, e.g. {"male": "M", "female": "F"}; the position in
    the array plus `first` is the category.
    """
    sides = F.array(*[F.struct(F.lit(text).alias("side"), F.col(column).alias("counts"))
                      for column, text in arrays.items()])
    long = (
        df.select(*keys, F.explode(sides).alias("_s"))
        .select(*keys, F.col("_s.side").alias(label), F.posexplode("_s.counts").alias("_p", n))
        .withColumn(category, (F.col("_p") + first).cast("int"))
        .select(*keys, label, category, n)
    )
    return long if keep_zeros else long.filter(F.col(n) > 0)


def map_margins(df: DataFrame, keys: Sequence[str], column: str, labels: Sequence[str],
                category: str, label: str, n: str = "n", exclude: Sequence[str] = (),
                keep_zeros: bool = False) -> DataFrame:
    """One row per (keys, label, category) from a map category -> [count per label]."""
    entries = df.select(*keys, F.explode(column).alias(category, "_counts"))
    if exclude:
        entries = entries.filter(~F.col(category).isin(list(exclude)))
    names = F.array(*[F.lit(text) for text in labels])
    long = (
        entries.select(*keys, category, F.posexplode("_counts").alias("_p", n))
        .withColumn(label, F.element_at(names, F.col("_p") + 1))
        .select(*keys, label, category, n)
    )
    return long if keep_zeros else long.filter(F.col(n) > 0)


def prefix_offsets(cells: DataFrame, levels: Sequence[Sequence[str]], n: str = "n",
                   offset: str = "offset") -> DataFrame:
    """Sum of `n` over all cells that sort before this one by the flattened `levels`.

    This replaces a global `row_number` over the expanded rows. The sum is built level by level:
    each window ranges over the distinct values of one level below one parent, so no task sees more
    than the children of a single parent (level 1 sees the distinct values of its own columns, which
    should therefore be a coarse key such as a province or a key range). Null-free level columns.
    """
    path: list[str] = []
    result = cells
    parts: list[Column] = []
    for depth, level in enumerate(levels):
        parent, path = list(path), path + list(level)
        window = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
        before = window.orderBy(*level).rowsBetween(Window.unboundedPreceding, -1)
        name = f"_offset{depth}"
        parts.append(F.col(name))
        if depth == len(levels) - 1:
            result = result.withColumn(name, F.coalesce(F.sum(n).over(before), F.lit(0)))
        else:
            totals = cells.groupBy(*path).agg(F.sum(n).alias("_total"))
            starts = totals.select(
                *path, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias(name))
            result = result.join(starts, path)
    total = parts[0]
    for part in parts[1:]:
        total = total + part
    drop = [f"_offset{depth}" for depth in range(len(levels))]
    return result.withColumn(offset, total.cast("long")).drop(*drop)


def expand_counts(cells: DataFrame, n: str = "n", ordinal: str = "i",
                  chunk_rows: int = CHUNK_ROWS, partitions: int | None = None,
                  together: Sequence[str] = ()) -> DataFrame:
    """One row per counted unit, with its ordinal 0..n-1; cells with n <= 0 vanish.

    The partition number is explicit: adaptive coalescing looks at the few bytes of the chunk rows
    and would otherwise put the whole expansion into one task. Rows that agree in `together`, if it is
    given, arrive in one partition, so that a window over them moves no expanded row.
    """
    if partitions is None:
        partitions = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [field.name for field in cells.schema.fields if field.dataType.simpleString()[:3] != "map"]
    count = F.col(n).cast("long")
    chunks = (
        cells.filter(count > 0)
        .withColumn("_chunk", F.explode(F.sequence(
            F.lit(0).cast("long"), F.floor((count - 1) / chunk_rows).cast("long"))))
        .repartition(partitions, *(together or [*keys, "_chunk"]))
    )
    start = F.col("_chunk") * chunk_rows
    stop = F.least(start + chunk_rows, count) - 1
    return chunks.withColumn(ordinal, F.explode(F.sequence(start, stop))).drop("_chunk")


def stable_ids(cells: DataFrame, levels: Sequence[Sequence[str]], n: str = "n",
               identity: str = "id", ordinal: str = "i", start: int = 0,
               chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Expanded rows with dense ids in the order of the levels, then the ordinal."""
    rows = expand_counts(prefix_offsets(cells, levels, n, "_start"), n, ordinal, chunk_rows)
    return rows.withColumn(identity, F.col("_start") + F.col(ordinal) + 1 + start).drop("_start")
