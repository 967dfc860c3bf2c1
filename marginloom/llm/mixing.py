"""Mixing sources to target weights by systematic sampling (DataFrame functions only).

Every document of a source is expected the same number of times, e = target / size of the source.
The documents of a source stand in an order of ascending size. Along it the expected copies are
summed, one offset is added for the source, and a document is emitted once for every integer that
its stretch of the sum crosses. As neighbours in this order have about the same size, the words
taken miss the target by less than the size of the largest document.

Since e is constant in a source, the prefix sum is e * (position in the source). Positions are
counted in two steps, so that a source with most of the rows never meets in one task: rows are
numbered in pieces of (source, size class), and the counts of the earlier pieces are added. Only
the counts of pieces, one row per size class, are ordered per source.

Results for unusual rows: a null text has size 0; a null source is a source of its own, the last;
rows with null or repeated ids are rows like any others; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginloom.llm.rows import emitted, row_key, single_rows
from marginloom.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
CLASSES_PER_DOUBLING = 16
ROWS_PER_PIECE = 200_000


def word_count(text: Column) -> Column:
    """Maximal runs of characters other than space and tab to carriage return; null: 0."""
    blanks = "\t\n\x0b\x0c\r"
    spaced = F.trim(F.regexp_replace(F.translate(text, blanks, " " * len(blanks)), " {2,}", " "))
    gaps = F.length(spaced) - F.length(F.replace(spaced, F.lit(" ")))
    return F.coalesce(F.when(spaced == "", 0).otherwise(gaps + 1), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, source: str, size: str, share: float,
                   weights: tuple[float, ...], cap: float) -> DataFrame:
    """One row per source: `_size` and `_target`.

    The targets are the level at which min(cap * size, level * weight) sums up to the share of all
    sizes: what handing the excess of capped sources to the others by weight ends with. One row per
    source is ordered here, never rows of documents.
    """
    per = sizes.groupBy(source).agg(F.sum(size).alias("_size"))
    # Spark orders strings by their UTF-8 bytes, which is the order of code points.
    place = F.row_number().over(Window.orderBy(F.col(source).asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          ((place - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("_weight", weight).withColumn("_cap", F.lit(cap) * F.col("_size"))
    by_ratio = Window.orderBy((F.col("_cap") / F.col("_weight")).asc(), F.col(source).asc_nulls_last())
    earlier = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    later = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.lit(share) * F.sum("_size").over(Window.partitionBy())
             - F.coalesce(F.sum("_cap").over(earlier), F.lit(0.0))) / F.sum("_weight").over(later)
    levels = per.withColumn("_level", level).withColumn("_order", F.row_number().over(by_ratio))
    open_ = F.col("_level") * F.col("_weight") <= F.col("_cap")
    first = F.min_by("_level", F.when(open_, F.col("_order"))).over(Window.partitionBy())
    target = F.least("_cap", F.coalesce(first * F.col("_weight"), F.col("_cap")))
    return levels.select(F.col(source).alias("_source"), "_size", target.alias("_target"))


def positions(rows: DataFrame, source: str, size: str, tie: str, *ties: str) -> DataFrame:
    """Add `_position`, from 1 in each source, in ascending order of size classes and pieces."""
    fine = F.floor(F.log2(F.col(size) + 1) * CLASSES_PER_DOUBLING).cast("int")
    rows = rows.withColumn("_class", fine)
    counts = rows.groupBy(source, "_class").agg(F.count("*").alias("_n"))
    pieces = counts.withColumn("_pieces", F.ceil(F.col("_n") / ROWS_PER_PIECE).cast("int"))
    keyed = rows.alias("r").join(
        pieces.select(F.col(source).alias("_s"), F.col("_class").alias("_c"), "_pieces").hint("merge"),
        F.col(source).eqNullSafe(F.col("_s")) & (F.col("_class") == F.col("_c")), "left"
    ).withColumn("_piece", F.pmod(F.xxhash64(tie), F.col("_pieces"))).drop("_s", "_c", "_pieces")
    before = Window.partitionBy(source).orderBy("_class", "_piece").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = keyed.groupBy(source, "_class", "_piece").agg(F.count("*").alias("_m")).withColumn(
        "_before", F.coalesce(F.sum("_m").over(before), F.lit(0))).select(
        F.col(source).alias("_s"), F.col("_class").alias("_c"), F.col("_piece").alias("_p"), "_before")
    inside = Window.partitionBy(source, "_class", "_piece").orderBy(size, tie, *ties)
    numbered = keyed.withColumn("_row", F.row_number().over(inside))
    return numbered.join(
        offsets, F.col(source).eqNullSafe(F.col("_s")) & (F.col("_class") == F.col("_c"))
        & (F.col("_piece") == F.col("_p")), "left").withColumn(
        "_position", F.col("_before") + F.col("_row")).drop(
        "_s", "_c", "_p", "_before", "_row", "_class", "_piece")


def mix(sizes: DataFrame, source: str, size: str, tie: str, share: float = 1.5,
        weights: tuple[float, ...] = (3.0, 1.0, 2.0), cap: float = 2.0, seed: int = 7,
        ties: tuple[str, ...] = ()) -> DataFrame:
    """Add `source_size`, `target`, `copies` and `taken` to rows with a source and a size.

    `copies` is at most ceil(cap). The offset of a source is a hash of the seed and its name, so a
    rerun takes the same documents.
    """
    targets = source_targets(sizes, source, size, share, weights, cap)
    placed = positions(sizes, source, size, tie, *ties)
    # One row per source; Spark broadcasts it below its own size threshold and merges beyond.
    joined = placed.join(targets, F.col(source).eqNullSafe(F.col("_source")), "left")
    expected = F.when(F.col("_size") > 0, F.col("_target") / F.col("_size")).otherwise(0.0)
    offset = F.pmod(F.xxhash64(F.lit(seed), F.coalesce(F.col(source), F.lit("\0"))), F.lit(1_000_003)
                    ) / F.lit(1_000_003.0)
    upto = F.floor(offset + expected * F.col("_position"))
    before = F.floor(offset + expected * (F.col("_position") - 1))
    copies = F.least(upto - before, F.lit(int(-(-cap // 1)))).cast("long")
    return joined.withColumn("copies", copies).withColumn(
        "taken", F.col("copies") * F.col(size)).withColumnRenamed("_size", "source_size").withColumn(
        "target", F.col("_target").cast("double")).drop("_source", "_target", "_position")


def document_mix(documents: DataFrame, keyed: bool = True, **options) -> DataFrame:
    """doc_id, source, size and what `mix` adds, for a table with doc_id, text and source.

    The sizes are stored once, so the texts are read once. With `keyed` there is also `row`, the key
    that `repeat_rows` finds the documents by; rows with one id are ordered by it.
    """
    key = [row_key(*documents.columns).alias("row")] * keyed
    sizes = materialize(documents.select(
        *key, "doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    return mix(sizes, "source", "size", "doc_id", ties=("row",) * keyed, **options)


def repeat_rows(documents: DataFrame, mixed: DataFrame) -> DataFrame:
    """The documents of a mix, each as often as its copies; rows keep the documents' columns.

    `mixed` is what `document_mix` gives for the same documents. Rows that are equal in all columns
    are copies of one another: they stand as often as their copies are together.
    """
    chosen = mixed.filter("copies > 0").groupBy("row").agg(F.sum("copies").alias("_copies"))
    rows = single_rows(documents.withColumn("row", row_key(*documents.columns)), "row", "_equal")
    return emitted(rows.join(chosen.hint("merge"), "row"), F.col("_copies"), documents.columns)
