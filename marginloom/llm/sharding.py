"""K-d tree partitioning of a table into shards of near equal weight (DataFrame functions only).

The table is split again and again, each time along the dimension that is widest in the node, at
the weighted quantile that gives both sides their share of the leaves, until every node is one
leaf. The dimensions are what a text tells about itself: its bytes, and the shares of other letters,
white space and digits. A quantile is found by weighted histograms of 4096 bins for all nodes of a level
at once, first of the dimension. Only inside the bin where the quantile lies, ties are divided by a hash
of the group, then by a hash of the row, which differs between copies of a row. Only the cuts, at most
one for each shard, reach the driver; rows are never sorted or moved to find them.

A cut between two groups is taken if it is off by at most `SLACK` of a shard's weight; otherwise
the group at the cut is larger than that and is divided. So equal texts stay together unless that
would make the shards unequal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginloom.session import materialize

BINS = 4096
SLACK = 0.01
ROWS_PER_PIECE = 200_000


def text_dimensions(text: Column) -> list[Column]:
    """Dimensions from 0 to 1 that depend on the text only: length, shares of other letters, white space
    and digits."""
    size, chars = F.octet_length(text), F.char_length(text)

    def share(signs: str) -> Column:
        return 1 - F.char_length(F.translate(text, signs, "")) / F.greatest(chars, F.lit(1))

    return [F.log2(size + 1) / 40, 1 - chars / F.greatest(size, F.lit(1)), share(" \t\n\r"), share("0123456789")]


def tree(rows: DataFrame, n_shards: int, dimensions: list[str]) -> DataFrame:
    """Add `_node`, the shard, to rows with `_weight`, `_group`, `_row` and the dimensions as bins."""
    cuts: dict[tuple[int, int], tuple[str, list[int]]] = {}
    open_, placed = {0: n_shards}, rows.withColumn("_node", F.lit(0))
    while open_ := {n: leaves for n, leaves in open_.items() if leaves > 1}:
        at = placed.filter(F.col("_node").isin(list(open_)))
        spread = at.groupBy("_node").agg(*[(F.max(d) - F.min(d)).alias(d) for d in dimensions]).collect()
        widest = {r["_node"]: max(dimensions, key=lambda d: (r[d], d)) for r in spread}
        for n, bins in quantiles(at, open_, widest, dimensions).items():
            cuts[n, open_[n]] = widest[n], bins
        open_ = {n: leaves // 2 for n, leaves in open_.items()} | {
            n + leaves // 2: leaves - leaves // 2 for n, leaves in open_.items()}
        placed = rows.withColumn("_node", walk(0, n_shards, cuts))
    return placed


def walk(node: int, leaves: int, cuts: dict) -> Column:
    """The way down the tree from a node; a left side has the number of its node."""
    if (node, leaves) not in cuts:
        return F.lit(node)
    dimension, bins = cuts[node, leaves]
    keys = [F.col(dimension), F.col("_group"), F.col("_row")]
    right = keys[len(bins) - 1] >= bins[-1]
    for k, bin_ in reversed(list(zip(keys, bins[:-1]))):
        right = (k > bin_) | ((k == bin_) & right)
    left = leaves // 2
    return F.when(right, walk(node + left, leaves - left, cuts)).otherwise(walk(node, left, cuts))


def by_node(values: dict[int, float]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), F.col("_node"))


def quantiles(at: DataFrame, leaves: dict[int, int], widest: dict[int, str], dimensions: list[str]
              ) -> dict[int, list[int]]:
    """For each node the bins of its cut, at most three deep; the right side begins with the cut."""
    axis = F.element_at(F.array(*dimensions), by_node({n: dimensions.index(d) + 1 for n, d in widest.items()})
                        ) if widest else F.lit(0)
    keys = [axis, F.col("_group"), F.col("_row")]
    found: dict[int, list[int]] = {n: [] for n in widest}
    left = {n: (leaves[n] // 2) / leaves[n] for n in widest}
    wanted, total, before = dict(left), {}, dict.fromkeys(widest, 0)
    for depth, key in enumerate(keys):
        if not wanted:
            break
        part = at.filter(F.col("_node").isin(list(wanted)))
        for k in range(depth):
            part = part.filter(keys[k] == by_node({n: found[n][k] for n in wanted}))
        for r in crossing_bins(part, wanted, key):
            n = r["_node"]
            total.setdefault(n, r["_total"])
            goal, under = total[n] * left[n], before[n] + r["_upto"] - r["_w"]
            low, high = goal - under, under + r["_w"] - goal
            if min(low, high) <= SLACK * total[n] / leaves[n] or depth == 2:
                found[n].append(r["_bin"] + (high < low))
                wanted.pop(n)
            else:
                found[n].append(r["_bin"])
                before[n], wanted[n] = under, low / r["_w"]
    return found


def crossing_bins(rows: DataFrame, wanted: dict[int, float], key: Column) -> list:
    """For each node: the bin of `key` in which the wanted share of these rows' weight is reached.

    One row a node is returned; the windows are over at most BINS rows a node.
    """
    bins = rows.groupBy("_node", key.alias("_bin")).agg(F.sum("_weight").alias("_w"))
    order = Window.partitionBy("_node").orderBy("_bin")
    upto = F.sum("_w").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    total = F.sum("_w").over(Window.partitionBy("_node"))
    return bins.withColumns({"_upto": upto, "_total": total}).filter(
        F.col("_upto") >= by_node(wanted) * F.col("_total") - 0.5).groupBy("_node").agg(
        F.min(F.struct("_bin", "_upto", "_w", "_total")).alias("c")).select("_node", "c.*").collect()


def slots(rows: DataFrame, shard: str, key: str) -> DataFrame:
    """Add `slot`, gapless from 0 in each shard, without gathering a shard in one task."""
    counts = rows.groupBy(shard).agg(F.count("*").alias("_n")).select(
        F.col(shard), F.ceil(F.col("_n") / ROWS_PER_PIECE).cast("int").alias("_pieces"))
    rows = rows.join(F.broadcast(counts), shard).withColumn(  # one row a shard
        "_piece", F.pmod(F.xxhash64(key), F.col("_pieces"))).drop("_pieces")
    before = Window.partitionBy(shard).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(shard, "_piece").agg(F.count("*").alias("_m")).withColumn(
        "_before", F.coalesce(F.sum("_m").over(before), F.lit(0))).drop("_m")
    inside = Window.partitionBy(shard, "_piece").orderBy(key)
    return rows.withColumn("_place", F.row_number().over(inside)).join(
        offsets, [shard, "_piece"]).withColumn(
        "slot", F.col("_before") + F.col("_place") - 1).drop("_piece", "_place", "_before")


def shard_documents(documents: DataFrame, n_shards: int = 24, doc_id: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row.

    The weight of a row is the bytes of its text plus 8. A null text counts as empty; rows with
    equal or null ids are rows like any others. The law is `bytes`, so grown_shard is null. The
    texts are read once; all else works on a stored table of a few numbers a row.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    dims = [f"_d{i}" for i in range(4)]
    # Rows of the stored table keep this number, so copies of a row are told apart.
    number = F.monotonically_increasing_id()
    rows = materialize(documents.select(
        F.col(doc_id).alias("doc_id"), (F.octet_length(body) + 8).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"), F.pmod(F.xxhash64(body), F.lit(BINS)).cast("int").alias("_group"),
        F.pmod(F.xxhash64(doc_id, number), F.lit(BINS)).cast("int").alias("_row"), number.alias("_number"),
        *[F.least(F.floor(d * BINS), F.lit(BINS - 1)).cast("int").alias(name)
          for d, name in zip(text_dimensions(body), dims)]), "shard-keys")
    placed = tree(rows.withColumn("_weight", F.col("size")), n_shards, dims)
    out = slots(placed.select("doc_id", "size", "text_crc32", "_number", F.col("_node").cast("int").alias("shard")),
                "shard", "_number")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                      F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"))
