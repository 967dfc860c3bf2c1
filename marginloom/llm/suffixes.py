"""Removal of repeated byte strings by bucket-pointer refinement of suffixes.

A byte is removed if a string of `WINDOW` bytes that covers it also starts somewhere else. So the
suffixes have to be sorted no deeper than WINDOW bytes, and only buckets with several members count:

1. Initial buckets. Every start has an anchor, the place of the smallest gram hash in the middle of
   its window. Starts with the same anchor form a run. The bucket of a run is the q-gram of
   q = WINDOW / 2 bytes around the anchor, which all its windows contain. Starts with equal windows
   have equal anchors at equal distances, so they are in one bucket.
2. A bucket with one member is final: nothing there repeats. Runs that are equal from their first
   to their last byte are final too: all their starts repeat.
3. Refinement. In buckets with different runs, one run of each kind is kept and taken apart into
   starts. A start is named by its bucket and by the names of the q-grams at the offsets 0 and q,
   where a name of q bytes is made of the names of its halves, down to SMALLEST bytes: each name is
   computed once for each place and used again by all starts and all levels that point to it. Starts
   with one name are a bucket of the next level, at which the depth is WINDOW.

Names are 64-bit hashes instead of ranks, so they can be given in the tasks that hold the text; the
sorting that brings the members of a bucket together is Spark's shuffle and sort. All rows have a
bounded size, and a bucket is read as a sorted stream, so no bucket needs to fit into memory. Copies
of a text share out over as many buckets as the text has anchors.

Unusual rows: null and empty texts have no bytes and nothing is removed. Rows are told apart by a
hash of id and text; repeated rows are copies of one another, and a null id is an id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginloom.llm.anchors import runs
from marginloom.llm.packing import pack, unpack
from marginloom.llm.textscan import mix, prefix_hashes, slices, span_hashes
from marginloom.llm.workers import mapped
from marginloom.session import materialize

WINDOW = 200
SMALLEST = 25


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def initial_runs(texts: DataFrame, window: int) -> DataFrame:
    """(row, start, n, bucket, whole): runs with the name of their bucket and of all their bytes."""
    margin = window // 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, data, offsets in slices(batch.column(1)):
                row, anchor, start, n = runs(data, offsets, window, margin)
                if not len(row):
                    continue
                prefix = prefix_hashes(data)
                bucket = span_hashes(prefix, anchor - margin, anchor + margin)
                whole = span_hashes(prefix, start, start + n + window - 1)
                whole = mix(whole + mix((anchor - start).astype(np.uint64) * np.uint64(4096)
                                        + n.astype(np.uint64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(lo + row)),
                     pa.array((start - offsets[row]).astype(np.int32)), pa.array(n.astype(np.int32)),
                     _signed(bucket), _signed(whole)], ["row", "start", "n", "bucket", "whole"])

    return mapped(texts, run, "row bigint, start int, n int, bucket bigint, whole bigint")


def shared_runs(found: DataFrame) -> DataFrame:
    """Runs that are equal to another (`same`) and one of each kind in mixed buckets (`kind`)."""
    bucket = Window.partitionBy("bucket")
    order = bucket.orderBy("whole")
    before, after = F.lag("whole").over(order), F.lead("whole").over(order)
    rows = found.withColumns({
        "before": before, "after": after,
        "mixed": F.min("whole").over(bucket) != F.max("whole").over(bucket)})
    return rows.select(
        "row", "start", "n", "bucket",
        (F.coalesce(F.col("before") == F.col("whole"), F.lit(False))
         | F.coalesce(F.col("after") == F.col("whole"), F.lit(False))).alias("same"),
        (F.col("mixed") & (F.col("before").isNull() | (F.col("before") != F.col("whole")))).alias("kind"),
    ).filter("same OR kind")


def names(data: np.ndarray, length: int, smallest: int) -> np.ndarray:
    """Names of the `length` bytes from each place on, by doubling from the smallest grams."""
    size = length
    while size % 2 == 0 and size > smallest:
        size //= 2
    places = len(data) - size + 1
    at = np.arange(max(places, 0))
    name = span_hashes(prefix_hashes(data), at, at + size)
    while size < length:
        name = mix(mix(name[:-size]) + name[size:])
        size *= 2
    return name


def refined_starts(texts: DataFrame, kinds: DataFrame, window: int) -> DataFrame:
    """(name, row, start, open) for every start of the runs that are kept."""
    lists = kinds.groupBy("row").agg(F.collect_list(F.struct("start", "n", "bucket", "same")).alias("runs"))
    joined = texts.join(lists.hint("merge"), "row").select("row", "runs", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            ends, items = np.asarray(lists.offsets), lists.values
            start, n, bucket = (items.field(i).to_numpy() for i in range(3))
            same = items.field(3).to_numpy(zero_copy_only=False)
            for lo, data, offsets in slices(unpack(batch.column(2))):
                name, out = names(data, window, SMALLEST), []
                for i in range(len(offsets) - 1):
                    mine = slice(ends[lo + i], ends[lo + i + 1])
                    count = n[mine]
                    local = np.repeat(start[mine] - (np.cumsum(count) - count), count) + np.arange(count.sum())
                    key = mix(name[local + offsets[i]] + np.repeat(bucket[mine], count).view(np.uint64))
                    out.append((np.full(len(local), lo + i), local, key, np.repeat(~same[mine], count)))
                row, local, key, open_ = (np.concatenate(c) for c in zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [_signed(key), batch.column(0).take(pa.array(row)), pa.array(local.astype(np.int32)),
                     pa.array(open_)], ["name", "row", "start", "open"])

    return mapped(joined, run, "name bigint, row bigint, start int, open boolean")


def repeated_starts(starts: DataFrame) -> DataFrame:
    """The open starts whose name another start has; rows come sorted by name, as a stream."""
    def emit(batch: pa.RecordBatch, shared: np.ndarray) -> pa.RecordBatch:
        keep = shared & batch.column(3).to_numpy(zero_copy_only=False)
        return batch.filter(pa.array(keep)).select(["row", "start"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held[0], batch]).combine_chunks().to_batches()[0]
            name = batch.column(0).to_numpy()
            equal = name[1:] == name[:-1]
            shared = np.zeros(len(name), bool)
            shared[1:] = equal
            shared[:-1] |= equal
            if held is not None:
                shared[0] |= held[1]
            # The last row waits for the next batch.
            yield emit(batch.slice(0, len(name) - 1), shared[:-1])
            held = batch.slice(len(name) - 1), bool(shared[-1])
        if held is not None:
            yield emit(held[0], np.array([held[1]]))

    return mapped(starts.repartition("name").sortWithinPartitions("name"), run, "row bigint, start int")


def cleaned(texts: DataFrame, marks: DataFrame, window: int, keep_text: bool,
            keep: tuple[str, ...] = ()) -> DataFrame:
    """Remove the marked starts' bytes: what is kept of each text, with counts."""
    passed = ["id", *keep]
    lists = marks.groupBy("row").agg(F.collect_list(F.struct("start", "n")).alias("marks"))
    joined = texts.join(lists.hint("merge"), "row", "left").select(*passed, "marks", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(passed)).fill_null([])
            ends, items = np.asarray(lists.offsets), lists.values
            start, n = (items.field(i).to_numpy() for i in range(2))
            for lo, data, offsets in slices(unpack(batch.column(len(passed) + 1))):
                out = []
                for i in range(len(offsets) - 1):
                    own = data[offsets[i]:offsets[i + 1]]
                    mine = slice(ends[lo + i], ends[lo + i + 1])
                    step = np.zeros(len(own) + 1, np.int32)
                    np.add.at(step, start[mine], 1)
                    np.add.at(step, np.minimum(start[mine] + n[mine] + window - 1, len(own)), -1)
                    gone = np.cumsum(step)[:-1] > 0
                    left = own[~gone].tobytes()
                    spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                    out.append((len(own), int(gone.sum()), spans, hashlib.sha256(left).hexdigest(),
                                left.decode("utf-8", "ignore") if keep_text else None))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays(
                    batch.slice(lo, len(out)).columns[:len(passed)] + [pa.array(c, t) for c, t in zip(zip(*out), kinds)],
                    [*passed, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])

    shape = "".join(f"`{c}` {joined.schema[c].dataType.simpleString()}, " for c in passed)
    return mapped(joined, run, shape + "n_bytes bigint, n_removed bigint, n_spans bigint, "
                                       "kept_sha256 string, kept_text string")


def remove_repeats(documents: DataFrame, doc_id: str = "doc_id", text: str = "text",
                   window: int = WINDOW, keep_text: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_text) for every row.

    The columns `keep` are passed on after doc_id. `window` is a multiple of 4. `kept_text` is null unless asked for; where a cut divides a
    character, the rest of the character is left out of it.
    """
    texts = documents.select(F.xxhash64(doc_id, text).alias("row"), F.col(doc_id).alias("id"),
                             *keep, F.col(text).alias("_text"))
    shared = materialize(shared_runs(initial_runs(texts.select("row", "_text"), window)), "runs")
    # Compressed once for each of the two shuffles; the texts themselves are read again.
    starts = refined_starts(pack(texts.select("row", "_text"), "_text"), shared.filter("kind"), window)
    single = repeated_starts(starts).select("row", "start", F.lit(1).alias("n"))
    marks = shared.filter("same").select("row", "start", "n").union(single)
    return cleaned(pack(texts, "_text"), marks, window, keep_text, keep).withColumnRenamed("id", doc_id)
