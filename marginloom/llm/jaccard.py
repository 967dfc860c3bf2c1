"""Jaccard join of documents on word shingles by parity sketches.

A document is the set of its distinct word shingles. A sketch counts set members by their hash, modulo
two: a member flips one bit. Flips of common members cancel, so the Hamming distance of two sketches is
at most the size of the symmetric difference. There are two sketches of a set:

* a wide one, cut into m blocks of 2**64 bits. It is never written out: a block is named by the XOR of
  the numbers of its bits, and by how many there are;
* a folded one of 1024 bits, which tells most pairs apart before any text is looked at.

Two sets with similarity t or more differ in at most D = (a + b)(1 - t)/(1 + t) members, so at most D
blocks differ. With m = D + 1 + s blocks, at least s + 1 blocks of a linked pair are equal. Every set
leaves out the s blocks with the fewest members, in one order for all sets: of the equal blocks of a
pair, the last in this order has s others before it, so neither side leaves it out. What is left out are
the empty and nearly empty blocks, which unrelated sets would share. m has to be the same on both sides,
so sizes are cut into bands. A band allows for the largest D of a pair whose smaller set lies in it; a
document writes its blocks for its own band and for every band below in which a smaller partner may lie.

Groups of any size stay linear:

* documents with the same set are one class from the start; links are between classes;
* a block shared by many classes gives the pairs (smallest class, other class) only. Map tasks do
  this for the rows they hold before anything is shuffled, then it is done for the rest;
* a pair goes on if the sizes and the folded sketches allow a link. Of each class, the pair with the
  nearest smaller class is verified on the texts first, then the other pairs between classes that are
  not in one component yet;
* then, in blocks whose classes are still in several components, a few hubs of each block's own are compared
  with the rest of the block;
* at last, in a block whose classes are still in several components, what is outside its largest component is
  compared with all of it where sizes and sketches allow a link. Large blocks are compared in pieces of
  bounded size. A linked pair shares a block, so no link between different components is lost.

Unusual rows: a null text, a text without words and an empty text have an empty set, are linked
with nothing and are a component of their own. Rows with a repeated id and equal text are one class.
A row with a null id belongs to its class like any other and links as any other, but never names a
component: `component_id` is null if no row of the component has an id.
Sets are identified by 64-bit hashes of their shingles, as are shingles by hashes of their words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginloom.llm.components import components
from marginloom.llm.packing import pack, sieve, unpack
from marginloom.llm.textscan import lower_ascii, mix, slices, word_hashes
from marginloom.llm.workers import mapped
from marginloom.session import materialize

BAND = 1.4
FOLD = 16  # words of 64 bits in a folded sketch
SKETCH = [f"s{k}" for k in range(FOLD)]
PIECE = 2048
HUB_PAIRS = 1000
HELD_KEYS = 1 << 19
HUBS = 3
TURNS = 1
ONE = np.uint64(1)


def shingle_sets(texts: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, sorted shingle hashes, offsets of the rows) for slices of a text column."""
    for lo, data, offsets in slices(texts):
        n_rows = len(offsets) - 1
        hashes, row = word_hashes(lower_ascii(data), offsets)
        count = np.bincount(row, minlength=n_rows)
        out = mix(hashes + np.uint64(width))
        for k in range(1, width):
            out[:-k] = mix(out[:-k] * np.uint64(0x9E3779B97F4A7C15) + hashes[k:])
        whole = np.ones(len(hashes), bool)
        for k in range(1, width):
            whole[len(hashes) - k:] = False
            whole[:-k] &= row[:-k] == row[k:]
        out, where = out[whole], row[whole]
        short = np.flatnonzero((count > 0) & (count < width))
        if len(short):
            first = np.cumsum(count) - count
            single = []
            for r in short:
                h = np.uint64(count[r])
                for word in hashes[first[r]:first[r] + count[r]]:
                    h = mix(np.array([h]) * np.uint64(31) + word)[0]
                single.append(h)
            out = np.concatenate([out, np.array(single, np.uint64)])
            where = np.concatenate([where, short])
        order = np.lexsort((out, where))
        out, where = out[order], where[order]
        new = np.ones(len(out), bool)
        new[1:] = (out[1:] != out[:-1]) | (where[1:] != where[:-1])
        out, where = out[new], where[new]
        yield lo, out, np.concatenate([[0], np.cumsum(np.bincount(where, minlength=n_rows))])


def set_id(members: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Hash of each set; 0 for the empty set."""
    total = np.zeros(len(offsets), np.uint64)
    mixed = np.concatenate([[np.uint64(0)], np.cumsum(mix(members * np.uint64(0xD6E8FEB86659FD93)))])
    total = mixed[offsets[1:]] - mixed[offsets[:-1]]
    size = np.diff(offsets).astype(np.uint64)
    return np.where(size > 0, mix(total + size * np.uint64(0xA24BAED4963EE407)), np.uint64(0))


def bands(sizes: np.ndarray) -> np.ndarray:
    return np.floor(np.log(np.maximum(sizes, 1)) / np.log(BAND) + 1e-9).astype(np.int64)


def differences(band: np.ndarray, threshold: float) -> np.ndarray:
    """D, the most members in which a linked pair whose smaller set has a size in the band may differ."""
    largest = np.ceil(BAND ** (band + 1.0)) + 1
    return np.floor(largest * (1 - threshold) / threshold + 1e-9).astype(np.int64)


def spare(most: np.ndarray) -> np.ndarray:
    """Blocks that are left out, for each D."""
    return most // 8 + 1


def sketch_keys(members: np.ndarray, offsets: np.ndarray, threshold: float
                ) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for every block of every sketch that a row writes."""
    sizes = np.diff(offsets)
    own = bands(sizes)
    rows, keys = [], []
    for shift in range(int(np.ceil(np.log(1 / threshold) / np.log(BAND) - 1e-9)) + 1):
        band = own - shift
        # The smaller partner has at least threshold * size members.
        use = (sizes > 0) & ((shift == 0) | (bands(np.ceil(sizes * threshold - 1e-9)) <= band))
        most = np.where(use, differences(band, threshold), 0)
        # Where nothing may differ, linked sets are one class already.
        m = np.where(most > 0, most + 1 + spare(most), 0)
        start = np.cumsum(m) - m
        row = np.repeat(np.arange(len(sizes)), sizes)
        keep = m[row] > 0
        row, x = row[keep], members[keep]
        if not len(row):
            continue
        slot = start[row] + ((x >> np.uint64(6)) % m[row].astype(np.uint64)).astype(np.int64)
        sketch = np.zeros(int(m.sum()), np.uint64)
        np.bitwise_xor.at(sketch, slot, mix(x + ONE))
        held = np.bincount(slot, minlength=len(sketch))
        owner = np.repeat(np.arange(len(sizes)), m)
        number = (np.arange(len(sketch)) - start[owner]).astype(np.uint64)
        key = mix(sketch * np.uint64(0x9E3779B97F4A7C15) + mix(
            (number * np.uint64(4096) + band[owner].astype(np.uint64) + ONE) * np.uint64(1 << 20)
            + held.astype(np.uint64)))
        order = np.lexsort((key, held, owner))
        written = np.arange(len(order)) - start[owner] >= spare(most)[owner]
        rows.append(owner[written])
        keys.append(key[order][written])
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(rows), np.concatenate(keys)


def fold(members: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Folded parity sketch of each row, as FOLD columns."""
    out = np.zeros((len(offsets) - 1, FOLD), np.uint64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    word = ((members >> np.uint64(20)) % np.uint64(FOLD)).astype(np.int64)
    np.bitwise_xor.at(out, (row, word), ONE << (members & np.uint64(63)))
    return out


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def hub_pairs(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, ...]:
    """(key, hub) of each key, and (key, hub, node) of its other distinct rows."""
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    hub = np.repeat(node[first], np.diff(np.append(np.flatnonzero(first), len(key))))
    other = (hub != node) & np.append(True, (key[1:] != key[:-1]) | (node[1:] != node[:-1]))[:len(key)]
    return key[first], node[first], key[other], hub[other], node[other]


def set_rows(documents: DataFrame, width: int, text: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, n, node, s0, s1, ...): size, class and folded sketch of every row's set, after the columns `keep`."""
    names = [*keep, "id", "n", "node", *SKETCH]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            node = np.zeros(batch.num_rows, np.uint64)
            sketch = np.zeros((batch.num_rows, FOLD), np.uint64)
            for lo, members, offsets in shingle_sets(batch.column(len(keep) + 1), width):
                some = slice(lo, lo + len(offsets) - 1)
                n[some], node[some] = np.diff(offsets), set_id(members, offsets)
                sketch[some] = fold(members, offsets)
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep) + 1], pa.array(n), _signed(node), *[
                _signed(sketch[:, k]) for k in range(FOLD)]], names)

    kept = [f"`{c}` {documents.schema[c].dataType.simpleString()}, " for c in keep]
    return mapped(documents.select(*keep, "id", text), run, "".join(kept) + ", ".join(
        f"{c} bigint" for c in names[len(keep):]))


def key_rows(documents: DataFrame, width: int, threshold: float, text: str) -> DataFrame:
    """(key, node, other): the task's hub of each key, and each other class that the task has for it."""
    def rows(found: list[np.ndarray], nodes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, hub, *rest = hub_pairs(np.concatenate(found), np.concatenate(nodes).view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [_signed(key), pa.array(hub), pa.nulls(len(hub), pa.int64())], ["key", "node", "other"])
        yield pa.RecordBatch.from_arrays(
            [_signed(rest[0]), pa.array(rest[1]), pa.array(rest[2])], ["key", "node", "other"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Keys of several batches are held, so that a task has few hubs for a frequent key.
        found, nodes, held = [], [], 0
        for batch in batches:
            for _, members, offsets in shingle_sets(batch.column(0), width):
                row, key = sketch_keys(members, offsets, threshold)
                found.append(key)
                nodes.append(set_id(members, offsets)[row])
                held += len(key)
                if held >= HELD_KEYS:
                    yield from rows(found, nodes)
                    found, nodes, held = [], [], 0
        if found:
            yield from rows(found, nodes)

    return mapped(documents.select(text), run, "key bigint, node bigint, other bigint")


def shared_blocks(keys: DataFrame) -> DataFrame:
    """(key, a, b) for the blocks of several classes: a smaller class a and each other class b of a block.

    Rows arrive sorted by key and are read as a stream; a group is never held.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key = last_hub = None
        for batch in batches:
            known = batch.filter(batch.column(2).is_valid())
            rows = [pd.DataFrame({"key": known.column(0).to_numpy(), "a": known.column(1).to_numpy(),
                                  "b": known.column(2).to_numpy()})]
            batch = batch.filter(batch.column(2).is_null())
            if batch.num_rows:
                key, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                first = np.ones(len(key), bool)
                first[1:] = key[1:] != key[:-1]
                start = np.flatnonzero(first)
                hubs = node[start]
                if last_key is not None and key[0] == last_key:
                    hubs[0] = last_hub
                hub = np.repeat(hubs, np.diff(np.append(start, len(key))))
                last_key, last_hub = key[-1], hubs[-1]
                keep = hub != node
                rows.append(pd.DataFrame({"key": key[keep], "a": hub[keep], "b": node[keep]}))
            yield pa.RecordBatch.from_pandas(pd.concat(rows).drop_duplicates(), preserve_index=False)

    # Hashed keys spread evenly: of each key a task writes its hub only, the others go where there is room.
    spread = F.when(F.col("other").isNull(), F.col("key")).otherwise(F.xxhash64("key", "other"))
    return mapped(keys.repartition(spread).sortWithinPartitions("key", "node"), run,
                  "key bigint, a bigint, b bigint")


def class_rows(rows: DataFrame) -> DataFrame:
    """(node, n, at, s0, s1, ...): one row of each class; `at` tells where its text stands."""
    return rows.filter("n > 0").groupBy("node").agg(F.max("n").alias("n"), F.min("at").alias("at"), *[
        F.max(c).alias(c) for c in SKETCH])


def sides(pair: str) -> list:
    return [F.col(c).alias(f"{c}_{pair}") for c in ("n", *SKETCH)]


def apart() -> tuple:
    """(Hamming distance of the folded sketches, sum of the sizes) of a pair with both `sides`."""
    distance = sum(F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in SKETCH)
    return distance, F.col("n_a") + F.col("n_b")


def may_link(threshold: float):
    """Whether sizes and folded sketches allow a link."""
    distance, total = apart()
    return (F.col("n_b") * threshold <= F.col("n_a") + 1e-6) & (F.col("n_a") * threshold <= F.col("n_b") + 1e-6) & (
        distance <= total * (1 - threshold) / (1 + threshold) + 1e-6)


def near_pairs(blocks: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """(a, b, distance) for the pairs of the blocks that may be linked."""
    out = blocks.select("a", "b").distinct()
    for end in ("a", "b"):
        out = out.join(classes.select(F.col("node").alias(end), *sides(end)), end)
    return out.filter(may_link(threshold)).select("a", "b", apart()[0].alias("distance"))


def compared(documents: DataFrame, classes: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union, by the shingles of their texts.

    The text of `a` is sent ahead of the texts compared with it; all pass as a stream. Pairs with a
    frequent `a` are spread over several such streams. Compressed texts are shuffled, not
    shingles, which are larger.
    """
    load = pairs.groupBy("a").agg(F.ceil(F.count("*") / HUB_PAIRS).cast("int").alias("streams"))
    ahead = load.select(F.col("a").alias("node"), F.col("a").alias("hub"), F.explode(
        F.sequence(F.lit(0), F.col("streams") - 1)).alias("stream"), F.lit(0).alias("place"))
    behind = pairs.join(load, "a").select(
        F.col("b").alias("node"), F.col("a").alias("hub"),
        F.pmod(F.xxhash64("b"), F.col("streams")).cast("int").alias("stream"), F.lit(1).alias("place"))
    wanted = materialize(ahead.union(behind).join(classes.select("node", "at"), "node"), "wanted")
    # Most texts are not wanted by anyone; few of them pass.
    texts = pack(documents.select("at", "_text"), "_text", key="at", wanted=sieve(wanted, "at"))
    streams = wanted.join(texts.hint("merge"), "at").select("hub", "stream", "place", "node", "_text").repartition(
        "hub", "stream").sortWithinPartitions("hub", "stream", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = lead_members = None
        for batch in batches:
            hub, place, node = (batch.column(i).to_numpy() for i in (0, 2, 3))
            out = []
            for lo, members, offsets in shingle_sets(unpack(batch.column(4)), width):
                same = set_id(members, offsets).view(np.int64) == node[lo:lo + len(offsets) - 1]
                for i in np.flatnonzero(same):
                    x = members[offsets[i]:offsets[i + 1]]
                    if place[lo + i] == 0:
                        lead, lead_members = hub[lo + i], x
                    elif lead == hub[lo + i]:
                        common = len(np.intersect1d(x, lead_members, assume_unique=True))
                        if 100 * common >= percent * (len(x) + len(lead_members) - common):
                            out.append((lead, node[lo + i]))
            columns = list(zip(*out)) if out else [[]] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b"])

    return mapped(streams, run, "a bigint, b bigint")


def rooted(df: DataFrame, roots: DataFrame, node: str, root: str) -> DataFrame:
    """With the root of a node as a column; a node without links is its own root."""
    found = roots.select(F.col("node").alias(node), F.col("root").alias(root))
    return df.join(found, node, "left").withColumn(root, F.coalesce(root, node))


def hubs_in_turn(blocks: DataFrame, classes: DataFrame, roots: DataFrame, threshold: float, turn: int) -> DataFrame:
    """Pairs (a, b) of a few classes of each open block, others in each block, with the rest of the block.

    Near copies share most of their blocks, and the smallest class of all of them is one and the same. With hubs
    that change from block to block, their components join here at a cost that is linear in the blocks.
    """
    members = blocks.select("key", F.explode(F.array("a", "b")).alias("node")).distinct()
    rows = materialize(rooted(members, roots, "node", "root"), "members")
    turns = [F.min(F.struct(F.xxhash64("key", "node", F.lit(turn * HUBS + k)).alias("turn"), "node", "root")) for k in range(HUBS)]
    hubs = rows.groupBy("key").agg(F.array_distinct(F.array(*turns)).alias("hubs"), F.min("root").alias("low"), F.max(
        "root").alias("high"), F.count("*").alias("all")).filter("low < high AND all > 2").select(
        "key", F.explode("hubs").alias("hub"))
    pairs = rows.join(hubs, "key").filter(F.col("root") != F.col("hub.root")).select(
        F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b"))
    return near_pairs(pairs, classes, threshold).select("a", "b")


def across(blocks: DataFrame, classes: DataFrame, roots: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) that share a block, are in different components, and whose sketches allow a link.

    In a block, only classes outside its largest component are compared with all of it; a block of two
    classes is one pair, which is known. Both sides are cut into pieces of bounded size that meet in pairs.
    """
    members = blocks.select("key", F.explode(F.array("a", "b")).alias("node")).distinct()
    rows = rooted(members, roots, "node", "root")
    size = rows.groupBy("key", "root").agg(F.count("*").alias("m")).groupBy("key").agg(
        F.max_by("root", F.struct("m", "root")).alias("main"), F.sum("m").alias("all"),
        (F.sum("m") - F.max("m")).alias("rest")).filter("rest > 0 AND all > 2").select(
        "key", "main", F.ceil(F.col("all") / PIECE).cast("int").alias("all_pieces"),
        F.ceil(F.col("rest") / PIECE).cast("int").alias("rest_pieces"))
    rows = materialize(rows.join(size, "key").join(classes.drop("at"), "node"), "open")
    place = F.pmod(F.xxhash64("node"), F.lit(1 << 20))
    ours = rows.filter("root <> main").select(
        "key", F.pmod(place, "rest_pieces").alias("i"), F.explode(F.sequence(
            F.lit(0), F.col("all_pieces") - 1)).alias("j"), F.col("node").alias("a"), "root", *sides("a"))
    theirs = rows.select(
        "key", F.explode(F.sequence(F.lit(0), F.col("rest_pieces") - 1)).alias("i"), F.pmod(
            place, "all_pieces").alias("j"), F.col("node").alias("b"), F.col("root").alias("root2"), *sides("b"))
    return ours.join(theirs, ["key", "i", "j"]).filter((F.col("root") != F.col("root2")) & may_link(threshold)).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def grouped(documents: DataFrame, percent: int = 90, width: int = 3, doc_id: str = "doc_id",
            text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, n, root) for every row of the documents, with the columns `keep`.

    Rows with the same `root` are connected; rows without words have the root 0 and are not.
    """
    threshold = percent / 100
    documents = documents.select(*keep, F.col(doc_id).cast("long").alias("id"), F.col(text).alias("_text"))
    documents = documents.withColumn("at", F.xxhash64("id", "_text"))
    rows = materialize(set_rows(documents, width, "_text", (*keep, "at")), "sets")
    blocks = materialize(shared_blocks(key_rows(documents, width, threshold, "_text")), "blocks")
    classes = materialize(class_rows(rows), "classes")
    near = materialize(near_pairs(blocks, classes, threshold), "near")
    best = materialize(near.groupBy("b").agg(F.min(F.struct("distance", "a")).alias("first")).select(
        "first.a", "b"), "nearest")
    roots = classes.select("node", F.col("node").alias("root"))
    # First the nearest pair of each class, then the other pairs that may join components. Only blocks
    # that are open after these are compared further: with hubs of their own, then by all that is left.
    tried = near.select("a", "b")
    steps = [lambda: best, lambda: apart_still(tried.join(best, ["a", "b"], "left_anti"), roots)]
    steps += [lambda turn=turn: hubs_in_turn(blocks, classes, roots, threshold, turn).join(
        tried, ["a", "b"], "left_anti") for turn in range(TURNS)]
    steps.append(lambda: across(blocks, classes, roots, threshold).join(tried, ["a", "b"], "left_anti"))
    for k, step in enumerate(steps):
        wanted = materialize(step(), "pairs")
        if k > 1:
            tried = tried.union(wanted)
        if not wanted.isEmpty():
            # Stored, so that comparing and contracting do not keep Python workers at the same time.
            links = materialize(compared(documents, classes, wanted, width, percent), "links")
            roots = merged(roots, links)
    return rows.join(roots, "node", "left").select(*keep, "id", "n", F.coalesce("root", "node").alias("root"))


def near_duplicates(documents: DataFrame, percent: int = 90, width: int = 3, doc_id: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of the documents."""
    return named(grouped(documents, percent, width, doc_id, text), doc_id)


def survivors(rows: DataFrame, key: str) -> DataFrame:
    """(key, n) of the rows that stay: one of each component, and all without words.

    `rows` is what `grouped` gives with a row key. The smallest id stays, null after all others, and
    of rows with that id the one with the smallest key.
    """
    first = F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", key)).alias("first")
    return rows.groupBy("root", F.when(F.col("n") == 0, F.col(key)).alias("alone")).agg(
        first, F.max("n").alias("n")).select(f"first.{key}", "n")


def apart_still(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes in different components."""
    return rooted(rooted(pairs, roots, "a", "ra"), roots, "b", "rb").filter("ra <> rb").select("a", "b")


def merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """The roots (node, root) after links (a, b) have joined components."""
    joins = rooted(rooted(links, roots, "a", "ra"), roots, "b", "rb").filter("ra <> rb").select(
        F.col("ra").alias("a"), F.col("rb").alias("b")).distinct()
    top = components(joins).select(F.col("node").alias("root"), F.col("root").alias("top"))
    return materialize(roots.join(top, "root", "left").select(
        "node", F.coalesce("top", "root").alias("root")), "roots")


def named(labelled: DataFrame, doc_id: str) -> DataFrame:
    """Give every row the smallest id of its component."""
    smallest = labelled.filter("n > 0").groupBy("root").agg(F.min("id").alias("component_id"))
    out = labelled.filter("n > 0").join(smallest, "root").select("id", "n", "component_id")
    empty = labelled.filter("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return out.union(empty).select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), "component_id")
