"""Language identification by compression.

For every language a zstandard dictionary is made of raw sample text. A text is cut into blocks,
each block is compressed with every dictionary, and the sizes of the blocks are summed: the
language whose dictionary gives the fewest bytes wins. Blocks keep long texts from learning their
own vocabulary, after which all dictionaries would do equally well.

The margin (second best - best) / second best is the score; below `MARGIN` the text is rejected.
Of languages with equal sizes, the one with more labelled rows is named; as the margin is 0 then, the
text is rejected. Texts are compared in lower case.
A text that is null or has no letter is `und` with score 0 and is rejected.

Samples are bounded: at most `SAMPLE_BYTES` of text for a language, taken from the rows with the
smallest hashes of their text, so that the model is the same on every run and does not depend on
the partitioning. Languages are few (labels of the data); the model is that many samples.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginloom.llm.workers import mapped

SAMPLE_BYTES = 64 * 1024
SAMPLE_ROWS = 256
CHARS_PER_ROW = 1024
BLOCK = 2048
MARGIN = 0.001
UNDETERMINED = "und"


def samples(labelled: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, bytes]:
    """Raw dictionary content per language, at most SAMPLE_BYTES each; frequent languages first."""
    labelled = labelled.filter(F.col(lang).isNotNull())
    rows = labelled.filter(F.col(text).rlike(r"\p{L}")).select(
        F.col(lang).alias("lang"), F.xxhash64(text).alias("h"),
        F.lower(F.substring(text, 1, CHARS_PER_ROW)).alias("t"))
    # The smallest hashes of each language; the limit prunes in every task before the shuffle.
    first = F.row_number().over(Window.partitionBy("lang").orderBy("h", "t"))
    chosen = rows.dropDuplicates(["lang", "h"]).withColumn("n", first).filter(
        F.col("n") <= SAMPLE_ROWS).orderBy("lang", "n").collect()
    out: dict[str, bytes] = {}
    for r in chosen:
        have = out.setdefault(r["lang"], b"")
        if len(have) < SAMPLE_BYTES:
            out[r["lang"]] = (r["t"].encode() + b"\n" + have)[-SAMPLE_BYTES:]
    often = {r[0]: r[1] for r in labelled.groupBy(lang).count().collect()}
    return dict(sorted(out.items(), key=lambda x: (-often[x[0]], x[0])))


class Classifier:
    """Compressors by language. Digested once in every Python worker that uses it."""

    def __init__(self, content: dict[str, bytes]):
        self.langs = list(content)
        self.compressors = []
        params = zstandard.ZstdCompressionParameters.from_level(
            5, min_match=4, strategy=zstandard.STRATEGY_GREEDY, window_log=17,
            write_content_size=False, write_checksum=False, write_dict_id=False)
        for lang in self.langs:
            raw = zstandard.ZstdCompressionDict(content[lang],
                                                dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(compression_params=params)
            self.compressors.append(zstandard.ZstdCompressor(
                dict_data=raw, compression_params=params).compress)

    def predict(self, text: str) -> tuple[str, float]:
        if len(self.langs) < 2:
            return (self.langs[0], 1.0) if self.langs else (UNDETERMINED, 0.0)
        data = text.lower().encode()
        blocks = [data[i:i + BLOCK] for i in range(0, len(data), BLOCK)]
        sizes = sorted((sum([len(c(b)) for b in blocks]), k) for k, c in enumerate(self.compressors))
        (best, k), (second, _) = sizes[:2]
        return self.langs[k], (second - best) / second


_made: dict[int, Classifier] = {}


def classify(documents: DataFrame, content: dict[str, bytes], keep: list[str],
             text: str = "text", margin: float = MARGIN) -> DataFrame:
    """The columns `keep` with lang_pred, score and accepted for every row."""
    broadcast = documents.sparkSession.sparkContext.broadcast(content)
    fields = [f for f in documents.schema.fields if f.name in keep]
    inner = documents.select(*keep, F.col(text).alias("_text"),
                             F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("_letters"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = id(broadcast.value)
        if key not in _made:
            _made.clear()
            _made[key] = Classifier(broadcast.value)
        model = _made[key]
        for batch in batches:
            got = [model.predict(t) if ok else (UNDETERMINED, 0.0) for t, ok in zip(
                batch.column(len(keep)).to_pylist(), batch.column(len(keep) + 1).to_pylist())]
            columns = [batch.column(i) for i in range(len(keep))]
            columns += [pa.array([g[0] for g in got], pa.string()),
                        pa.array([float(g[1]) for g in got], pa.float64()),
                        pa.array([g[0] != UNDETERMINED and g[1] >= margin for g in got], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, [*keep, "lang_pred", "score", "accepted"])

    shape = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields]
                      + ["lang_pred string", "score double", "accepted boolean"])
    return mapped(inner, run, shape)


def held_out(doc_id: str = "doc_id"):
    """True for the rows that nothing is learned from: crc32 of the id as text divides by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def identify(documents: DataFrame, keep: list[str]) -> DataFrame:
    """Learn from the rows that are not held out and classify all."""
    content = samples(documents.filter(~held_out()))
    return classify(documents, content, keep)
