"""A corpus pipeline of five stages, each one operator over all documents that are left.

Every stage is a function of (spark, documents, folder). `run` applies them in order; each result is
written as Parquet to the shared work folder and read again, so a lost executor costs one stage.
No stage finds its rows again by doc_id, which may be null or repeated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginloom.llm import bpe, jaccard, language, mixing, suffixes
from marginloom.llm.queries import table, vocabulary
from marginloom.llm.rows import emitted, row_key, single_rows
from marginloom.session import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Drop documents whose language is rejected; the others get the language found."""
    found = language.identify(docs.select(*COLUMNS), ["doc_id", "text", "source", "n_chars"])
    return found.filter("accepted").select(
        "doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near duplicates; null is the last.

    Of documents with that id one stays. Documents without words are nobody's duplicates. The
    pipeline takes five words and a similarity of 0.8.
    """
    keyed = docs.select(row_key(*COLUMNS).alias("row"), *COLUMNS)
    found = jaccard.grouped(keyed, percent=80, width=5, keep=("row",))
    kept = single_rows(keyed, "row", "_equal").join(jaccard.survivors(found, "row").hint("merge"), "row")
    return emitted(kept, F.when(F.col("n") == 0, F.col("_equal")).otherwise(1), COLUMNS)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Cut byte strings that stand elsewhere too; documents of which nothing is left go."""
    kept = suffixes.remove_repeats(docs.select("doc_id", "text", "lang", "source"), keep_text=True,
                                   keep=("lang", "source")).filter("kept_text <> ''")
    return kept.select("doc_id", F.col("kept_text").alias("text"), "lang", "source",
                       F.char_length("kept_text").cast("long").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Take documents, some of them twice, until each source has its share."""
    docs = docs.select(*COLUMNS)
    return mixing.repeat_rows(docs, mixing.document_mix(docs))


def encode(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token ids of every document, and digests of the ids and of the text that they decode to."""
    coded = bpe.encode_documents(docs.select("doc_id", "lang", "source", "text"), vocabulary())
    return coded.select("doc_id", "lang", "source", "n_tokens", "token_ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", drop_repeated_passages),
    ("mix_sources", mix_sources),
    ("bpe_encode", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
