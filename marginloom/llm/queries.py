"""The queries of this package: each applies one operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginloom.llm import (bpe, chat, jaccard, language, mixing, periods, sequences, sharding, spelling, suffixes,
                            topk, toxicity, vectors)
from marginloom.llm.shipping import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query()
def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.train(documents, table(spark, folder, "labels"), ~language.held_out(), "toxic")
    return toxicity.score(documents, model).select(
        "doc_id", language.held_out().alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query()
def op2_repeated_bytes(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, folder, "documents").select("doc_id", "text")).drop("kept_text")


@query()
def op3_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.document_mix(table(spark, folder, "documents"), keyed=False)
    return mixed.select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


@query()
def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    found = language.identify(documents.select("doc_id", "text", "lang"), ["doc_id"])
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score", "accepted")


@query()
def op5_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(
        F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    turns = chat.format_turns(rows.withColumn("parts", chat.text_part(F.col("text"))))
    return chat.read_back(turns, "conv_id", ["turn", "role", "text"])


TOP_K_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, x -> CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS c
  FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
   AND len(list_filter(embedding, x -> x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, x.vec_id,
  CAST(list_dot_product(CAST(q.c AS DOUBLE[]), CAST(x.c AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v x ON q.vec_id <> x.vec_id AND len(q.c) = len(x.c) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (
  PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5"""


@query(TOP_K_SQL)
def op6_pivot_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0, "vec_id", "embedding")


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query()
def op7_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode_documents(table(spark, folder, "documents").select("doc_id", "text"),
                                vocabulary(), ids=False)


@query()
def op8_kd_shards(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_documents(table(spark, folder, "documents").select("doc_id", "text"))


@query()
def op9_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))


@query()
def op10_subspace_join(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, folder, "embeddings").select("vec_id", "embedding"))


@query()
def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.spelling_groups(table(spark, folder, "documents").select("doc_id", "text"))


@query()
def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = periods.periodic_runs(table(spark, folder, "documents"), replaced=periods.planted)
    # Exponents are compared as fractions; the runs are in ascending order of start and period.
    best = F.expr("""array_sort(runs, (a, b) -> CASE
        WHEN a.length * b.period <> b.length * a.period THEN sign(b.length * a.period - a.length * b.period)
        WHEN a.start <> b.start THEN sign(a.start - b.start) ELSE sign(a.period - b.period) END :: int)""")
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return found.withColumn("best", F.get(best, F.lit(0))).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", F.transform(lines, lambda x: F.concat(x, F.lit("\n")))), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query()
def op13_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = sequences.pack_documents(table(spark, folder, "documents"), vocabulary("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("token_ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")
