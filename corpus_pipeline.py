"""A training corpus from documents: five stages, each a written table for the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from netstate.llm import decontaminate, language, line_dedup, near_copies, packing, simhash
from netstate.llm.common import cut_lineage, small_batches
from netstate.llm.queries import END_ID, vocabulary

#: The share its main language must have in a document that stays.
MIN_LANGUAGE_SHARE = 0.3
#: Chunks of text whose ids a worker keeps: the stages before leave the executor little memory.
KEPT_CHUNKS = 50_000


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without letters and those in which no language has a fair share."""
    small_batches(spark)
    found = language.identify(docs, language.fit(docs), into="__language")
    return found.where(
        (F.col("__language.lang") != language.UNKNOWN)
        & (F.col("__language.score") >= MIN_LANGUAGE_SHARE)).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop repeated lines from texts; a text of which nothing stays is empty."""
    kept = line_dedup.dedup_lines(docs)
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near copies: texts whose
    five-word shingles have a Jaccard similarity of 0.8 or more.

    Operator 9 names pairs by their fingerprints (three or fewer differing bits), an exact
    check of similarity follows; bands of MinHashes name those that fingerprints miss.
    Rows without a doc_id stay; of rows that share a doc_id one stays.
    """
    small_batches(spark)
    linked = simhash.near_duplicates(docs).where("doc_id != component_id").select(
        F.col("doc_id").alias("a"), F.col("component_id").alias("b"))
    groups = near_copies.near_copies(docs, linked)
    gone = groups.where("doc_id != component_id").select(
        F.col("doc_id").alias("__gone")).distinct()
    named = docs.where("doc_id is not null")
    kept = named.join(gone.hint("merge"), F.col("doc_id") == F.col("__gone"), "left_anti")
    kept = kept.dropDuplicates(["doc_id"])
    return kept.unionByName(docs.where("doc_id is null")).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a passage of a benchmark item."""
    small_batches(spark)
    benchmark = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    found = decontaminate.benchmark_hits(docs, benchmark, into="__hits")
    return found.where(F.col("__hits.n_hit") == 0).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces, each with its place in a sequence."""
    small_batches(spark)
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), END_ID, kept_chunks=KEPT_CHUNKS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: Language prediction and tokenizers can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
