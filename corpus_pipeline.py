"""Corpus pipeline: language ID, near-duplicate removal, repeat removal, decontamination, tokens.

``STAGES`` lists (name, function); every function takes (spark, docs, sf_dir) and returns the rows that the next one works on. All but
the last return the columns of ``docs``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import bpe, decontaminate, jaccard_join, language, suffix_dedup
from tidemark.operators.distributed import materialize


def identified_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those without letters or with a narrow margin go."""
    learned = language.learn_dictionaries(docs.where(~language.held_out(F.col("doc_id"))))
    rows = docs.select(F.struct("*").alias("row"), language.identify(F.col("text"), learned).alias("found"))
    return rows.where("not found.rejected").select("row.*")


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of every component of near-duplicate links."""
    return jaccard_join.one_per_component(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of repeated 400-byte strings; a document goes only when nothing of it is left."""
    cut = suffix_dedup.remove_repeats(docs).where("n_removed = 0 or octet_length(kept) > 0")
    left = suffix_dedup.readable(F.when(F.col("n_removed") > 0, F.col("kept")))
    text = F.when(F.col("n_removed") == 0, F.col("row.text")).otherwise(left)
    columns = {c: F.col("row").getField(c) for c in docs.columns}
    columns |= {"text": text, "n_chars": F.char_length(F.coalesce(text, F.lit(""))).cast(docs.schema["n_chars"].dataType)}
    return cut.select(*[columns[c].alias(c) for c in docs.columns])


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    items = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    return decontaminate.without_contaminated(docs, items)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their ids, their number, and whether the ids decode to the text."""
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    rows = docs.select(F.struct("*").alias("row"), bpe.round_trip(spark, F.col("text"), ranks, public_tokenizers.PATTERN).alias("r"))
    same = F.col("r.decoded") == F.coalesce(F.col("row.text"), F.lit("")).cast("binary")
    return rows.select("row.*", F.size("r.ids").cast("long").alias("n_tokens"), F.col("r.ids").alias("token_ids"), same.alias("round_trip"))


STAGES = [
    ("language_id", identified_language),
    ("jaccard_join", without_near_duplicates),
    ("suffix_dedup", without_repeats),
    ("decontaminate", without_benchmark),
    ("byte_bpe", tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
