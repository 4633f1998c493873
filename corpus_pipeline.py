"""A document pipeline of five stages, each written as Parquet and read again as the next one's documents.

Every stage but the last returns the columns of ``documents``. Defined cases, which the operators' own cases follow: rows
without an id pass the stages that compare documents; a null or empty text is scored like any other, has no n-grams, words
or tokens, and stays unless its score is low; of equal texts the smallest id stays, and repeated rows with one id all stay; a
very long text is one row in every stage; an empty table gives an empty one; of labels and benchmark, rows with nulls play no
part and repeated rows count again or once, as the operators say; extra columns, also of clashing names, stay to the last stage.
SQL cannot express the learned first stage, so the whole has no SQL; the tests hold each stage against a brute-force version.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, jaccard, quality, substring
from tessera.llm.storage import Scratch, release_shuffles


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of 0.3 at least."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.fit_sample(docs, labels), 0.3)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return jaccard.keep_one(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 20 words or more that start earlier elsewhere; n_chars follows the text."""
    return substring.cleaned(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids_sha256 and decoded_sha256 (of the bytes decoded from the ids)."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    found = bpe.encode(docs, path, public_tokenizers.PATTERN)
    found = found.select("doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids_sha256", bpe.decoded("ids", path).alias("bytes"))
    return found.select("doc_id", "lang", "source", "n_tokens", "ids_sha256", F.sha2("bytes", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", quality_stage),
    ("ngram_jaccard", jaccard_stage),
    ("substring_dedup", substring_stage),
    ("decontamination", decontamination_stage),
    ("byte_bpe", tokens_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        with Scratch() as scratch:  # what a stage writes on its way goes with it
            kept = scratch.result(stage(spark, docs, sf_dir), f"stage-{name}")
        docs = kept.df
        release_shuffles(spark)
        if before:
            before.drop()
        before = kept
    return docs
