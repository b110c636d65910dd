"""The corpus pipeline: five stages, each over all documents that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs.
All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import byte_bpe, decontaminate, minhash, quality, suffix_dedup
from quire.session import cleaned, scratch, shared_dir, table, unused

RANKS = "byte_bpe_50k.tiktoken"


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents that it rejects go."""
    shared_dir(spark)
    return quality.accepted(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup on five-word shingles at a similarity of 0.8: the smallest id of each group stays.

    Rows are judged by id and text, so an id that repeats with other texts is several documents; of equal rows one stays.
    """
    shared_dir(spark)
    return minhash.one_of_each(docs, size=5, percent=80)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Suffix-array dedup: byte strings that an earlier document holds are cut out; what a cut leaves of a character goes too."""
    kept, starts = unused("kept", docs), unused("span_starts", docs)
    cut = suffix_dedup.deduplicated(docs, kept=kept, span_starts=starts, span_ends=unused("span_ends", docs))
    changed = F.size(starts) > 0
    # invalid bytes at a cut become U+FFFD; where the text had none they are dropped
    text = F.call_function("make_valid_utf8", F.col(kept).cast("string"))
    text = F.when(F.contains(F.col("text"), F.lit("�")), text).otherwise(F.replace(text, F.lit("�"), F.lit("")))
    new = F.when(changed, text).otherwise(F.col("text"))
    out = cut.withColumn("text", new)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE: doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document that is left."""
    return byte_bpe.digests(docs, byte_bpe.read_ranks(public_tokenizers.path(RANKS)), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_documents),
    ("near-dedup", one_of_each_group),
    ("suffix-dedup", without_repeats),
    ("decontaminate", without_benchmark),
    ("byte-bpe", encoded),
]

#: No SQL can say what a trained scorer keeps; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from documents; each stage's rows are written to the shared folder and read again, and what else a stage wrote is removed."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        with cleaned(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
