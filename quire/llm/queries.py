"""The ten operators as queries over the driver's tables, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import byte_bpe, decontaminate, license_scan, minhash, nearest, quality, suffix_dedup, toxicity, url_filter, warc
from quire.session import table

RANKS = "byte_bpe_50k.tiktoken"
#: (verdict, host with path). Fixed values.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score, from weak labels alone."""
    return quality.judged(table(spark, sf_dir, "documents"))


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest rows of each row of embeddings whose vec_id is divisible by 100."""
    return nearest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


def op3_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence of each entire document, and the licences that its lines name."""
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 50-byte strings of documents before it."""
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through a WARC archive and back."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded."""
    return byte_bpe.digests(table(spark, sf_dir, "documents"), byte_bpe.read_ranks(public_tokenizers.path(RANKS)), public_tokenizers.PATTERN)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that documents hold."""
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, rule and verdict, with its host's trust and distrust to nine places."""
    return url_filter.judged(table(spark, sf_dir, "pages"), RULES).withColumns({c: F.round(c, 9) for c in ("trust", "distrust")})


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates on two-word shingles."""
    return minhash.components(table(spark, sf_dir, "documents"), size=2, percent=80)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learnt from the labelled rows that aren't held out."""
    return toxicity.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_nearest": op2_nearest,
    "op3_license": op3_license,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_warc": op5_warc,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_decontaminate": op7_decontaminate,
    "op8_url_filter": op8_url_filter,
    "op9_minhash": op9_minhash,
    "op10_toxicity": op10_toxicity,
}

ORACLE_SQL: dict[str, str] = {
    "op2_nearest": """
    WITH v AS (
        SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
          AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    d AS (SELECT q.vec_id AS query_id, v.vec_id, list_distance(q.e, v.e) AS score
          FROM v q JOIN v ON q.vec_id <> v.vec_id AND len(q.e) = len(v.e) WHERE q.vec_id % 100 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INTEGER AS rank FROM d)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op3_license": license_scan.oracle_sql(),
    "op8_url_filter": url_filter.oracle_sql(RULES),
    "op5_warc": """
    WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
    d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS payload_digest, b FROM p),
    m AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY b) ELSE page_id END AS keeper FROM d)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN keeper = page_id OR keeper IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN keeper = page_id OR keeper IS NULL THEN NULL ELSE keeper END AS refers_to
    FROM m""",
}
