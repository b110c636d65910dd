"""Collections: documents, postings, lexicon and document weights as DataFrames.

A build is one shuffle by (term, document), one by term and one by document. Terms of a document are counted before
they are shuffled (partial aggregates), so a frequent term costs a row a document, and the lexicon's join splits hot terms.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions import analysis, stem
from quire.session import unused, written

Endings = tuple[tuple[str, str], ...]


@dataclass(frozen=True)
class Collection:
    """docs(docnum, text), postings(term, docnum, f_dt), lexicon(term, f_t, cf_t), weights(docnum, w), meta(n_docs, n_words, n_bytes).

    ``endings`` are those that terms are stemmed by, if they are (see ``functions.stem``).
    """

    docs: DataFrame
    postings: DataFrame
    lexicon: DataFrame
    weights: DataFrame
    meta: DataFrame
    fold: bool = True
    markup: bool = False
    endings: Endings = ()

    TABLES = ("docs", "postings", "lexicon", "weights", "meta")

    @classmethod
    def open(cls, spark: SparkSession, path: str, *, last: int | None = None, **options: object) -> Collection:
        """The tables under ``path`` up to the last batch that was finished, or up to ``last``; options as in ``build``."""
        meta = spark.read.parquet(f"{path}/meta")
        last = meta.agg(F.max("batch")).first()[0] if last is None else last
        read = lambda name: spark.read.parquet(f"{path}/{name}").where(F.col("batch") <= last).drop("batch")
        words = read("lexicon")
        if last:  # each batch has its own counts; a filter on terms still reaches the scan
            words = words.groupBy("term").agg(F.sum("f_t").alias("f_t"), F.sum("cf_t").alias("cf_t"))
        return cls(read("docs"), read("postings"), words, read("weights"), meta.where(F.col("batch") == last).drop("batch"), **options)

    def indexed(self, docs: DataFrame) -> DataFrame:
        """The postings of other documents, analysed as this collection's are."""
        return postings(docs, fold=self.fold, markup=self.markup, endings=self.endings)

    def query_terms(self, words: list[str]) -> list[str]:
        """Words as the lexicon has them."""
        words = [w.lower() if self.fold else w for w in words]
        return [stem.stemmed(w, self.endings) for w in words] if self.endings else words


def numbered(docs: DataFrame, key: str) -> DataFrame:
    """docs with docnum: 1, 2, ... in the order of ``key``, then of a hash of the row, without a single-partition window.

    The rows are written once in ranges of the key, each with its partition and its place there; the numbers of rows in
    the partitions, counted on what was written, then give each partition its offset. Nothing depends on ranges or rows
    being dealt alike a second time.
    """
    part, at, tie, offset = (unused(n, docs) for n in ("part", "at", "tie", "offset"))
    rows = docs.withColumn(tie, F.xxhash64(*(c for c in docs.columns if not isinstance(docs.schema[c].dataType, T.MapType))))
    rows = rows.repartitionByRange(F.col(key), F.col(tie)).sortWithinPartitions(key, tie)
    rows = rows.withColumn(part, F.spark_partition_id()).withColumn(at, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    rows = written(rows, "numbered")
    total, offsets = 0, []
    for p, n in sorted(tuple(r) for r in rows.groupBy(part).count().collect()):  # a row a partition
        offsets.append((p, total))
        total += n
    offsets = docs.sparkSession.createDataFrame(offsets, f"`{part}` int, `{offset}` long")
    return rows.join(F.broadcast(offsets), part).withColumn("docnum", F.col(offset) + F.col(at) + 1).drop(part, at, tie, offset)


def occurrences(docs: DataFrame, *, fold: bool = True, markup: bool = False) -> DataFrame:
    """docnum, term: a row for each occurrence."""
    return docs.select("docnum", F.explode_outer(analysis.terms(F.col("text"), fold=fold, markup=markup)).alias("term")).where("term is not null")


def postings(docs: DataFrame, *, fold: bool = True, markup: bool = False, endings: Endings = ()) -> DataFrame:
    """term, docnum, f_dt. With ``endings`` the different words are stemmed, not each occurrence."""
    found = occurrences(docs, fold=fold, markup=markup).groupBy("term", "docnum").agg(F.count("*").alias("f_dt"))
    if not endings:
        return found
    stems = found.select("term").distinct().select("term", stem.stem(F.col("term"), endings).alias("stem"))
    return found.join(stems, "term").groupBy(F.col("stem").alias("term"), "docnum").agg(F.sum("f_dt").alias("f_dt"))


def lexicon(posted: DataFrame) -> DataFrame:
    """term, f_t (documents), cf_t (occurrences)."""
    return posted.groupBy("term").agg(F.count("*").alias("f_t"), F.sum("f_dt").alias("cf_t"))


def weights(posted: DataFrame, words: DataFrame, n_docs: int) -> DataFrame:
    """docnum, w: the length of each document's vector of f_dt * ln(N / f_t)."""
    part = F.col("f_dt") * F.log(F.lit(float(n_docs)) / F.col("f_t"))
    return posted.join(words.select("term", "f_t"), "term").groupBy("docnum").agg(F.sqrt(F.sum(part * part)).alias("w"))


def statistics(docs: DataFrame, words: DataFrame) -> DataFrame:
    """One row: n_docs, n_bytes, longest, n_words, n_terms."""
    of_docs = docs.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).cast("long").alias("n_bytes"), F.coalesce(F.max(F.octet_length("text")), F.lit(0)).cast("long").alias("longest"), F.lit(1).alias("one"))
    of_words = words.agg(F.coalesce(F.sum("cf_t"), F.lit(0)).cast("long").alias("n_words"), F.count("*").alias("n_terms"), F.lit(1).alias("one"))
    return of_docs.join(of_words, "one").drop("one")  # one row a side


def approximate_weights(exact: DataFrame, bits: int = 6) -> DataFrame:
    """docnum, code, approx: codes of ``bits`` bits on a geometric scale from the least to the largest weight, and the scale's lower bound.

    A weight of 0 gets the least weight's code.
    """
    ends = exact.where("w > 0").agg(F.min("w").alias("low"), F.max("w").alias("high")).first()
    low, high = ends["low"] or 1.0, ends["high"] or 1.0
    base = (high / low) ** (2.0**-bits)
    if base <= 1:
        return exact.select("docnum", F.lit(0).cast("long").alias("code"), F.lit(low).alias("approx"))
    code = F.least(F.floor(F.round(F.log(F.col("w") / low) / F.log(F.lit(base)), 9)), F.lit((1 << bits) - 1))
    code = F.when(F.col("w") > 0, code).otherwise(F.lit(0)).cast("long")
    return exact.select("docnum", code.alias("code")).withColumn("approx", F.lit(low) * F.pow(F.lit(base), "code"))


def build(docs: DataFrame, *, fold: bool = True, markup: bool = False, endings: Endings = ()) -> Collection:
    """The collection of docs(docnum, text), lazily."""
    posted = postings(docs, fold=fold, markup=markup, endings=endings)
    words = lexicon(posted)
    return Collection(docs, posted, words, weights(posted, words, docs.count()), statistics(docs, words), fold, markup, endings)


def write_batch(path: str, number: int, name: str, df: DataFrame) -> DataFrame:
    """One batch's part of a table, read back; a repeated batch replaces it."""
    where = f"{path}/{name}/batch={number}"
    df.write.mode("overwrite").parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


def by_term(df: DataFrame, *keys: str, small: bool = False) -> DataFrame:
    """Range-partitioned and sorted by term, so that a query reads few row groups; ``small`` lets Spark make fewer ranges of few rows."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (df.repartitionByRange(*keys) if small else df.repartitionByRange(n, *keys)).sortWithinPartitions(*keys)


def saved(docs: DataFrame, path: str, *, endings: Endings = (), **options: bool) -> Collection:
    """Builds step by step on written tables, so nothing is computed twice and a lost executor costs one step.

    The meta table, written last, tells that the batch is whole.
    """
    docs = write_batch(path, 0, "docs", docs)
    posted = write_batch(path, 0, "postings", by_term(postings(docs, endings=endings, **options), "term", "docnum"))
    words = write_batch(path, 0, "lexicon", by_term(lexicon(posted), "term"))
    write_batch(path, 0, "weights", weights(posted, words, docs.count()))
    write_batch(path, 0, "meta", statistics(docs, words))
    return Collection.open(docs.sparkSession, path, endings=endings, **options)


#: Paragraphs of a document are numbered from the document's number times this.
PARAGRAPHS = 1 << 24


def paragraphs(docs: DataFrame, mark: str = "\n") -> DataFrame:
    """docnum (of the paragraph: its document's times PARAGRAPHS, plus its place), text: the units of an index by paragraphs."""
    parts = docs.select("docnum", F.posexplode_outer(analysis.paragraphs(F.col("text"), mark)).alias("paragraph", "text")).where("text is not null")
    return parts.select((F.col("docnum") * F.lit(PARAGRAPHS) + F.col("paragraph")).alias("docnum"), "text")


def paragraph_of(number: Column) -> tuple[Column, Column]:
    """The document and the place in it of a paragraph's number."""
    return F.floor(number / F.lit(PARAGRAPHS)), (number % F.lit(PARAGRAPHS)).cast("int")


def paragraph_counts(docs: DataFrame, mark: str = "\n") -> DataFrame:
    """docnum, n_paragraphs."""
    return docs.select("docnum", F.size(analysis.paragraphs(F.col("text"), mark)).cast("long").alias("n_paragraphs"))


def term_numbers(words: DataFrame) -> DataFrame:
    """term_no (from 0, in order), term, prefix: how many characters a term shares with the one before it, as front coding leaves out."""
    found = numbered(words.select("term"), "term").select((F.col("docnum") - 1).alias("term_no"), "term")
    before = found.select((F.col("term_no") + 1).alias("term_no"), F.col("term").alias("last"))
    shared = F.aggregate(F.sequence(F.lit(1), F.length("term")), F.lit(0), lambda n, k: F.when((n == k - 1) & (F.substring("term", k, F.lit(1)) == F.substring("last", k, F.lit(1))), k).otherwise(n))
    return found.join(before, "term_no", "left").select("term_no", "term", F.coalesce(shared, F.lit(0)).cast("long").alias("prefix"))
