"""New documents into a collection that is there already."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import index
from quire.operators.index import Collection
from quire.session import remove


def merged_lexicon(old: DataFrame, new: DataFrame) -> DataFrame:
    """Counts add up; a full outer merge as one aggregate."""
    return old.unionByName(new).groupBy("term").agg(F.sum("f_t").alias("f_t"), F.sum("cf_t").alias("cf_t"))


def append(c: Collection, docs: DataFrame, *, weights: str = "exact") -> Collection:
    """The collection with docs(docnum, text), whose numbers must be new. Only the new texts are analysed.

    weights: ``exact`` computes every document's weight again; ``stale`` keeps the old ones and computes the new ones with
    the merged counts, which reads no old postings.
    """
    posted = c.indexed(docs)
    words = merged_lexicon(c.lexicon, index.lexicon(posted))
    all_docs, all_posted = c.docs.unionByName(docs), c.postings.unionByName(posted)
    n = c.meta.select("n_docs").first()["n_docs"] + docs.count()
    if weights == "exact":
        new = index.weights(all_posted, words, n)
    elif weights == "stale":
        new = c.weights.unionByName(index.weights(posted, words, n))
    else:
        raise ValueError("weights must be exact or stale")
    return replace(c, docs=all_docs, postings=all_posted, lexicon=words, weights=new, meta=index.statistics(all_docs, words))


def append_saved(path: str, docs: DataFrame, *, number: int | None = None, weights: str = "stale", renumber: bool = False, **options: object) -> Collection:
    """Adds docs(docnum, text) to the saved collection under ``path``, or begins one, and opens it.

    Only new files are written, under the batch's number (the next one): the new documents, their postings, the counts of
    their terms, their weights (computed with the merged counts), and the merged statistics, which come last and make
    the batch count; a batch that was broken off or repeated is replaced. ``exact`` writes all weights anew and
    removes those before. Numbers must be new; ``renumber`` gives new ones after the last, in order of docnum.
    """
    spark = docs.sparkSession
    if weights not in ("stale", "exact"):
        raise ValueError("weights must be exact or stale")
    last = batches(spark, path) - 1
    number = last + 1 if number is None else number
    if number == 0:
        return index.saved(docs, path, **options)
    if not 0 <= number <= last + 1:
        raise ValueError(f"batch {number} doesn't follow batch {last}")
    c = Collection.open(spark, path, last=number - 1, **options)
    if renumber:
        before = c.docs.agg(F.max("docnum")).first()[0] or 0
        docs = index.numbered(docs.withColumnRenamed("docnum", "key"), "key").select((F.col("docnum") + before).alias("docnum"), "text")
    docs = index.write_batch(path, number, "docs", docs)
    if not c.docs.join(docs.select("docnum"), "docnum", "left_semi").isEmpty():
        raise ValueError("documents with these numbers are there already")
    posted = index.write_batch(path, number, "postings", index.by_term(c.indexed(docs), "term", "docnum", small=True))
    words = index.write_batch(path, number, "lexicon", index.by_term(index.lexicon(posted), "term", small=True))
    old = c.meta.first()
    n = old["n_docs"] + docs.count()
    there = c.lexicon.join(words.select("term"), "term", "left_semi")  # only terms of new documents are looked up
    if weights == "exact":
        index.write_batch(path, number, "weights", index.weights(c.postings.unionByName(posted), merged_lexicon(c.lexicon, words), n))
        for k in range(number):
            remove(spark, f"{path}/weights/batch={k}")
    else:
        index.write_batch(path, number, "weights", index.weights(posted, merged_lexicon(there, words), n))
    new = index.statistics(docs, words).first()
    added = {k: old[k] + new[k] for k in ("n_docs", "n_bytes", "n_words")} | {"longest": max(old["longest"], new["longest"])}
    added["n_terms"] = old["n_terms"] + new["n_terms"] - there.count()
    index.write_batch(path, number, "meta", spark.createDataFrame([tuple(added[k] for k in c.meta.columns)], c.meta.schema))
    return Collection.open(spark, path, **options)


def batches(spark: SparkSession, path: str) -> int:
    """How many finished batches the collection under ``path`` has."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/meta")
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return 0
    return spark.read.parquet(f"{path}/meta").agg(F.max("batch")).first()[0] + 1
