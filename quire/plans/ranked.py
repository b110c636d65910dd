"""Ranked retrieval: cosine scores with exact or approximate weights, over documents or paragraphs."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import analysis
from quire.operators import index
from quire.operators.index import Collection


def query_terms(c: Collection, query: str, *, most: int | None = None, by_rarity: bool = True, counts: bool = True) -> list[tuple[str, int, int, int]]:
    """(term, f_qt, f_t, cf_t) of the query's terms that the lexicon has, rarest first, the first ``most``."""
    found = Counter(c.query_terms(re.findall(analysis.TERM, query)))
    rows = {r["term"]: r for r in c.lexicon.where(F.col("term").isin(list(found))).collect()}  # a row a query term
    out = [(t, n if counts else 1, rows[t]["f_t"], rows[t]["cf_t"]) for t, n in found.items() if t in rows]
    if by_rarity:
        out.sort(key=lambda x: x[2])  # equally rare terms keep the query's order
    return out[:most]


def scores(c: Collection, chosen: list[tuple[str, int, int, int]], weights: DataFrame | None = None, *, level: int = 2) -> DataFrame:
    """docnum, score: sum of f_qt * ln(N/f_t) * f_dt * ln(N/f_t) over the terms, divided by the document's weight; only scores above 0.

    Level 1 knows no f_dt and takes the term's mean, and no weights.
    """
    spark = c.docs.sparkSession
    n = c.meta.select("n_docs").first()["n_docs"]
    terms = spark.createDataFrame(chosen, "term string, f_qt long, f_t long, cf_t long")
    hits = c.postings.where(F.col("term").isin([t[0] for t in chosen])).join(F.broadcast(terms), "term")
    idf = F.log(F.lit(float(n)) / F.col("f_t"))
    f_dt = F.floor(F.col("cf_t") / F.col("f_t")) if level == 1 else F.col("f_dt")
    total = hits.groupBy("docnum").agg(F.sum(F.col("f_qt") * idf * f_dt * idf).alias("total"))
    if level == 1:
        return total.where("total > 0").select("docnum", F.col("total").alias("score"))
    return total.join(c.weights if weights is None else weights, "docnum").where("total > 0 and w > 0").select("docnum", (F.col("total") / F.col("w")).alias("score"))


def top(found: DataFrame, k: int | None) -> DataFrame:
    """The best k, ties (to nine places) to the smaller docnum; the sort and the limit are one operator."""
    out = found.orderBy(F.desc(F.round("score", 9)), "docnum")
    return out if k is None else out.limit(k)


def ranked(c: Collection, query: str, k: int | None = 10, *, max_terms: int | None = None, by_rarity: bool = True, qfreq: bool = True, level: int = 2) -> DataFrame:
    return top(scores(c, query_terms(c, query, most=max_terms, by_rarity=by_rarity, counts=qfreq), level=level), k)


def approximately_ranked(c: Collection, query: str, k: int | None = 10, bits: int = 6, *, max_terms: int | None = None, by_rarity: bool = True, qfreq: bool = True) -> DataFrame:
    """Scores with the weights' lower bounds of ``bits`` bits."""
    weights = index.approximate_weights(c.weights, bits).select("docnum", F.col("approx").alias("w"))
    return top(scores(c, query_terms(c, query, most=max_terms, by_rarity=by_rarity, counts=qfreq), weights), k)


def limited(c: Collection, query: str, accumulators: int, *, stop: bool = False, k: int | None = 10, approximate: bool = False, **terms: object) -> DataFrame:
    """Ranked with at most about ``accumulators`` of them: when they are full as a term begins, later terms only add to
    documents that have one (``stop``: no later term counts). ``terms`` go to ``query_terms``."""
    chosen = query_terms(c, query, **terms)
    order = {t[0]: j for j, t in enumerate(chosen)}
    spark = c.docs.sparkSession
    ranks = spark.createDataFrame([(t, j) for t, j in order.items()], "term string, j int")
    hits = c.postings.where(F.col("term").isin(list(order))).join(F.broadcast(ranks), "term")
    first = hits.groupBy("docnum").agg(F.min("j").alias("first"))
    new = {r["first"]: r["n"] for r in first.groupBy("first").agg(F.count("*").alias("n")).collect()}  # a row a query term
    have, full = 0, len(chosen)
    for j in range(len(chosen)):
        if have >= accumulators:
            full = j
            break
        have += new.get(j, 0)
    allowed = first.where(F.col("first") < full).select("docnum")
    kept = chosen[:full] if stop else chosen
    weights = index.approximate_weights(c.weights).select("docnum", F.col("approx").alias("w")) if approximate else None
    return top(scores(c, kept, weights).join(allowed, "docnum", "left_semi"), k)


def by_paragraph(units: Collection, query: str, *, most_paragraphs: int = 1000, k: int | None = 10, **terms: object) -> DataFrame:
    """docnum, paragraph, score: documents by their best paragraph among the best ``most_paragraphs``.

    ``units`` is a collection of ``index.paragraphs``, saved once for all queries; ``terms`` go to ``query_terms``.
    """
    found = top(scores(units, query_terms(units, query, **terms)), most_paragraphs)
    doc, paragraph = index.paragraph_of(F.col("docnum"))
    best = Window.partitionBy("doc").orderBy(F.desc(F.round("score", 9)), "docnum")
    out = found.withColumn("doc", doc).withColumn("r", F.row_number().over(best)).where("r = 1")
    return top(out.select(F.col("doc").alias("docnum"), paragraph.alias("paragraph"), "score"), k)


def percent(found: DataFrame, weight: str = "score") -> DataFrame:
    """The answers with ``percent``: the weight from 1 to 100, the best answer's being 100."""
    best = found.agg(F.max(weight)).first()[0]
    return found.withColumn("percent", F.round(F.col(weight) / F.lit(best or 1.0) * 99 + 1).cast("int"))


def statistics(c: Collection, query: str, k: int | None = 10) -> DataFrame:
    """One row of what a ranked query took: terms, pointers (postings read), accumulators (documents met), answers, lookups."""
    chosen = [t[0] for t in query_terms(c, query)]
    hits = c.postings.where(F.col("term").isin(chosen))
    met = hits.agg(F.count("*").alias("pointers"), F.count_distinct("docnum").alias("accumulators"))
    answers = ranked(c, query, k).agg(F.count("*").alias("answers")).first()[0]
    return met.select(F.lit(len(chosen)).cast("long").alias("terms"), "pointers", "accumulators", F.lit(answers).cast("long").alias("answers"), F.lit(answers).cast("long").alias("lookups"))


def similar(c: Collection, queries: DataFrame, k: int = 3) -> DataFrame:
    """query_id, docnum, score, rank: many queries (query_id, text) at once, joined instead of looped over.

    Terms that every document has weigh nothing and are left out before they meet postings; hot terms are left to adaptive skew handling.
    """
    n = c.meta.select("n_docs").first()["n_docs"]
    asked = c.indexed(queries.select(F.col("query_id").alias("docnum"), "text")).select("term", F.col("docnum").alias("query_id"), F.col("f_dt").alias("f_qt"))
    idf = F.log(F.lit(float(n)) / F.col("f_t"))
    hits = c.postings.join(asked.join(c.lexicon.where(F.col("f_t") < n), "term"), "term")
    total = hits.groupBy("query_id", "docnum").agg(F.sum(F.col("f_qt") * idf * F.col("f_dt") * idf).alias("total"))
    found = total.join(c.weights, "docnum").where("total > 0 and w > 0").select("query_id", "docnum", (F.col("total") / F.col("w")).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "docnum")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
