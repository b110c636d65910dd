"""Set operations on answers (docnum, weight), and queries by document number."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    """Documents of both; the left weight stays."""
    return a.join(b.select("docnum"), "docnum", "left_semi")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select("docnum"), "docnum", "left_anti")


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Documents of either; weights add up."""
    return a.unionByName(b).groupBy("docnum").agg(F.sum("weight").alias("weight"))


def first_paragraphs(hits: DataFrame) -> DataFrame:
    """docnum, paragraph: the first matching paragraph of each document."""
    return hits.groupBy("docnum").agg(F.min("paragraph").alias("paragraph"))


def parsed_numbers(line: str, most: int) -> list[tuple[int, int]]:
    """(docnum, position) of every mention, up to the first part that is no number from 1 to ``most`` or range of such.

    A range mentions its first number twice; a descending one only then, once.
    """
    out: list[tuple[int, int]] = []
    for part in re.findall(r"[^\s,]+", line):
        m = re.fullmatch(r"(\d+)(?:-(\d+))?", part)
        if not m or not 1 <= int(m[1]) <= most or (m[2] and not 1 <= int(m[2]) <= most):
            break
        out.append((int(m[1]), len(out)))
        if m[2]:
            out += [(n, len(out) + k) for k, n in enumerate(range(int(m[1]), int(m[2]) + 1))]
    return out


def by_number(docs: DataFrame, line: str) -> DataFrame:
    """docnum, weight (mentions), position (of the first): the documents that the line names and that there are."""
    most = docs.agg(F.max("docnum")).first()[0] or 0
    named = docs.sparkSession.createDataFrame(parsed_numbers(line, most), "docnum long, position long")
    found = named.groupBy("docnum").agg(F.count("*").cast("double").alias("weight"), F.min("position").alias("position"))
    return found.join(docs.select("docnum"), "docnum", "left_semi").orderBy("position")
