"""Sources: files and columns cut into documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.index import numbered

END = "\x02"


def delimited(spark: SparkSession, paths: str | list[str], end: str = END) -> DataFrame:
    """file, text: records up to each end mark. A file's end also ends a record."""
    return spark.read.option("lineSep", end).text(paths).select(F.input_file_name().alias("file"), F.col("value").alias("text"))


def whole_files(spark: SparkSession, path: str, *, named: bool = False) -> DataFrame:
    """file, text: every file below the folder is a document, with its path in front if ``named``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    text = F.decode(F.col("content"), "UTF-8")
    return files.select(F.col("path").alias("file"), (F.concat(F.lit("< "), "path", F.lit(" >\n"), text) if named else text).alias("text"))


#: How a file's text is cut: by lines of 17 or more stars, by blank lines, before entries, before mails.
CUTS: dict[str, Callable[[Column], Column]] = {
    "plain": lambda t: F.split(t, END),
    "linesep": lambda t: F.split(t, r"(?m)^.*\*{17}.*\n?"),
    "para": lambda t: F.split(t, r"\n(?: *\n)+"),
    "bib": lambda t: F.split(t, r"(?m)(?<!\A)(?=^@)"),
    "mail": lambda t: F.split(F.regexp_replace(t, r"(?ms)^xbtoa Begin.*?^xbtoa End[^\n]*\n?", ""), r"(?m)(?<!\A)(?=^From )"),
}


def cut(files: DataFrame, kind: str) -> DataFrame:
    """file, part, text: the documents of files(file, text); empty pieces are none."""
    return files.select("file", F.posexplode_outer(CUTS[kind](F.col("text"))).alias("part", "text")).where("trim(both from text) <> ''")


def with_images(texts: DataFrame, images: DataFrame) -> DataFrame:
    """base, text with a line for its images: joined by the files' base names."""
    base = F.regexp_replace("file", r"\.[^./]*$", "")
    kinds = images.select(base.alias("base"), F.regexp_extract("file", r"([^/]*)$", 1).alias("image")).groupBy("base").agg(F.array_sort(F.collect_list("image")).alias("images"))
    joined = texts.select(base.alias("base"), "text").join(kinds, "base", "left")
    return joined.select("base", F.concat(F.when(F.col("images").isNotNull(), F.concat(F.lit("Image(s) available: "), F.array_join("images", " "), F.lit("\n"))).otherwise(F.lit("")), "text").alias("text"))


def record_names(docs: DataFrame) -> DataFrame:
    """docnum, name: what stands between DOCNO tags, else that there is none."""
    found = F.trim(F.regexp_extract("text", r"(?s)<DOCNO>(.*?)</DOCNO>", 1))
    return docs.select("docnum", F.when(found != "", found).otherwise(F.concat(F.lit("NO DOC ID "), "docnum")).alias("name"))


def numbered_documents(parts: DataFrame) -> DataFrame:
    """docnum, text, from 1 in order of file and part."""
    return numbered(parts.withColumn("_key", F.concat_ws("\x00", "file", F.lpad(F.col("part").cast("string"), 12, "0"))), "_key").select("docnum", "text")
