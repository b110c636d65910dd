"""Named sources: a small table of names, kinds and files, and the documents behind a name."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources import images, text

KINDS = ("plain", "linesep", "para", "bib", "mail", "dir", "dir2", "txtimg")


@dataclass(frozen=True)
class Source:
    name: str
    kind: str
    paths: tuple[str, ...]


def parsed(table: str) -> dict[str, Source]:
    """Lines of name, kind and files, with tabs between; # begins a comment, and a later line replaces an earlier one of its name."""
    out = {}
    for line in table.splitlines():
        if not line.strip() or line.startswith("#"):
            continue
        name, kind, *paths = (part.strip() for part in line.split("\t"))
        if kind.lower() not in KINDS or not paths:
            raise ValueError(f"not a source: {line!r}")
        out[name] = Source(name, kind.lower(), tuple(p for part in paths for p in part.split()))
    return out


def documents(spark: SparkSession, source: Source) -> DataFrame:
    """file, part, text of a source's documents. A source to be merged is one under another name."""
    if source.kind == "plain":  # may be larger than memory, so it is read by records
        found = text.delimited(spark, list(source.paths))
        return found.select("file", F.monotonically_increasing_id().alias("part"), "text")
    files = [text.whole_files(spark, p, named=source.kind == "dir") for p in source.paths]
    both = files[0]
    for other in files[1:]:
        both = both.unionByName(other)
    if source.kind == "txtimg":
        texts = both.where(F.col("file").endswith(".txt"))
        found = text.with_images(texts, both.where(F.rlike("file", F.lit(images.NAMES))).select("file"))
        return found.select(F.col("base").alias("file"), F.lit(0).cast("long").alias("part"), "text")
    if source.kind in ("dir", "dir2"):
        return both.select("file", F.lit(0).cast("long").alias("part"), "text")
    return text.cut(both, source.kind).withColumn("part", F.col("part").cast("long"))


def numbered(spark: SparkSession, source: Source) -> DataFrame:
    """docnum, text of a source's documents, in order of file and place."""
    return text.numbered_documents(documents(spark, source))
