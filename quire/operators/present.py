"""What a query shows: filtered texts, heads, numbers, highlighted texts."""

from __future__ import annotations

import re

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import analysis


def post_filter(line: str) -> tuple[str, str | None]:
    """(the query without it, the pattern between the line's first and last quote); a lone quote is dropped."""
    first, last = line.find('"'), line.rfind('"')
    if first < 0:
        return line, None
    if first == last:
        return line[:first] + line[first + 1 :], None
    return line[:first] + line[last + 1 :], line[first + 1 : last]


def java_pattern(pattern: str) -> str:
    r"""A basic pattern (groups and alternatives behind backslashes) in Java's syntax; ^ and $ match at lines."""
    swap = {r"\(": "(", r"\)": ")", r"\|": "|", "(": r"\(", ")": r"\)", "|": r"\|", "{": r"\{", "}": r"\}"}
    return "(?m)" + re.sub(r"\\.|[(){}|]", lambda m: swap.get(m[0], m[0]), pattern)


def passes(text: Column, pattern: str | None, *, verbatim: bool = False) -> Column:
    """Whether the text has the pattern; a pattern that can't be compiled filters nothing."""
    if not pattern:
        return F.lit(True)
    if verbatim:
        return F.instr(text, pattern) > 0
    jvm = SparkContext._active_spark_context._jvm
    try:  # by the engine that runs it
        jvm.java.util.regex.Pattern.compile(java_pattern(pattern))
    except (Py4JJavaError, IllegalArgumentException):
        return F.lit(True)
    return F.coalesce(F.rlike(text, F.lit(java_pattern(pattern))), F.lit(False))


def filtered(answers: DataFrame, docs: DataFrame, pattern: str | None, *, verbatim: bool = False) -> DataFrame:
    """The answers whose text passes."""
    return answers.join(docs.where(passes(F.col("text"), pattern, verbatim=verbatim)).select("docnum"), "docnum", "left_semi")


def heads(answers: DataFrame, docs: DataFrame, length: int = 50) -> DataFrame:
    return answers.select("docnum").join(docs, "docnum").select("docnum", analysis.head(F.col("text"), length).alias("head"))


def highlighted(answers: DataFrame, docs: DataFrame, words: list[str], style: str = "B", endings: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """docnum, text with the words marked, or those that have these stems where there are endings."""
    text = analysis.highlighted_stems(F.col("text"), words, endings, style) if endings else analysis.highlighted(F.col("text"), words, style)
    return answers.select("docnum").join(docs, "docnum").select("docnum", text.alias("text"))


def lines(answers: DataFrame, weight: str = "weight") -> DataFrame:
    """The numbers' print form: number, weight and length."""
    return answers.select("docnum", F.format_string("%8d   %6.4f   %7d", "docnum", weight, "length").alias("line"))


def separated(template: str, docnum: Column, weight: Column) -> Column:
    """A separator with %n (number), %w (weight) and %% filled in."""
    parts = [{"%n": docnum.cast("string"), "%w": F.format_number(weight, 6), "%%": F.lit("%")}.get(p, F.lit(p)) for p in re.findall(r"%[nw%]|[^%]+|%", template)]
    return F.concat(*parts) if parts else F.lit("")


def whole(docs: DataFrame, end: str = "\x02") -> DataFrame:
    """docnum, text: the whole collection in order, each text with its end mark."""
    return docs.select("docnum", F.concat(F.coalesce("text", F.lit("")), F.lit(end)).alias("text")).orderBy("docnum")


def with_names(answers: DataFrame, names: DataFrame, weight: str = "weight") -> DataFrame:
    """name, docnum, weight: answers as lists of judged collections have them."""
    return answers.join(names, "docnum").select("name", "docnum", F.col(weight).alias("weight"))


def with_paragraphs(answers: DataFrame, docs: DataFrame, best: DataFrame, separator: str = "\n", mark: str = "**") -> DataFrame:
    """docnum, text: the paragraphs joined by a separator, the best one (docnum, paragraph) between marks."""
    parts = analysis.paragraphs(F.col("text"))
    marked = F.transform(parts, lambda p, k: F.when(k == F.col("paragraph"), F.concat(F.lit(mark), p, F.lit(mark))).otherwise(p))
    return answers.select("docnum").join(docs, "docnum").join(best.select("docnum", "paragraph"), "docnum", "left").select("docnum", F.array_join(marked, separator).alias("text"))


_SINGLE = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "\\": "\\", '"': '"', "'": "'", "": "\\"}


def unescaped(text: str) -> str:
    """A setting's backslash escapes as the characters they stand for: letters, \\x with two hexadecimal digits, up to three octal ones.

    Other escapes are dropped; a backslash at the end stands for itself.
    """

    def one(m: re.Match) -> str:
        what = m[1]
        if what[:1] == "x":
            return chr(int(what[1:] or "0", 16))
        return chr(int(what, 8) & 255) if what[:1].isdigit() else _SINGLE.get(what, "")

    return re.sub(r"\\(x[0-9A-Fa-f]{0,2}|[0-7]{1,3}|.|$)", one, text, flags=re.DOTALL)
