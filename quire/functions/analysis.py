"""Text analysis as Column functions: index terms, mark-up, case, paragraphs, heads, highlights."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.stem import stem

#: A term is a run of ASCII letters and digits that ends before its fifth digit; the rest of the run is the next term. Fixed value.
TERM = "[A-Za-z]+(?:[0-9][A-Za-z]*){0,4}|[0-9][A-Za-z]*(?:[0-9][A-Za-z]*){0,3}"
#: A term has at most so many characters. Fixed value.
MOST_CHARACTERS = 255
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def without_markup(text: Column) -> Column:
    """Tags are separators; one that never closes takes the rest of the text."""
    return F.regexp_replace(text, "<[^>]*>?", " ")


def terms(text: Column, *, fold: bool = True, markup: bool = False) -> Column:
    """array<string>: the index terms of a text, in order; none for null."""
    text = F.coalesce(text, F.lit(""))
    if markup:
        text = without_markup(text)
    found = F.regexp_extract_all(text, F.lit(TERM), F.lit(0))
    cut = lambda t: F.regexp_extract_all(t, F.lit(f".{{1,{MOST_CHARACTERS}}}"), F.lit(0))
    long = F.exists(found, lambda t: F.length(t) > MOST_CHARACTERS)
    found = F.when(long, F.flatten(F.transform(found, cut))).otherwise(found)
    return F.transform(found, F.lower) if fold else found


def paragraphs(text: Column, mark: str = "\n") -> Column:
    """array<string>: the pieces up to each mark; an empty last piece is none."""
    pieces = F.split(F.coalesce(text, F.lit("")), f"\\Q{mark}\\E")
    return F.when(F.element_at(pieces, -1) == "", F.slice(pieces, F.lit(1), F.size(pieces) - 1)).otherwise(pieces)


def head(text: Column, length: int = 50) -> Column:
    """The first characters, white space run together."""
    return F.substring(F.ltrim(F.regexp_replace(F.split_part(text, F.lit("\x02"), F.lit(1)), "[ \\t\\n\\x0B\\f\\r\\x01\\x03]+", " ")), 1, length)


def highlighted(text: Column, words: list[str], style: str = "B") -> Column:
    """HTML with the words (of one case or another) marked."""
    if not words:
        return text
    any_of = "|".join(sorted(words, key=lambda w: (-len(w), w)))
    return F.regexp_replace(text, f"(?i)(?<![A-Za-z0-9])({any_of})(?![A-Za-z0-9])", f"<{style}>$1</{style}>")


def highlighted_stems(text: Column, stems: list[str], endings: tuple[tuple[str, str], ...], style: str = "B") -> Column:
    """HTML with the words marked that have one of these stems."""
    parts = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Za-z0-9]+|[^A-Za-z0-9]+"), F.lit(0))
    marked = lambda p: F.rlike(p, F.lit("^[A-Za-z0-9]")) & stem(F.lower(p), endings).isin(stems)
    return F.array_join(F.transform(parts, lambda p: F.when(marked(p), F.concat(F.lit(f"<{style}>"), p, F.lit(f"</{style}>"))).otherwise(p)), "")
