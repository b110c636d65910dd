"""Longest-match suffix stripping with context rules, as one regular expression, and the recoding of what is left.

The table of endings is a parameter: (ending, rule) pairs, or a file of them (``read``). A rule is a name in ``RULES``: a
condition on the stem, which always keeps two letters. What is left is recoded: one of two equal letters at the end goes,
then the first of ``REWRITES`` that fits is applied. Words are stemmed by built-in functions, so no Python sees them; a
caller with many occurrences stems the distinct words and joins.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What the end of the stem must look like, by rule. Fixed values.
RULES = {
    "A": "..", "B": "...", "C": "....", "D": ".....", "E": ".[^e]", "F": "..[^e]", "G": "..f", "H": "(?:.t|ll)", "I": ".[^oe]", "J": ".[^ae]",
    "K": "(?:..[li]|u.e)", "L": "(?:.[^uxs]|os)", "M": ".[^acem]", "N": "(?:[^s]..|.s..)", "O": ".[li]", "P": ".[^c]", "Q": "..[^ln]", "R": ".[nr]", "S": "(?:[^t]t|dr)", "T": "(?:.s|[^o]t)",
    "U": ".[lmnr]", "V": ".c", "W": ".[^su]", "X": "(?:.[li]|u.e)", "Y": "in", "Z": ".[^f]", "AA": "(?:.[dflt]|[pt]h|[eo]r|es)", "BB": "(?:(?!met$|ryst$)...)", "CC": ".l",
}
#: The published endings of up to three letters, with their rules; longer ones come from a file. Fixed values.
SHORT = (
    ("acy", "A"), ("age", "B"), ("aic", "A"), ("als", "BB"), ("ant", "B"), ("ars", "O"), ("ary", "F"), ("ata", "A"), ("ate", "A"), ("eal", "Y"), ("ear", "Y"), ("ely", "E"),
    ("ene", "E"), ("ent", "C"), ("ery", "E"), ("ese", "A"), ("ful", "A"), ("ial", "A"), ("ian", "A"), ("ics", "A"), ("ide", "L"), ("ied", "A"), ("ier", "A"), ("ies", "P"),
    ("ily", "A"), ("ine", "M"), ("ing", "N"), ("ion", "Q"), ("ish", "C"), ("ism", "B"), ("ist", "A"), ("ite", "AA"), ("ity", "A"), ("ium", "A"), ("ive", "A"), ("ize", "F"),
    ("oid", "A"), ("one", "R"), ("ous", "A"), ("ae", "A"), ("al", "BB"), ("ar", "X"), ("as", "B"), ("ed", "E"), ("en", "F"), ("es", "E"), ("ia", "A"), ("ic", "A"),
    ("is", "A"), ("ly", "B"), ("on", "S"), ("or", "T"), ("um", "U"), ("us", "V"), ("yl", "R"), ("a", "A"), ("e", "A"), ("i", "A"), ("o", "A"), ("s", "W"), ("y", "B"),
)
DOUBLED = "bdglmnprst"
#: The published recoding of Lovins' stemmer: end of the stem, what takes its place, letters that must not stand before it. Fixed values.
REWRITES = (
    ("iev", "ief", ""), ("uct", "uc", ""), ("umpt", "um", ""), ("rpt", "rb", ""), ("urs", "ur", ""), ("istr", "ister", ""), ("metr", "meter", ""), ("olv", "olut", ""),
    ("ul", "l", "aio"), ("bex", "bic", ""), ("dex", "dic", ""), ("pex", "pic", ""), ("tex", "tic", ""), ("ax", "ac", ""), ("ex", "ec", ""), ("ix", "ic", ""),
    ("lux", "luc", ""), ("uad", "uas", ""), ("vad", "vas", ""), ("cid", "cis", ""), ("lid", "lis", ""), ("erid", "eris", ""), ("pand", "pans", ""), ("end", "ens", "s"),
    ("ond", "ons", ""), ("lud", "lus", ""), ("rud", "rus", ""), ("her", "hes", "pt"), ("mit", "mis", ""), ("ent", "ens", "m"), ("ert", "ers", ""), ("et", "es", "n"),
    ("yt", "ys", ""), ("yz", "ys", ""),
)


def read(path: str) -> tuple[tuple[str, str], ...]:
    """The endings of a file with one ending and its rule a line; # begins a comment."""
    with open(path, encoding="utf-8") as f:
        rows = [line.split("#")[0].split() for line in f]
    endings = tuple((r[0], r[1] if len(r) > 1 else "A") for r in rows if r)
    for ending, rule in endings:
        if rule not in RULES:
            raise ValueError(f"{ending}: no rule {rule!r}")
    return endings


def recoded(word: str) -> str:
    """The recoding in Python."""
    if len(word) > 1 and word[-1] == word[-2] and word[-1] in DOUBLED:
        word = word[:-1]
    for end, new, never in REWRITES:
        if word.endswith(end) and not (never and word[: -len(end)][-1:] in tuple(never)):
            return word[: -len(end)] + new
    return word


def stemmed(word: str, endings: Iterable[tuple[str, str]]) -> str:
    """The stem in Python, for the words of a query."""
    return recoded(stripped(word, endings)) if len(word) > 2 else word


def _choices(endings: Iterable[tuple[str, str]]) -> list[tuple[str, str]]:
    return sorted(endings, key=lambda e: (-len(e[0]), e[0]))


def stripped(word: str, endings: Iterable[tuple[str, str]]) -> str:
    """The word without the longest ending whose rule its stem keeps."""
    for ending, rule in _choices(endings):
        stem = word[: len(word) - len(ending)]
        if word.endswith(ending) and len(stem) >= 2 and _keeps(stem, rule):
            return stem
    return word


def _keeps(stem: str, rule: str) -> bool:
    if rule == "BB":
        return len(stem) >= 3 and not re.search("(?:^met|ryst)$", stem)
    return bool(re.search(RULES[rule] + "$", stem))


def recoding(stem: Column) -> Column:
    """The recoding as a Column."""
    stem = F.regexp_replace(stem, f"([{DOUBLED}])\\1$", "$1")
    out = None
    for end, new, never in REWRITES:
        fits = F.rlike(stem, F.lit(f"(?<![{never}]){end}$" if never else f"{end}$"))
        value = F.concat(F.substring(stem, F.lit(1), F.length(stem) - len(end)), F.lit(new))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out.otherwise(stem)


def stem(word: Column, endings: Iterable[tuple[str, str]]) -> Column:
    """Words of over two letters without their ending, recoded, in Java's regular expressions."""
    tests = []
    for ending, rule in _choices(endings):
        left = F.substring(word, F.lit(1), F.length(word) - len(ending))
        keeps = (F.length(left) >= 3) & ~F.rlike(left, F.lit("(?:^met|ryst)$")) if rule == "BB" else F.rlike(left, F.lit(RULES[rule] + "$"))
        tests.append(F.when(F.endswith(word, F.lit(ending)) & (F.length(left) >= 2) & keeps, left))
    # a word is stripped once, before the rewrites look at it
    bare = F.transform(F.array(F.coalesce(*tests, word)), recoding)
    return F.when(F.length(word) <= 2, word).otherwise(F.element_at(bare, 1))
