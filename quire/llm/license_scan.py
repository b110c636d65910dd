"""Licence scan by canonical digests.

A text's canonical form has ASCII letters in lower case, no copyright or all-rights-reserved lines, one spelling of
words that the licence guidelines hold to be the same, and single spaces for everything that is not an ASCII letter or
digit. Its SHA-256 is looked up by a hash join among the digests of known licences; entire texts match or don't. A
licence that has copyright lines of its own is known as it stands and as it is with its paragraphs wrapped at each width in
``WRAPS``, since a wrap moves what such a line ends with. The same digests are looked up for each line of a text that speaks of a licence, which finds notices ("Released under ...")
within other text.

The known licences are a table in this package, so the broadcast side has a fixed size.

Defined results: a null or empty text has the digest of the empty text, no licence and no notices; repeated rows each
give a row; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import textwrap
from collections.abc import Mapping, Sequence
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.license_texts import KNOWN

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Lines that name a holder or a year and differ from copy to copy; a sentence that is wrapped at "copyright" or an item (c) is none.
_YEAR = r"(?:(?:19|20)[0-9][0-9]|[\[<{]?(?:year|yyyy)[\]>}])"
HOLDER_LINE = rf"(?m)^[^a-z0-9\n]*(?:copyright[^a-z0-9\n]*(?:\(c\)|©|{_YEAR})[^\n]*|copyright[^\n]*{_YEAR}[^a-z0-9\n]*|copyright[^\n]* (?:authors|inc|llc|ltd|corporation|foundation)\.?|(?:\(c\)|©)[^a-z0-9\n]*(?:copyright[^a-z0-9\n]*)?{_YEAR}[^\n]*|© [^\n]*|all rights reserved[^a-z0-9\n]*)$"
#: Digests stand in the plan itself, so their number has a bound.
MOST_KNOWN = 5000
#: Widths at which known licences with copyright lines of their own may be wrapped.
WRAPS = range(40, 121)
_HOLDER_WORDS = re.compile(r"copyright|\(c\)|©|all\s+rights\s+reserved", re.IGNORECASE)
#: Equivalent spellings, applied to the words once each stands between spaces of its own. Fixed values.
SPELLINGS = (
    (" licence ", " license "),
    (" licences ", " licenses "),
    (" licenced ", " licensed "),
    (" sub license ", " sublicense "),
    (" non infringement ", " noninfringement "),
    (" acknowledgement ", " acknowledgment "),
    (" analogue ", " analog "),
    (" authorisation ", " authorization "),
    (" favour ", " favor "),
    (" fulfil ", " fulfill "),
    (" organisation ", " organization "),
    (" organisations ", " organizations "),
    (" per cent ", " percent "),
    (" whilst ", " while "),
    (" wilful ", " willful "),
    (" http ", " https "),
)
#: Only lines with this are looked up as notices; each known notice has it.
NOTICE_MARK = "licen"


def canonical(text: str | None) -> str:
    """The canonical form, in Python; ``canonical_column`` is the same in SQL functions."""
    x = (text or "").translate(str.maketrans(UPPER, LOWER))
    return _spelt(re.sub(HOLDER_LINE, " ", x))


def _spelt(x: str) -> str:
    # two spaces between words, so that neighbours share none
    x = f" {re.sub('[^a-z0-9]+', '  ', x)} "
    for a, b in SPELLINGS:
        x = x.replace(_apart(a), b)
    return re.sub(" +", " ", x).strip(" ")


def _apart(spelling: str) -> str:
    return f" {spelling.strip().replace(' ', '  ')} "


def digest(text: str) -> str:
    return hashlib.sha256(canonical(text).encode()).hexdigest()


@lru_cache(maxsize=MOST_KNOWN)
def digests(text: str) -> frozenset[str]:
    """The digest of the text, and of the text with its paragraphs wrapped at each of ``WRAPS``."""
    forms = [[] for _ in WRAPS]
    for paragraph in re.split(r"\n[ \t]*\n\s*", text.translate(str.maketrans(UPPER, LOWER))):
        if not _HOLDER_WORDS.search(paragraph):  # no wrap changes it
            for form in forms:
                form.append(paragraph)
            continue
        words = " ".join(paragraph.split())
        for form, width in zip(forms, WRAPS, strict=True):
            lines = "\n".join(textwrap.wrap(words, width, break_long_words=False, break_on_hyphens=False))
            form.append(re.sub(HOLDER_LINE, " ", lines))
    whole = {"\n".join(form) for form in forms}
    return frozenset([digest(text), *(hashlib.sha256(_spelt(x).encode()).hexdigest() for x in whole)])


def canonical_column(text: Column) -> Column:
    x = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    x = F.regexp_replace(x, HOLDER_LINE, " ")
    x = F.concat(F.lit(" "), F.regexp_replace(x, "[^a-z0-9]+", "  "), F.lit(" "))
    for a, b in SPELLINGS:
        x = F.replace(x, F.lit(_apart(a)), F.lit(b))
    return F.trim(F.regexp_replace(x, " +", " "))


def known(more: Mapping[str, Sequence[str]] | None = None) -> dict[str, str]:
    """Digest -> SPDX identifier, of the package's texts and of ``more`` by identifier."""
    found = {d: name for table in (KNOWN, more or {}) for name, texts in table.items() for text in texts for d in digests(text)}
    if len(found) > MOST_KNOWN:
        raise ValueError(f"over {MOST_KNOWN} licence texts")
    return found


def scan(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", more: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """doc_id, canonical_sha256, license_id (the entire text is that licence, else null), notices (licences named by whole lines, sorted)."""
    spark, ids = documents.sparkSession, known(more)
    table = spark.createDataFrame(sorted(ids.items()), "canonical_sha256 string, license_id string")
    lookup = F.create_map(*(F.lit(x) for pair in sorted(ids.items()) for x in pair))
    lines = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: F.translate(x, UPPER, LOWER).contains(NOTICE_MARK))
    found = F.filter(F.transform(lines, lambda x: lookup[F.sha2(canonical_column(x), 256)]), lambda x: x.isNotNull())
    # the filter on the whole text spares most rows the splitting
    speaks = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER).contains(NOTICE_MARK)
    none = F.array().cast("array<string>")
    rows = documents.select(
        F.col(doc_id).alias("doc_id"),
        F.sha2(canonical_column(F.col(text)), 256).alias("canonical_sha256"),
        F.when(speaks, F.array_sort(F.array_distinct(found))).otherwise(none).alias("notices"),
    )
    return rows.join(F.broadcast(table), "canonical_sha256", "left").select("doc_id", "canonical_sha256", "license_id", F.array_join("notices", ",").alias("notices"))


def oracle_sql() -> str:
    """The scan in DuckDB's SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"

    def canon(x: str) -> str:
        x = f"translate(coalesce({x}, ''), '{UPPER}', '{LOWER}')"
        x = f"regexp_replace({x}, {quote(HOLDER_LINE)}, ' ', 'g')"
        x = f"' ' || regexp_replace({x}, '[^a-z0-9]+', '  ', 'g') || ' '"
        for a, b in SPELLINGS:
            x = f"replace({x}, {quote(_apart(a))}, {quote(b)})"
        return f"trim(regexp_replace({x}, ' +', ' ', 'g'), ' ')"

    values = ", ".join(f"({quote(d)}, {quote(n)})" for d, n in sorted(known().items()))
    return f"""
    WITH known(canonical_sha256, license_id) AS (VALUES {values}),
    whole AS (SELECT doc_id, sha256({canon('text')}) AS canonical_sha256, row_number() OVER () AS r, text FROM documents),
    lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM whole),
    named AS (SELECT r, string_agg(DISTINCT k.license_id, ',' ORDER BY k.license_id) AS notices
              FROM (SELECT r, sha256({canon('line')}) AS d FROM lines WHERE contains(translate(line, '{UPPER}', '{LOWER}'), '{NOTICE_MARK}')) l
              JOIN known k ON k.canonical_sha256 = l.d GROUP BY r)
    SELECT w.doc_id, w.canonical_sha256, k.license_id, coalesce(n.notices, '') AS notices
    FROM whole w LEFT JOIN known k USING (canonical_sha256) LEFT JOIN named n ON n.r = w.r"""
