"""The library's queries over the driver's tables, each with the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import analysis, stem
from quire.operators import compression, docsets, index, merge, present
from quire.operators.index import Collection
from quire.plans import boolean, ranked
from quire.session import scratch, table, written

_built: dict[tuple[str, str, str], Collection] = {}

QUERY = "that with the thorn ther idiot er that"
AND, OR, NOT, CNF, DNF, NONE = "that & with & ther", "idiot | clown | moron", "!the", "(that | der) & !(idiot | clown)", "(that & with) | (der & die) | (les & !des)", "!(the | der | le | el) | _"
NUMBERS = "5 3-7 3 12 9-8 4"
PATTERN, VERBATIM = "^Th[a-z]* ", "the th"
MARKED = ["the", "that", "der"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("docnum"), "text")


def collection(spark: SparkSession, sf_dir: str) -> Collection:
    """The documents' collection, built once for an application and kept in the shared folder."""
    return _kept(spark, sf_dir, "documents", documents)


def paragraph_collection(spark: SparkSession, sf_dir: str) -> Collection:
    """The collection of the documents' paragraphs, likewise."""
    return _kept(spark, sf_dir, "paragraphs", lambda spark, sf_dir: index.paragraphs(documents(spark, sf_dir)))


def stemmed_collection(spark: SparkSession, sf_dir: str) -> Collection:
    """The collection of stemmed terms, likewise."""
    return _kept(spark, sf_dir, "stems", documents, endings=stem.SHORT)


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("docnum"), "text")


def _kept(spark: SparkSession, sf_dir: str, name: str, docs: Callable[[SparkSession, str], DataFrame], **options: object) -> Collection:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _built:
        _built[key] = index.saved(docs(spark, sf_dir), scratch(spark, "collection"), **options)
    return _built[key]


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def _scored(df: DataFrame) -> DataFrame:
    return _rounded(df, "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# --- SQL parts -----------------------------------------------------------------------------------------------------

TOK = f"tok AS (SELECT docnum, lower(t) AS term FROM (SELECT doc_id AS docnum, unnest(regexp_extract_all(text, '{analysis.TERM}')) AS t FROM documents))"
BASE = f"""WITH {TOK},
p AS (SELECT term, docnum, count(*) AS f_dt FROM tok GROUP BY term, docnum),
l AS (SELECT term, count(*) AS f_t, sum(f_dt)::BIGINT AS cf_t FROM p GROUP BY term),
n AS (SELECT count(*)::DOUBLE AS n FROM documents),
w AS (SELECT docnum, sqrt(sum((f_dt * ln(n / f_t)) ** 2)) AS w FROM p JOIN l USING (term), n GROUP BY docnum)"""


def _query_terms(query: str, extra: str = "") -> str:
    words = query.lower().split()
    values = ", ".join(f"('{t}', {words.index(t)}, {words.count(t)})" for t in dict.fromkeys(words))
    return f"q AS (SELECT term, pos, f_qt, f_t, cf_t FROM (VALUES {values}) v(term, pos, f_qt) JOIN l USING (term) {extra})"


def _ranked_sql(query: str, *, extra: str = "", f_qt: str = "f_qt", f_dt: str = "f_dt", weight: str = "w", k: int = 10) -> str:
    return f"""{BASE}, {_query_terms(query, extra)},
    s AS (SELECT docnum, sum({f_qt} * ln(n / f_t) * {f_dt} * ln(n / f_t)) AS total FROM p JOIN q USING (term), n GROUP BY docnum)
    SELECT docnum, round(total / {weight}, 6) AS score FROM s JOIN w USING (docnum) WHERE total > 0 AND w > 0
    ORDER BY round(total / {weight}, 9) DESC, docnum LIMIT {k}"""


def _boolean_sql(query: str, select: str = "d.doc_id AS docnum", tail: str = "") -> str:
    tree = boolean.parse(query)
    terms = tree.terms()

    def text(node: boolean.Node) -> str:
        if node.kind == "term":
            return f"coalesce(t{terms.index(node.term)}, false)"
        if node.kind == "not":
            return f"NOT {text(node.parts[0])}"
        if node.kind in ("all", "none"):
            return "true" if node.kind == "all" else "false"
        return "(" + f" {node.kind.upper()} ".join(map(text, node.parts)) + ")"

    flags = ", ".join(f"bool_or(term = '{t}') AS t{k}" for k, t in enumerate(terms))
    return f"WITH {TOK}, h AS (SELECT docnum, {flags} FROM tok GROUP BY docnum) SELECT {select} FROM documents d LEFT JOIN h ON h.docnum = d.doc_id WHERE {text(tree)} {tail}"


# --- text analysis -------------------------------------------------------------------------------------------------


@_query(f"WITH {TOK} SELECT d.doc_id AS docnum, count(term) AS n_terms, count(DISTINCT term) AS n_distinct FROM documents d LEFT JOIN tok ON tok.docnum = d.doc_id GROUP BY d.doc_id")
def tokenize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms and different terms of each document."""
    found = analysis.terms(F.col("text"))
    return documents(spark, sf_dir).select("docnum", F.size(found).cast("long").alias("n_terms"), F.size(F.array_distinct(found)).cast("long").alias("n_distinct"))


_EDGES = ("1234567", "abc12345def", "foo_bar-9", "é7a", "", "a1b2c3d4e5f6")


@_query(f"""WITH r AS (SELECT doc_id, text FROM documents UNION ALL SELECT * FROM (VALUES {', '.join(f"({-k - 1}, '{t}')" for k, t in enumerate(_EDGES))}) v(doc_id, text)),
t AS (SELECT lower(unnest(regexp_extract_all(text, '{analysis.TERM}'))) AS term FROM r)
SELECT term, count(*) AS n FROM t WHERE regexp_matches(term, '[0-9]') GROUP BY term""")
def term_split_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms with digits, and how often they occur, with hand-made edge cases among the documents."""
    edges = spark.createDataFrame([(-k - 1, t) for k, t in enumerate(_EDGES)], "docnum long, text string")
    found = index.occurrences(documents(spark, sf_dir).unionByName(edges))
    return found.where(F.rlike("term", F.lit("[0-9]"))).groupBy("term").agg(F.count("*").alias("n"))


@_query(f"""WITH t AS (SELECT page_id AS docnum, lower(unnest(regexp_extract_all(regexp_replace(html, '<[^>]*>?', ' ', 'g'), '{analysis.TERM}'))) AS term FROM pages)
SELECT docnum, term, count(*) AS f_dt FROM t GROUP BY docnum, term""")
def sgml_strip_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of pages outside of tags."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("docnum"), F.col("html").alias("text"))
    return index.postings(pages, markup=True)


# --- index ---------------------------------------------------------------------------------------------------------


@_query(f"{BASE} SELECT term, f_t, cf_t FROM l")
def lexicon_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each term's documents and occurrences."""
    return collection(spark, sf_dir).lexicon


@_query(f"{BASE} SELECT term, docnum, f_dt FROM p")
def postings_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every posting."""
    return collection(spark, sf_dir).postings


@_query(f"""{BASE} SELECT (SELECT count(*) FROM documents) AS n_docs, (SELECT sum(strlen(text))::BIGINT FROM documents) AS n_bytes,
(SELECT max(strlen(text)) FROM documents) AS longest, sum(cf_t)::BIGINT AS n_words, count(*) AS n_terms FROM l""")
def collection_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The collection's counters."""
    return collection(spark, sf_dir).meta


@_query(f"{BASE} SELECT term, round(ln(n / f_t), 6) AS idf FROM l, n")
def idf_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inverse document frequency of each term."""
    c = collection(spark, sf_dir)
    return c.lexicon.select("term", F.round(F.log(F.lit(float(c.meta.first()["n_docs"])) / F.col("f_t")), 6).alias("idf"))


@_query(f"{BASE} SELECT docnum, round(w, 6) AS w FROM w")
def doc_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact weights."""
    return _rounded(collection(spark, sf_dir).weights, "w")


_APPROX = """e AS (SELECT min(w) FILTER (w > 0) AS low, max(w) AS high FROM w), b AS (SELECT low, (high / low) ** (1 / 64.0) AS base FROM e),
a AS (SELECT docnum, CASE WHEN w > 0 THEN least(floor(round(ln(w / low) / ln(base), 9)), 63) ELSE 0 END::BIGINT AS code, low, base FROM w, b)"""


@_query(f"{BASE}, {_APPROX} SELECT docnum, code, round(low * base ** code, 6) AS approx FROM a")
def approx_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights in six bits."""
    return _rounded(index.approximate_weights(collection(spark, sf_dir).weights), "approx")


@_query(f"""{BASE}, g AS (SELECT sum(0.99 + f_t * (1.6 + log2(n / f_t))) AS gap_bits FROM l, n),
c AS (SELECT sum(2 * floor(log2(f_dt)) + 1)::BIGINT AS gamma_bits, sum(f_dt)::BIGINT AS unary_bits FROM p) SELECT round(gap_bits, 3) AS gap_bits, gamma_bits, unary_bits FROM g, c""")
def index_size_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits that the inverted file would take."""
    c = collection(spark, sf_dir)
    return compression.index_sizes(c.postings, c.lexicon, c.meta.first()["n_docs"]).withColumn("gap_bits", F.round("gap_bits", 3))


# --- Boolean queries -----------------------------------------------------------------------------------------------


def _boolean(name: str, query: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return boolean.matches(collection(spark, sf_dir), query)

    def joined(spark: SparkSession, sf_dir: str) -> DataFrame:
        return boolean.matches_by_joins(collection(spark, sf_dir), query)

    run.__name__, joined.__name__ = f"boolean_{name}", f"boolean_{name}_joins"
    _query(_boolean_sql(query))(run)
    _query(_boolean_sql(query))(joined)


for _name, _text in (("term", "worthless"), ("and", AND), ("or", OR), ("not", NOT), ("cnf", CNF), ("dnf", DNF), ("none_of", NONE), ("all", "*"), ("nothing", "laserlaserlaser")):
    _boolean(_name, _text)


@_query(_boolean_sql(AND, tail="ORDER BY d.doc_id LIMIT 10"))
def boolean_maxdocs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten answers."""
    return boolean.answers(collection(spark, sf_dir), AND, 10)


@_query(_boolean_sql(AND, select="count(*) AS n"))
def boolean_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents answer."""
    return boolean.matches(collection(spark, sf_dir), AND).agg(F.count("*").alias("n"))


@_query(f"""{BASE}, m AS (SELECT sum(cf_t)::DOUBLE AS words FROM l)
SELECT docnum, round(sum(words / (100 * log2(cf_t + 1))), 6) AS weight FROM p JOIN l USING (term), m WHERE term IN ('idiot', 'clown', 'moron') GROUP BY docnum""")
def boolean_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A union's weights."""
    return _rounded(boolean.weighted(collection(spark, sf_dir), OR), "weight")


_A, _B = "that & with", "idiot | clown"


def _lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = collection(spark, sf_dir)
    return tuple(boolean.matches(c, q).withColumn("weight", F.lit(w)) for q, w in ((_A, 1.0), (_B, 2.0)))


_AB = f"WITH a AS ({_boolean_sql(_A)}), b AS ({_boolean_sql(_B)}) "


@_query(_AB + "SELECT docnum, 1.0::DOUBLE AS weight FROM a SEMI JOIN b USING (docnum)")
def list_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both answers' documents."""
    return docsets.intersection(*_lists(spark, sf_dir))


@_query(_AB + "SELECT docnum, 1.0::DOUBLE AS weight FROM a ANTI JOIN b USING (docnum)")
def list_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first answer's documents that the second lacks."""
    return docsets.difference(*_lists(spark, sf_dir))


@_query(_AB + "SELECT docnum, sum(weight)::DOUBLE AS weight FROM (SELECT docnum, 1.0 AS weight FROM a UNION ALL SELECT docnum, 2.0 FROM b) GROUP BY docnum")
def list_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Either answer's documents; weights add up."""
    return docsets.union(*_lists(spark, sf_dir))


# --- ranked queries ------------------------------------------------------------------------------------------------


@_query(_ranked_sql(QUERY))
def ranked_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best by cosine."""
    return _scored(ranked.ranked(collection(spark, sf_dir), QUERY))


@_query(_ranked_sql(QUERY, f_qt="1"))
def ranked_qfreq_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without the query's own counts."""
    return _scored(ranked.ranked(collection(spark, sf_dir), QUERY, qfreq=False))


@_query(_ranked_sql(QUERY, extra="ORDER BY f_t, pos LIMIT 3"))
def ranked_max_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the three rarest terms."""
    return _scored(ranked.ranked(collection(spark, sf_dir), QUERY, max_terms=3))


@_query(_ranked_sql(QUERY, f_dt="(cf_t // f_t)", weight="1"))
def ranked_level1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On an index without counts."""
    return _scored(ranked.ranked(collection(spark, sf_dir), QUERY, level=1))


@_query(_ranked_sql(QUERY).replace(f"{BASE}, ", f"{BASE}, {_APPROX}, ").replace("JOIN w USING (docnum)", "JOIN (SELECT docnum, low * base ** code AS w FROM a) x USING (docnum)"))
def approx_ranked_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By weights in six bits."""
    return _scored(ranked.approximately_ranked(collection(spark, sf_dir), QUERY))


_LIMITED = """o AS (SELECT term, row_number() OVER (ORDER BY f_t, pos) AS j FROM q), f AS (SELECT docnum, min(j) AS first FROM p JOIN o USING (term) GROUP BY docnum),
c AS (SELECT j, coalesce((SELECT count(*) FROM f WHERE first < o.j), 0) AS have FROM o), x AS (SELECT coalesce(min(j), 1000) AS cut FROM c WHERE have >= 300), """


@_query(_ranked_sql(QUERY).replace("s AS (", _LIMITED + "s AS (").replace("JOIN w USING (docnum)", "JOIN w USING (docnum) JOIN f USING (docnum), x").replace("WHERE total > 0", "WHERE first < cut AND total > 0"))
def ranked_accumulators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With at most about 300 accumulators, continued."""
    return _scored(ranked.limited(collection(spark, sf_dir), QUERY, 300))


_PARAGRAPHS = f"""WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
u0 AS (SELECT doc_id, unnest(parts) AS text, generate_subscripts(parts, 1) - 1 AS paragraph, len(parts) AS k FROM s),
u AS (SELECT doc_id * 16777216 + paragraph AS doc_id, text FROM u0 WHERE NOT (paragraph = k - 1 AND text = '')),
{BASE.removeprefix('WITH ').replace('FROM documents', 'FROM u')}, {_query_terms(QUERY)},
t AS (SELECT docnum, sum(f_qt * ln(n / f_t) * f_dt * ln(n / f_t)) AS total FROM p JOIN q USING (term), n GROUP BY docnum),
r AS (SELECT docnum, total / w AS score FROM t JOIN w USING (docnum) WHERE total > 0 AND w > 0 ORDER BY round(total / w, 9) DESC, docnum LIMIT 1000),
d AS (SELECT docnum // 16777216 AS doc, (docnum % 16777216)::INTEGER AS paragraph, score, row_number() OVER (PARTITION BY docnum // 16777216 ORDER BY round(score, 9) DESC, docnum) AS k FROM r)
SELECT doc AS docnum, paragraph, round(score, 6) AS score FROM d WHERE k = 1 ORDER BY round(d.score, 9) DESC, doc LIMIT 10"""


@_query(_PARAGRAPHS)
def ranked_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by their best paragraphs."""
    return _scored(ranked.by_paragraph(paragraph_collection(spark, sf_dir), QUERY))


@_query(f"""{BASE}, bt AS (SELECT item_id AS query_id, lower(unnest(regexp_extract_all(text, '{analysis.TERM}'))) AS term FROM benchmark),
bq AS (SELECT query_id, term, count(*) AS f_qt FROM bt GROUP BY query_id, term),
s AS (SELECT query_id, docnum, sum(f_qt * ln(n / f_t) * f_dt * ln(n / f_t)) AS total FROM p JOIN bq USING (term) JOIN l USING (term), n GROUP BY query_id, docnum),
r AS (SELECT query_id, docnum, total / w AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(total / w, 9) DESC, docnum)::INTEGER AS rank FROM s JOIN w USING (docnum) WHERE total > 0 AND w > 0)
SELECT query_id, docnum, round(score, 6) AS score, rank FROM r WHERE rank <= 3""")
def similarity_doc_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three documents nearest to each benchmark item."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return _scored(ranked.similar(collection(spark, sf_dir), items))


@_query(_ranked_sql(QUERY).replace("SELECT doc_id AS docnum, unnest", "SELECT conv_id * 1000 + turn AS docnum, unnest").replace("FROM documents", "FROM conversations"))
def conversations_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best turns."""
    return _scored(ranked.ranked(_kept(spark, sf_dir, "turns", turns), QUERY))


# --- numbers and presentation --------------------------------------------------------------------------------------


@_query("SELECT docnum::BIGINT AS docnum, weight::DOUBLE AS weight, position::BIGINT AS position FROM (VALUES (5, 2, 0), (3, 3, 1), (4, 1, 3), (6, 1, 5), (7, 1, 6), (12, 1, 8), (9, 1, 9)) v(docnum, weight, position) SEMI JOIN documents ON docnum = doc_id".replace("(4, 1, 3)", "(4, 2, 3)"))
def docnums_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by number and range."""
    return docsets.by_number(documents(spark, sf_dir), NUMBERS)


@_query(r"SELECT doc_id AS docnum, substr(ltrim(regexp_replace(split_part(text, chr(2), 1), '[ \t\n\x0B\f\r\x01\x03]+', ' ', 'g')), 1, 50) AS head FROM documents")
def heads_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's first 50 characters."""
    docs = documents(spark, sf_dir)
    return present.heads(docs, docs)


@_query(f"WITH a AS ({_boolean_sql(OR)}) SELECT docnum FROM a JOIN documents ON doc_id = docnum WHERE regexp_matches(text, '(?m){PATTERN}')")
def postfilter_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with a line that the pattern fits."""
    c = collection(spark, sf_dir)
    return present.filtered(boolean.matches(c, OR), c.docs, PATTERN)


@_query(f"WITH a AS ({_boolean_sql(OR)}) SELECT docnum FROM a JOIN documents ON doc_id = docnum WHERE contains(text, '{VERBATIM}')")
def postfilter_verbatim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with these very characters."""
    c = collection(spark, sf_dir)
    return present.filtered(boolean.matches(c, OR), c.docs, VERBATIM, verbatim=True)


def _marked_sql(text: str) -> str:
    words = "|".join(sorted(MARKED, key=lambda w: (-len(w), w)))
    for _ in range(2):  # a second time for words that share the separator between them
        text = f"regexp_replace({text}, '(^|[^A-Za-z0-9\\x01])({words})($|[^A-Za-z0-9\\x02])', '\\1' || chr(1) || '\\2' || chr(2) || '\\3', 'gi')"
    return f"replace(replace({text}, chr(1), '<B>'), chr(2), '</B>')"


@_query(f"WITH a AS ({_boolean_sql(OR)}) SELECT docnum, {_marked_sql('text')} AS text FROM a JOIN documents ON doc_id = docnum")
def hilite_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with words marked."""
    c = collection(spark, sf_dir)
    return present.highlighted(boolean.matches(c, OR), c.docs, MARKED)


@_query(f"WITH a AS ({_boolean_sql(OR)}) SELECT docnum, printf('%8d   %6.4f   %7d', docnum, 1.0::DOUBLE, strlen(text)) AS line FROM a JOIN documents ON doc_id = docnum")
def docnum_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers as lines of number, weight and length."""
    c = collection(spark, sf_dir)
    found = boolean.matches(c, OR).join(c.docs, "docnum").select("docnum", F.lit(1.0).alias("weight"), F.octet_length("text").alias("length"))
    return present.lines(found)


# --- merging -------------------------------------------------------------------------------------------------------


def _merged(spark: SparkSession, sf_dir: str, weights: str) -> Collection:
    docs = documents(spark, sf_dir)
    path = scratch(spark, "collection")
    old = index.saved(docs.where("docnum % 10 <> 0"), path)
    return merge.append(old, docs.where("docnum % 10 = 0"), weights=weights)


@_query(f"{BASE} SELECT docnum, round(w, 6) AS w FROM w")
def merge_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents appended to the others; all weights computed again."""
    return _rounded(_merged(spark, sf_dir, "exact").weights, "w")


@_query(f"""{BASE}, po AS (SELECT * FROM p WHERE docnum % 10 <> 0), lo AS (SELECT term, count(*) AS f_old FROM po GROUP BY term),
m AS (SELECT count(*)::DOUBLE AS m FROM documents WHERE doc_id % 10 <> 0),
x AS (SELECT docnum, f_dt * ln(m / f_old) AS v FROM po JOIN lo USING (term), m UNION ALL SELECT docnum, f_dt * ln(n / f_t) FROM p JOIN l USING (term), n WHERE docnum % 10 = 0)
SELECT docnum, round(sqrt(sum(v ** 2)), 6) AS w FROM x GROUP BY docnum""")
def merge_stale_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the old documents' weights kept."""
    return _rounded(_merged(spark, sf_dir, "stale").weights, "w")


@_query(f"{BASE} SELECT term, f_t, cf_t FROM l")
def merge_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merged lexicon."""
    return _merged(spark, sf_dir, "stale").lexicon


# --- compression model ---------------------------------------------------------------------------------------------


_RUNS = "[0-9A-Za-z]+|[^0-9A-Za-z]+"
#: Tokens as hexadecimal digits: runs of one kind, long ones cut step by step.
TOKENS = f"""RECURSIVE runs AS (SELECT unnest(regexp_extract_all(text, '{_RUNS}')) AS run FROM documents),
counted AS (SELECT run, regexp_matches(run, '^[0-9A-Za-z]')::INT AS kind, count(*) AS freq FROM runs GROUP BY run),
cut AS (SELECT kind, freq, run, hex(encode(run)) AS rest, '' AS tok, 0 AS k FROM counted
        UNION ALL SELECT kind, freq, run, substr(rest, n + 1), left(rest, n), k + 1
        FROM (SELECT *, CASE WHEN kind = 0 THEN least(30, length(rest)) ELSE least(30, length(regexp_extract(rest, '^(?:[4-7][0-9A-F])*(?:3[0-9](?:[4-7][0-9A-F])*){{0,{compression.DIGITS}}}'))) END AS n FROM cut WHERE rest <> '')),
toks AS (SELECT kind, tok, sum(freq)::BIGINT AS freq FROM (SELECT kind, tok, freq FROM cut WHERE k > 0 UNION ALL SELECT 1 - kind, '', freq FROM cut WHERE k > 1) GROUP BY kind, tok)"""


def _hex(df: DataFrame) -> DataFrame:
    return df.select("kind", F.hex("tok").alias("tok"), "freq")


def _token_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, "tokens")
    if key not in _built:
        _built[key] = written(compression.token_statistics(documents(spark, sf_dir)), "tokens")
    return _built[key]


@_query(f"WITH {TOKENS} SELECT kind, tok, freq FROM toks")
def comp_token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequencies of compression tokens."""
    return _hex(compression.token_statistics(documents(spark, sf_dir)))


_CHOSEN = f"""{TOKENS}, sized AS (SELECT *, coalesce(sum(length(tok) // 2 + 8) OVER (PARTITION BY kind ORDER BY freq DESC, length(tok), tok ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM toks),
chosen AS (SELECT kind, tok, freq FROM sized WHERE before < 64 * 1024)"""


@_query(f"WITH {_CHOSEN} SELECT kind, tok, freq FROM chosen")
def dict_select_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 64 KB dictionary of the most frequent tokens."""
    return _hex(compression.dictionary(_token_statistics(spark, sf_dir), 64))


@_query(f"WITH {_CHOSEN} SELECT kind, tok, freq FROM toks ANTI JOIN chosen USING (kind, tok)")
def dict_novel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens that this dictionary lacks."""
    stats = _token_statistics(spark, sf_dir)
    return _hex(compression.novel(stats, compression.dictionary(stats, 64)))


@_query(f"""WITH {_CHOSEN}, n AS (SELECT kind, sum(freq) AS total, min(freq) AS least FROM toks GROUP BY kind), e AS (SELECT kind, sum(freq) AS freq FROM toks ANTI JOIN chosen USING (kind, tok) GROUP BY kind)
SELECT kind, count(*) AS n, 1.0::DOUBLE AS kraft, true AS close FROM (SELECT kind FROM chosen UNION ALL SELECT kind FROM e) GROUP BY kind""")
def dict_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dictionary's codes: how many, whether they use up all bit strings (Kraft's sum is 1) and come within a bit a token of the entropy."""
    stats = _token_statistics(spark, sf_dir)
    chosen = compression.dictionary(stats, 64)
    codes_ = compression.coded(chosen, compression.novel(stats, chosen))
    total = codes_.groupBy("kind").agg(F.sum("freq").alias("total"))
    each = codes_.join(total, "kind").withColumn("least", -F.log2(F.col("freq") / F.col("total")))
    return each.groupBy("kind").agg(
        F.count("*").alias("n"),
        F.round(F.sum(F.pow(F.lit(2.0), -F.col("bits"))), 9).alias("kraft"),
        (F.sum(F.col("freq") * F.col("bits")) < F.sum(F.col("freq") * (F.col("least") + 1))).alias("close"),
    )


@_query(f"""WITH {_CHOSEN}, aside AS (SELECT tok, freq, row_number() OVER (ORDER BY freq DESC, kind, tok) + 1 AS x FROM toks ANTI JOIN chosen USING (kind, tok)),
low AS (SELECT *, floor(log2(x))::BIGINT AS lo FROM aside)
SELECT sum(freq * (2 * floor(log2(lo + 1)) + 1 + lo))::BIGINT AS novel_bits, sum(8 * (length(tok) // 2 + 1))::BIGINT AS spelling_bits, 5.5 * (SELECT count(*) FROM documents)::DOUBLE AS end_bits FROM low""")
def comp_size_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimated bits of novel tokens, their spelling and the documents' ends."""
    stats = _token_statistics(spark, sf_dir)
    chosen = compression.dictionary(stats, 64)
    return compression.compressed_size(chosen, compression.novel(stats, chosen), documents(spark, sf_dir).count()).drop("code_bits")


@_query(f"""WITH {TOKENS}, n AS (SELECT kind, sum(freq) AS total FROM toks GROUP BY kind) SELECT kind, round(sum(-freq * log2(freq / total)), 3) AS bits FROM toks JOIN n USING (kind) GROUP BY kind""")
def token_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least bits that a code of the tokens takes."""
    return compression.entropy(_token_statistics(spark, sf_dir)).select("kind", F.round("bits", 3).alias("bits"))


@_query("""WITH r AS (SELECT row_number() OVER (ORDER BY doc_id) AS n, sum(strlen(text)) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS b FROM documents)
SELECT (b // 65536)::BIGINT AS chunk, max(n)::BIGINT AS n_docs, max(b)::BIGINT AS n_bytes FROM r GROUP BY ALL""")
def text_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and bytes so far, at each 64 KB."""
    return compression.growth(documents(spark, sf_dir), 64)
