"""Further registered queries: sources, sessions, stemming, paragraphs, codes, saved collections and marks, each with the same in DuckDB's SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import codes, stem
from quire.operators import codecs, compression, docsets, index, marks, merge, present
from quire.plans import boolean, ranked
from quire.plans.session import Session
from quire.queries import (
    _APPROX, _LIMITED, _PARAGRAPHS, AND, BASE, CNF, NUMBERS, OR, ORACLE_SQL, QUERIES, QUERY, TOK, _boolean_sql, _query, _ranked_sql, _rounded, _scored,
    collection, documents, paragraph_collection, stemmed_collection,
)
from quire.session import scratch, table
from quire.sources import images, registry
from quire.sources import text as sources

__all__ = ["ORACLE_SQL", "QUERIES"]

# --- sources -------------------------------------------------------------------------------------------------------


def _digested(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, F.md5(F.col("text").cast("binary")).alias("text_md5"))


@_query("SELECT row_number() OVER (ORDER BY lang || lpad(n_chars::VARCHAR, 9, '0') || lpad(doc_id::VARCHAR, 12, '0')) AS docnum, doc_id FROM documents")
def source_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents numbered in the order of a key."""
    key = F.concat("lang", F.lpad(F.col("n_chars").cast("string"), 9, "0"), F.lpad(F.col("doc_id").cast("string"), 12, "0"))
    return index.numbered(table(spark, sf_dir, "documents").select("doc_id", key.alias("key")), "key").select("docnum", "doc_id")


@_query("SELECT md5(text) AS text_md5, count(*) AS n FROM documents GROUP BY 1")
def source_delimited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records up to an end mark, written to files and read back through a registered source."""
    path = scratch(spark, "records")
    documents(spark, sf_dir).select("text").write.option("lineSep", sources.END).text(path)
    found = registry.documents(spark, registry.parsed(f"# records\nown\tPLAIN\t{path}")["own"])
    return _digested(found).groupBy("text_md5").agg(F.count("*").alias("n"))


def _cut(kind: str, mark: str, sql: str, first: str = "") -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        text = F.concat(F.lit(first), F.replace(F.col("text"), F.lit(". "), F.lit(mark)))
        files = documents(spark, sf_dir).select(F.col("docnum").alias("file"), text.alias("text"))
        return _digested(sources.cut(files, kind), "file", "part")

    run.__name__ = f"source_{kind}"
    quote = lambda s: " || ".join("chr(10)" if p == "\n" else f"'{p}'" for p in re.split("(\n)", s) if p) or "''"
    text = f"{quote(first)} || replace(text, '. ', {quote(mark)})"
    _query(f"""WITH t AS (SELECT doc_id AS file, {sql.format(text=text)} AS parts FROM documents),
    p AS (SELECT file, unnest(parts) AS text, generate_subscripts(parts, 1) - 1 AS part FROM t)
    SELECT file, part::INTEGER AS part, md5(text) AS text_md5 FROM p WHERE trim(text) <> ''""")(run)


_before = "string_split(regexp_replace({{text}}, '\\n({0})', chr(10) || chr(1) || '\\1', 'g'), chr(1))"
_cut("linesep", ".\n  *****************  \n", r"regexp_split_to_array({text}, '(?m)^.*\*{{17}}.*\n?')")
_cut("para", ".\n \n\n", r"regexp_split_to_array({text}, '\n(?: *\n)+')")
_cut("bib", ".\n@x ", _before.format("@"))
_cut("mail", ".\nFrom x\n", _before.format("From ").replace("{text}", r"regexp_replace({text}, '(?ms)^xbtoa Begin.*?^xbtoa End[^\n]*\n?', '', 'g')"), "xbtoa Begin a\nb\nxbtoa End z\n")


def _folder(spark: SparkSession, sf_dir: str) -> str:
    """The benchmark items as files of a folder each."""
    path = scratch(spark, "files")
    table(spark, sf_dir, "benchmark").select("item_id", "text").repartition("item_id").write.partitionBy("item_id").text(path)
    return path


@_query("SELECT item_id, true AS named, md5(text || chr(10)) AS text_md5 FROM benchmark")
def source_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a folder as documents, each with its path in front."""
    found = registry.documents(spark, registry.parsed(f"own\tDIR\t{_folder(spark, sf_dir)}")["own"])
    head = F.concat(F.lit("< "), "file", F.lit(" >\n"))
    item = F.regexp_extract("file", "item_id=([0-9]+)", 1).cast("long")
    return _digested(found.select(item.alias("item_id"), F.startswith("text", head).alias("named"), F.substr("text", F.length(head) + 1).alias("text")), "item_id", "named")


@_query("SELECT item_id, md5(text || chr(10)) AS text_md5 FROM benchmark")
def source_dir2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a folder as documents."""
    found = registry.documents(spark, registry.parsed(f"own\tDIR2\t{_folder(spark, sf_dir)}")["own"])
    return _digested(found.select(F.regexp_extract("file", "item_id=([0-9]+)", 1).cast("long").alias("item_id"), "text"), "item_id")


@_query("""SELECT 'a/' || item_id AS base, md5(CASE item_id % 3 WHEN 0 THEN 'Image(s) available: ' || item_id || '.pbm ' || item_id || '.pgm' || chr(10) WHEN 1 THEN 'Image(s) available: ' || item_id || '.ptm' || chr(10) ELSE '' END || text) AS text_md5 FROM benchmark""")
def source_txtimg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with the names of images that lie beside them."""
    items = table(spark, sf_dir, "benchmark").withColumn("base", F.concat(F.lit("a/"), "item_id"))
    kinds = F.when(F.col("item_id") % 3 == 0, F.array(F.lit(".pgm"), F.lit(".pbm"))).when(F.col("item_id") % 3 == 1, F.array(F.lit(".ptm"))).otherwise(F.array().cast("array<string>"))
    pictures = items.select(F.explode(F.transform(kinds, lambda k: F.concat("base", k))).alias("file"))
    return _digested(sources.with_images(items.select(F.concat("base", F.lit(".txt")).alias("file"), "text"), pictures), "base")


@_query(_ranked_sql(QUERY).replace("SELECT docnum, round", "SELECT CASE WHEN docnum % 2 = 0 THEN 'D-' || docnum ELSE 'NO DOC ID ' || docnum END AS name, docnum, round"))
def trec_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked answers with the names that their documents carry."""
    tag = F.concat(F.lit("<DOCNO> D-"), "docnum", F.lit(" </DOCNO>\n"))
    names = sources.record_names(documents(spark, sf_dir).select("docnum", F.when(F.col("docnum") % 2 == 0, F.concat(tag, "text")).otherwise(F.col("text")).alias("text")))
    return _scored(present.with_names(ranked.ranked(collection(spark, sf_dir), QUERY), names, "score").withColumnRenamed("weight", "score"))


@_query("SELECT doc_id AS docnum, md5(text || chr(2)) AS text_md5 FROM documents")
def whole_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in order, with its end mark."""
    return _digested(present.whole(collection(spark, sf_dir).docs), "docnum")


@_query("SELECT * FROM (VALUES (1, 3, 2, 255, 'P2', '0007FF010203'), (2, NULL, NULL, NULL, NULL, NULL), (3, 9, 1, 1, 'P1', '010000000000000001')) v(image, width, height, most, kind, pixels)")
def image_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graymaps and bitmaps, one of them damaged."""
    raw = [("1", b"P2 # grey\n3 2\n255\n0 7 255\n1 2 3\n"), ("2", b"P5\n9 9\n255\n..."), ("3", b"P4\n9 1\n\x80\x80")]
    found = images.parsed(spark.createDataFrame(raw, "path string, content binary"))
    return found.select(F.col("file").cast("int").alias("image"), "width", "height", "most", F.replace("kind", F.lit("4"), F.lit("1")).alias("kind"), F.hex("pixels").alias("pixels"))


# --- sessions ------------------------------------------------------------------------------------------------------


def _session(spark: SparkSession, sf_dir: str, script: str, *, paragraphs: bool = False) -> DataFrame:
    own = Session(collection(spark, sf_dir), paragraph_collection(spark, sf_dir) if paragraphs else None)
    return own.read(script)[-1]


def _weighed(df: DataFrame) -> DataFrame:
    return df.select("docnum", F.round("weight", 6).alias("score"))


@_query(_ranked_sql(QUERY, extra="ORDER BY f_t, pos LIMIT 3", k=5))
def session_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A script of settings and a query that goes on in a second line."""
    head, tail = QUERY.rsplit(" ", 1)
    return _weighed(_session(spark, sf_dir, f".set query ranked\n.set maxdocs 5\n.push\n.set maxdocs 1\n.pop\n.set max_terms 3\n.set max_accumulators all\n{head}\\\n{tail}"))


@_query(ORACLE_SQL["ranked_accumulators"])
def session_accumulators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session with a limit of accumulators that goes on."""
    return _weighed(_session(spark, sf_dir, f".set query ranked\n.set maxdocs 10\n.set max_accumulators 300\n{QUERY}"))


_STOPPED = _ranked_sql(QUERY).replace("s AS (", _LIMITED + "s AS (").replace("FROM p JOIN q USING (term), n", "FROM p JOIN q USING (term) JOIN o USING (term), n, x WHERE j < cut")
_STOPPED = _STOPPED.replace("JOIN w USING (docnum)", "JOIN w USING (docnum) JOIN f USING (docnum), x").replace("WHERE total > 0", "WHERE first < cut AND total > 0")


@_query(_STOPPED)
def session_stopped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session that takes no further term when its accumulators are full."""
    return _weighed(_session(spark, sf_dir, f".set query ranked\n.set maxdocs 10\n.set max_accumulators 300\n.set stop_at_max_accum on\n{QUERY}"))


@_query(_ranked_sql(QUERY, f_qt="1").replace(f"{BASE}, ", f"{BASE}, {_APPROX}, ").replace("JOIN w USING (docnum)", "JOIN (SELECT docnum, low * base ** code AS w FROM a) x USING (docnum)"))
def session_approximate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session's approximate ranking without the query's own counts."""
    return _weighed(_session(spark, sf_dir, f".set query approx-ranked\n.set maxdocs 10\n.set qfreq off\n.set max_accumulators all\n{QUERY}"))


@_query(_PARAGRAPHS.replace("LIMIT 1000", "LIMIT 40").replace("SELECT doc AS docnum, paragraph, ", "SELECT doc AS docnum, ").replace("LIMIT 10", "LIMIT 6"))
def session_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session over paragraphs: the best 40 of them, then the best 6 documents."""
    return _weighed(_session(spark, sf_dir, f".set query ranked\n.set maxparas 40\n.set maxdocs 6\n{QUERY}", paragraphs=True))


@_query(" UNION ALL ".join(f"SELECT {k} AS optimise, * FROM ({_boolean_sql(CNF)})" for k in (0, 1, 2)))
def session_optimise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Boolean query under each way to plan it."""
    one, two, three = (_session(spark, sf_dir, f".set optimise_type {k}\n{CNF}").select(F.lit(k).alias("optimise"), "docnum") for k in (0, 1, 2))
    return one.unionByName(two).unionByName(three)


@_query(f"WITH a AS ({_boolean_sql(OR)}) SELECT docnum, substr(ltrim(regexp_replace(split_part(text, chr(2), 1), '[ \\t\\n\\x0B\\f\\r\\x01\\x03]+', ' ', 'g')), 1, 20) AS head FROM a JOIN documents ON doc_id = docnum WHERE contains(text, 'er th')")
def session_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heads of the answers that pass a post-filter within the query line."""
    return _session(spark, sf_dir, f'.set mode heads\n.set heads_length 20\n.set verbatim on\n{OR} "er th"')


@_query(ORACLE_SQL["docnums_query"].replace("SELECT docnum::BIGINT AS docnum, weight::DOUBLE AS weight, position::BIGINT AS position", "SELECT docnum::BIGINT AS docnum, weight::DOUBLE AS weight, md5(text) AS text_md5").replace("SEMI JOIN", "JOIN"))
def session_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of documents by number."""
    return _digested(_session(spark, sf_dir, f".set query docnums\n{NUMBERS}"), "docnum", "weight")


@_query(f"WITH a AS ({_boolean_sql(OR)}) SELECT docnum, count(*) AS n FROM (SELECT docnum FROM a UNION ALL SELECT docnum FROM a UNION ALL SELECT docnum FROM ({_boolean_sql(AND)})) GROUP BY docnum")
def session_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that go to a folder, one after the other."""
    path = scratch(spark, "answers")
    own = Session(collection(spark, sf_dir))
    own.read(f".output > {path}\n{OR}\n{OR}\n.output\n.output >> {path}\n{AND}\n.quit\n{AND}")
    return spark.read.json(path).groupBy("docnum").agg(F.count("*").alias("n"))


@_query(f"SELECT docnum, score, round(score / max(score) OVER () * 99 + 1)::INTEGER AS percent FROM ({_ranked_sql(QUERY)})")
def ranked_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked answers with weights from 1 to 100."""
    return _scored(ranked.percent(ranked.ranked(collection(spark, sf_dir), QUERY)))


@_query(f"""{BASE}, h AS (SELECT * FROM p WHERE term IN ({', '.join(f"'{t}'" for t in QUERY.split())}))
SELECT (SELECT count(DISTINCT term) FROM h) AS terms, count(*) AS pointers, count(DISTINCT docnum) AS accumulators, 10::BIGINT AS answers, 10::BIGINT AS lookups FROM h""")
def query_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a ranked query took."""
    return ranked.statistics(collection(spark, sf_dir), QUERY)


@_query("SELECT * FROM (VALUES (0, 'and'), (1, '  or'), (2, '    that'), (3, '    with'), (4, '  or'), (5, '    and'), (6, '      der'), (7, '      die'), (8, '    not'), (9, '      les')) v(line, node)")
def boolean_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query's tree."""
    lines = boolean.tree_lines(boolean.parse("(that | with) & (der die | !les)"))
    return spark.createDataFrame(list(enumerate(lines)), "line int, node string")


@_query("SELECT n, text FROM (VALUES (1, 'a' || chr(9) || 'b' || chr(10)), (2, chr(65) || 'Z' || chr(65) || '8'), (3, 'x\\y\\'), (4, 'q''\"')) v(n, text)")
def escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Escapes of settings."""
    raw = [r"a\tb\n", r"\x41Z\1018", r"\qx\\y" + "\\", r"q\'\""]
    return spark.createDataFrame([(n, present.unescaped(t)) for n, t in enumerate(raw, 1)], "n int, text string")


# --- paragraphs, the lexicon's order, stems ------------------------------------------------------------------------


@_query("SELECT doc_id AS docnum, (len(string_split(text, chr(10))) - CASE WHEN text = '' OR ends_with(text, chr(10)) THEN 1 ELSE 0 END)::BIGINT AS n_paragraphs FROM documents")
def paragraph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of each document."""
    return index.paragraph_counts(documents(spark, sf_dir))


_UNITS = "s AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents), u0 AS (SELECT doc_id, unnest(parts) AS text, generate_subscripts(parts, 1) - 1 AS paragraph, len(parts) AS k FROM s), u AS (SELECT doc_id * 16777216 + paragraph AS doc_id, text FROM u0 WHERE NOT (paragraph = k - 1 AND text = ''))"


@_query(f"WITH {_UNITS}, a AS ({_boolean_sql(AND).replace('FROM documents', 'FROM u')}) SELECT docnum // 16777216 AS docnum, min(docnum % 16777216)::INTEGER AS paragraph FROM a GROUP BY 1")
def boolean_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first paragraph of each document that answers."""
    doc, paragraph = index.paragraph_of(F.col("docnum"))
    return docsets.first_paragraphs(boolean.matches(paragraph_collection(spark, sf_dir), AND).select(doc.alias("docnum"), paragraph.alias("paragraph")))


@_query(f"""{BASE}, o AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS term_no, lag(term) OVER (ORDER BY term) AS last FROM l)
SELECT term_no, term, CASE WHEN last IS NULL THEN 0 ELSE len(list_filter(range(1, length(term) + 1), lambda k: starts_with(last, substr(term, 1, k)))) END::BIGINT AS prefix FROM o""")
def lexicon_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms in order, with what each shares with the one before."""
    return index.term_numbers(collection(spark, sf_dir).lexicon)


def _stem_sql(terms: str) -> str:
    """A table stems(term, stem) of the table ``terms``."""
    values = ", ".join(f"('{e}', '{r}', '{stem.RULES[r] if r != 'BB' else '...'}$')" for e, r in stem.SHORT)
    doubled = "|".join(2 * c for c in stem.DOUBLED)
    whens = " ".join(f"WHEN regexp_matches(bare, '{f'(^|[^{never}])' if never else ''}{end}$') THEN left(bare, length(bare) - {len(end)}) || '{new}'" for end, new, never in stem.REWRITES)
    return f"""endings(ending, rule, test) AS (VALUES {values}),
    fits AS (SELECT term, max(length(ending)) AS n FROM {terms} JOIN endings ON ends_with(term, ending) AND length(term) >= length(ending) + 2
             AND regexp_matches(left(term, length(term) - length(ending)), test) AND (rule <> 'BB' OR NOT regexp_matches(left(term, length(term) - length(ending)), '(?:^met|ryst)$')) GROUP BY term),
    cut AS (SELECT term, left(term, length(term) - coalesce(n, 0)) AS part FROM {terms} LEFT JOIN fits USING (term)),
    single AS (SELECT term, CASE WHEN regexp_matches(part, '({doubled})$') THEN left(part, length(part) - 1) ELSE part END AS bare FROM cut),
    stems AS (SELECT term, CASE WHEN length(term) <= 2 THEN term {whens} ELSE bare END AS stem FROM single)"""


@_query(f"{BASE}, {_stem_sql('l')} SELECT term, stem FROM stems")
def stem_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every term's stem."""
    return collection(spark, sf_dir).lexicon.select("term", stem.stem(F.col("term"), stem.SHORT).alias("stem"))


_STEMMED = BASE.replace("p AS (", f"v AS (SELECT DISTINCT term FROM tok), {_stem_sql('v')}, p AS (").replace("SELECT term, docnum, count(*) AS f_dt FROM tok GROUP BY term, docnum", "SELECT stem AS term, docnum, count(*) AS f_dt FROM tok JOIN stems USING (term) GROUP BY stem, docnum")
_STEM_QUERY = "idiots thing thinged the"


def _stemmed_sql() -> str:
    words = [stem.stemmed(w, stem.SHORT) for w in _STEM_QUERY.split()]
    return _ranked_sql(" ".join(words)).replace(BASE, _STEMMED)


@_query(_stemmed_sql())
def ranked_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best by stems."""
    return _scored(ranked.ranked(stemmed_collection(spark, sf_dir), _STEM_QUERY))


@_query(_boolean_sql(" & ".join(dict.fromkeys(stem.stemmed(w, stem.SHORT) for w in ("idiots", "things")))).replace(TOK, TOK.replace("tok AS", "raw AS") + f", {_stem_sql('(SELECT DISTINCT term FROM raw)')}, tok AS (SELECT docnum, stem AS term FROM raw JOIN stems USING (term))"))
def boolean_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conjunction of stems."""
    return boolean.matches(stemmed_collection(spark, sf_dir), "idiots & things")


_MARKED_STEMS = [stem.stemmed(w, stem.SHORT) for w in ("things", "idiots")]


@_query(f"""WITH a AS ({_boolean_sql(OR)}), parts AS (SELECT docnum, unnest(list) AS p, generate_subscripts(list, 1) AS k FROM (SELECT docnum, regexp_extract_all(text, '[A-Za-z0-9]+|[^A-Za-z0-9]+') AS list FROM a JOIN documents ON doc_id = docnum)),
words AS (SELECT DISTINCT lower(p) AS term FROM parts WHERE regexp_matches(p, '^[A-Za-z0-9]')), {_stem_sql('words')}, hits AS (SELECT term FROM stems WHERE stem IN ({', '.join(f"'{w}'" for w in _MARKED_STEMS)}))
SELECT docnum, md5(string_agg(CASE WHEN lower(p) IN (SELECT term FROM hits) THEN '<EM>' || p || '</EM>' ELSE p END, '' ORDER BY k)) AS text_md5 FROM parts GROUP BY docnum""")
def hilite_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with the words marked that have these stems."""
    c = collection(spark, sf_dir)
    return _digested(present.highlighted(boolean.matches(c, OR), c.docs, _MARKED_STEMS, "EM", stem.SHORT), "docnum")


# --- codes, dictionaries, saved collections ------------------------------------------------------------------------


@_query(f"""{BASE}, c AS (SELECT term, f_t, floor(log2(f_t))::BIGINT AS lo, n::BIGINT AS n, greatest(floor(0.5 + {codes.LN2} * n / f_t), 1)::BIGINT AS b FROM l, n),
d AS (SELECT *, CASE WHEN b > 1 THEN floor(log2(b - 1))::BIGINT + 1 ELSE 0 END AS full_b, CASE WHEN n > 1 THEN floor(log2(n - 1))::BIGINT + 1 ELSE 0 END AS full_n FROM c)
SELECT term, f_t AS unary, CASE WHEN f_t <= 2 ** full_n - n THEN full_n - 1 ELSE full_n END::BIGINT AS fixed, 2 * lo + 1 AS gamma, (2 * floor(log2(lo + 1)) + 1 + lo)::BIGINT AS delta,
       ((f_t - 1) // b + 1 + CASE WHEN (f_t - 1) % b + 1 <= 2 ** full_b - b THEN full_b - 1 ELSE full_b END)::BIGINT AS block FROM d""")
def code_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits of each term's f_t in the integer codes."""
    c = collection(spark, sf_dir)
    n, f = F.lit(c.meta.first()["n_docs"]), F.col("f_t")
    sizes = {"unary": codes.unary(f), "fixed": codes.binary(f, n), "gamma": codes.gamma(f), "delta": codes.delta(f), "block": codes.block(f, codes.block_size(n, f))}
    return c.lexicon.select("term", *(x.cast("long").alias(k) for k, x in sizes.items()))


@_query(f"""{BASE}, d AS (SELECT term FROM l ORDER BY cf_t DESC, term LIMIT 500), x AS (SELECT docnum, sum(f_dt)::BIGINT AS n_terms, coalesce(sum(f_dt) FILTER (WHERE d.term IS NOT NULL), 0)::BIGINT AS n_coded FROM p LEFT JOIN d USING (term) GROUP BY docnum)
SELECT docnum, n_terms, n_coded FROM x""")
def dictionary_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of each document's terms the 500 most frequent ones hold."""
    c = collection(spark, sf_dir)
    chosen = c.lexicon.orderBy(F.desc("cf_t"), "term").limit(500).select("term", F.lit(1).alias("there"))
    joined = c.postings.join(F.broadcast(chosen), "term", "left")
    return joined.groupBy("docnum").agg(F.sum("f_dt").alias("n_terms"), F.coalesce(F.sum(F.when(F.col("there") == 1, F.col("f_dt"))), F.lit(0)).alias("n_coded"))


def _grown(spark: SparkSession, sf_dir: str, **options: object) -> index.Collection:
    docs, path = documents(spark, sf_dir), scratch(spark, "collection")
    index.saved(docs.where("docnum % 10 <> 0"), path)
    merge.append_saved(path, docs.where("docnum % 20 = 0"))
    return merge.append_saved(path, docs.where("docnum % 20 = 10"), **options)


@_query(ORACLE_SQL["merge_append"])
def append_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches appended to a saved collection; the last computes all weights anew."""
    return _rounded(_grown(spark, sf_dir, weights="exact").weights, "w")


@_query(f"{BASE} SELECT term, f_t, cf_t FROM l")
def append_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lexicon of a saved collection after two batches."""
    return _grown(spark, sf_dir).lexicon


@_query(ORACLE_SQL["collection_stats"])
def append_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counters of a saved collection after two batches."""
    return _grown(spark, sf_dir).meta


@_query("SELECT row_number() OVER (ORDER BY doc_id) + (SELECT max(doc_id) FROM documents WHERE doc_id % 10 <> 0) AS docnum, md5(text) AS text_md5 FROM documents WHERE doc_id % 10 = 0 UNION ALL SELECT doc_id, md5(text) FROM documents WHERE doc_id % 10 <> 0")
def append_renumbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New documents that get numbers after the last."""
    docs, path = documents(spark, sf_dir), scratch(spark, "collection")
    index.saved(docs.where("docnum % 10 <> 0"), path)
    return _digested(merge.append_saved(path, docs.where("docnum % 10 = 0"), renumber=True).docs, "docnum")


@_query("SELECT name FROM (VALUES ('docs'), ('postings'), ('lexicon'), ('weights'), ('meta')) v(name)")
def collection_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables of a saved collection whose files have a size and a share of the text."""
    path = scratch(spark, "collection")
    index.saved(documents(spark, sf_dir), path)
    return compression.report(path, spark).where("bytes > 0 and percent > 0").select("name")


# --- marks of scanned text -----------------------------------------------------------------------------------------

#: A page with marks that touch at corners, one within another, and two of one shape. Fixed fixture.
PAGE = ("XX..XXXXX", "X...X...X", "..X.X.X.X", ".X..X...X", "....XXXXX", ".........", "XX....XXX", "X.....X.X")


def _marks(spark: SparkSession) -> DataFrame:
    rows = b"P1\n%d %d\n" % (len(PAGE[0]), len(PAGE)) + "\n".join(" ".join("1" if c == "X" else "0" for c in row) for row in PAGE).encode()
    return marks.extracted(images.parsed(spark.createDataFrame([("page", rows)], "path string, content binary")))


_MARKS = "(VALUES (0, 0, 0, 2, 2, 3, 0, 0), (1, 4, 0, 5, 5, 16, 2, 2), (2, 1, 2, 2, 2, 2, 0, 0), (3, 6, 2, 1, 1, 1, 0, 0), (4, 0, 6, 2, 2, 3, 0, 0), (5, 6, 6, 3, 2, 5, 1, 0)) v(mark, xpos, ypos, width, height, area, xcen, ycen)"


@_query(f"SELECT mark, xpos, ypos, width, height, area, xcen, ycen FROM {_MARKS}")
def marks_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected marks with their features."""
    return _marks(spark).select("mark", "xpos", "ypos", "width", "height", "area", "xcen", "ycen")


@_query(f"SELECT mark, row_number() OVER (ORDER BY ypos > 4, xpos, ypos)::INTEGER AS position FROM {_MARKS}")
def marks_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks in reading order."""
    return marks.in_reading_order(_marks(spark), 2).select("mark", "position")


@_query(f"SELECT mark, 0::BIGINT AS score FROM {_MARKS} WHERE mark IN (0, 4)")
def marks_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks that a library of symbols found at least twice holds, with their differences."""
    found = _marks(spark)
    return marks.matched(found, marks.pruned(marks.library(found)), 0).select("mark", "score")


@_query(f"SELECT upto, count(*) FILTER (WHERE area <= upto) AS n FROM {_MARKS}, (SELECT unnest([1, 2, 4, 9, 16, 25, 36, 49, 64, 81, 100])::INTEGER AS upto) GROUP BY upto")
def marks_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many marks are small."""
    return marks.area_histogram(_marks(spark))


@_query(f"SELECT count(*) AS n, floor(avg(area))::BIGINT AS area, floor(avg(xcen))::BIGINT AS xcen, floor(avg(ycen))::BIGINT AS ycen, floor(avg(width))::BIGINT AS width, floor(avg(height))::BIGINT AS height FROM {_MARKS}")
def marks_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over marks."""
    return marks.library_statistics(_marks(spark)).drop("h_runs", "v_runs")


@_query("SELECT doc_id, 64::INTEGER AS width, greatest(ceil(strlen(text) / 64), 1)::INTEGER AS height, md5(text) AS text_md5 FROM documents")
def image_grey_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts' bytes as grey images of 64 columns, in strips, coded and decoded."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = documents(spark, sf_dir)
    height = F.greatest(F.ceil(F.length(text) / 64), F.lit(1)).cast("int")
    pages = docs.select(F.col("docnum").cast("string").alias("file"), F.lit(64).alias("width"), height.alias("height"), F.lit(255).alias("most"), F.rpad(text, height * 64, F.lit(b" ")).alias("pixels"))
    strips = codecs.strips(pages, 64).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file")  # a pixel costs more than its transfer
    back = codecs.decoded(codecs.encoded(strips))
    part = F.struct(F.split_part("file", F.lit("#"), F.lit(2)).cast("int").alias("k"), "pixels", "height")
    whole = back.groupBy(F.split_part("file", F.lit("#"), F.lit(1)).cast("long").alias("docnum"), "width").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    pixels = F.array_join(F.transform("parts", lambda p: p["pixels"].cast("string")), "").cast("binary")  # bytes stay as they are; a sum by concat would copy each strip for each after it
    sizes = whole.select("docnum", "width", F.aggregate("parts", F.lit(0), lambda a, p: a + p["height"]).alias("height"), pixels.alias("pixels"))
    lengths = docs.select("docnum", F.length(text).alias("n"))
    return sizes.join(lengths, "docnum").select(F.col("docnum").alias("doc_id"), "width", "height", F.md5(F.substr("pixels", F.lit(1), F.col("n"))).alias("text_md5"))


@_query(f"SELECT * FROM (VALUES ('page', {len(PAGE[0])}, {len(PAGE)}, '{''.join('01' if c == 'X' else '00' for row in PAGE for c in row)}')) v(file, width, height, pixels)")
def image_bilevel_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bilevel page, coded and decoded."""
    rows = b"P1\n%d %d\n" % (len(PAGE[0]), len(PAGE)) + " ".join("1" if c == "X" else "0" for row in PAGE for c in row).encode()
    pages = images.parsed(spark.createDataFrame([("page", rows)], "path string, content binary"))
    return codecs.decoded(codecs.encoded(pages)).select("file", "width", "height", F.hex("pixels").alias("pixels"))
