"""Operators of the retrieval engine against hand-computed or brute-force results."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.functions import analysis
from quire.operators import compression, docsets, index, merge, present
from quire.plans import boolean, ranked
from quire.sources import registry
from quire.sources import text as sources
from quire.streaming import append

TEXTS = ["The cat sat on the mat", "a cat and a dog", "", None, "dog dog dog 1234567 abc12345def", "foo_bar-9 é7a " + "x" * 300, "the the cat\nthe dog"]


def machine(text):
    """Terms, byte by byte."""
    raw, out, at = (text or "").encode(), [], 0
    while at < len(raw):
        end, digits = at, 0
        while end < len(raw) and end - at < 255 and chr(raw[end]).isalnum() and raw[end] < 128:
            if 48 <= raw[end] < 58:
                if digits == 4:
                    break
                digits += 1
            end += 1
        if end > at:
            out.append(raw[at:end].decode().lower())
            at = end
        else:
            at += 1
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS, 1)), "docnum long, text string")


@pytest.fixture(scope="module")
def coll(docs):
    return index.build(docs)


def numbers(df):
    return sorted(r["docnum"] for r in df.collect())


def test_terms(spark, docs):
    got = {r["docnum"]: r["t"] for r in docs.select("docnum", analysis.terms(docs.text).alias("t")).collect()}
    assert got == {k: machine(t) for k, t in enumerate(TEXTS, 1)}
    rng = random.Random(1)
    rows = ["".join(rng.choice("ab1 2-é") for _ in range(rng.randrange(60))) for _ in range(200)]
    df = spark.createDataFrame([(t,) for t in rows], "text string")
    assert [r[0] for r in df.select(analysis.terms(df.text)).collect()] == [machine(t) for t in rows]


def test_markup(spark):
    df = spark.createDataFrame([('<a href="x">b</a>c',), ("a < b",)], "text string")
    assert [r[0] for r in df.select(analysis.terms(df.text, markup=True)).collect()] == [["b", "c"], ["a"]]


def test_index(coll):
    counts = [Counter(machine(t)) for t in TEXTS]
    assert {(r["term"], r["docnum"]): r["f_dt"] for r in coll.postings.collect()} == {(t, k): n for k, c in enumerate(counts, 1) for t, n in c.items()}
    df = Counter(t for c in counts for t in c)
    assert {r["term"]: (r["f_t"], r["cf_t"]) for r in coll.lexicon.collect()} == {t: (n, sum(c[t] for c in counts)) for t, n in df.items()}
    weights = {r["docnum"]: r["w"] for r in coll.weights.collect()}
    assert weights == pytest.approx({k: math.sqrt(sum((n * math.log(len(TEXTS) / df[t])) ** 2 for t, n in c.items())) for k, c in enumerate(counts, 1) if c})


def test_approximate_weights(coll):
    exact = {r["docnum"]: r["w"] for r in coll.weights.collect()}
    for r in index.approximate_weights(coll.weights).collect():
        assert 0 <= r["code"] < 64 and r["approx"] <= exact[r["docnum"]] * (1 + 1e-6)


def test_numbered(spark):
    df = spark.createDataFrame([(f"k{n:03}",) for n in range(50, 0, -1)], "key string")
    assert [(r["key"], r["docnum"]) for r in index.numbered(df, "key").orderBy("key").collect()] == [(f"k{n:03}", n) for n in range(1, 51)]
    assert index.numbered(df.where("false"), "key").count() == 0


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_numbered_at_size(spark, adaptive):
    """A million rows, with ties and a key that a third of them have, get the numbers 1..N in the key's order."""
    n, before = 1_000_000, spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        key = F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.xxhash64("id") % 50_000)
        got = index.numbered(spark.range(n).select(key.alias("key"), F.col("id").alias("part"), F.lit("x").alias("at")), "key")
        assert got.columns == ["key", "part", "at", "docnum"]
        order = got.select("docnum", "key").withColumn("next", F.lead("key").over(Window.orderBy("docnum")))
        row = got.agg(F.count_distinct("docnum").alias("d"), F.min("docnum").alias("a"), F.max("docnum").alias("b")).first()
        assert tuple(row) == (n, 1, n) and order.where("next < key").count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_boolean_algebra(coll):
    present_ = {k: set(machine(t)) for k, t in enumerate(TEXTS, 1)}
    rng = random.Random(2)

    def tree(depth):
        kind = rng.choice(["term", "term", "and", "or", "not", "all", "none"]) if depth else "term"
        if kind == "term":
            return boolean.Node("term", term=rng.choice(["cat", "dog", "the", "mat", "nowhere"]))
        if kind in ("and", "or"):
            return boolean.Node(kind, tuple(tree(depth - 1) for _ in range(rng.choice([2, 3]))))
        return boolean.Node("not", (tree(depth - 1),)) if kind == "not" else boolean.Node(kind)

    for _ in range(12):
        node = tree(3)
        want = sorted(k for k, s in present_.items() if boolean.holds(node, s))
        assert boolean.parse(str(node)) is not None
        assert all(boolean.holds(boolean.simplified(node), s) == boolean.holds(node, s) for s in present_.values())
        assert numbers(boolean.matches(coll, node)) == want == numbers(boolean.matches_by_joins(coll, node)), str(node)


def test_parser():
    assert str(boolean.parse("Rabbit & !(Alice | she)")) == "(rabbit & !(alice | she))"
    assert boolean.parse("a b | c") == boolean.parse("(a & b) | c")
    for bad in ("", "(a", "a )", "& a", "a |"):
        with pytest.raises(boolean.QueryError):
            boolean.parse(bad)


def test_ranked(coll):
    counts = {k: Counter(machine(t)) for k, t in enumerate(TEXTS, 1)}
    df, n = Counter(t for c in counts.values() for t in c), len(TEXTS)
    idf = {t: math.log(n / f) for t, f in df.items()}
    w = {k: math.sqrt(sum((f * idf[t]) ** 2 for t, f in c.items())) for k, c in counts.items()}
    query = Counter("the dog dog nowhere".split())
    want = {k: sum(q * idf[t] ** 2 * c[t] for t, q in query.items() if t in idf) / w[k] for k, c in counts.items() if w[k]}
    want = sorted(((-round(s, 9), k) for k, s in want.items() if s > 0))[:3]
    assert [(r["docnum"], -round(r["score"], 9)) for r in ranked.ranked(coll, "the dog dog nowhere", 3).collect()] == [(k, pytest.approx(s)) for s, k in want]
    assert numbers(ranked.ranked(coll, "nowhere")) == []
    best = ranked.limited(coll, "mat dog the", 1, k=None)
    assert numbers(best) == [1]


def test_paragraphs(docs):
    got = ranked.by_paragraph(index.build(index.paragraphs(docs)), "the", k=None).collect()
    assert {(r["docnum"], r["paragraph"]) for r in got} >= {(7, 0)}


def test_sets(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "docnum long, weight double")
    b = spark.createDataFrame([(2, 5.0), (3, 1.0)], "docnum long, weight double")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(docsets.intersection(a, b)) == [(2, 2.0)]
    assert rows(docsets.difference(a, b)) == [(1, 1.0)]
    assert rows(docsets.union(a, b)) == [(1, 1.0), (2, 7.0), (3, 1.0)]


def test_numbers(docs):
    got = [(r["docnum"], r["weight"]) for r in docsets.by_number(docs, "5 3-5 3 x 1").collect()]
    assert got == [(5, 2.0), (3, 3.0), (4, 1.0)]


def test_presentation(spark, docs):
    assert present.post_filter('a "x y" b') == ("a  b", "x y") and present.post_filter('a " b') == ("a  b", None)
    assert present.java_pattern(r"a\(b\|c\)(") == r"(?m)a(b|c)\("
    assert numbers(docs.where(present.passes(docs.text, "^the"))) == [7]
    for bad in ("[", "[a[b]"):  # the second is a pattern to Python
        assert numbers(docs.where(present.passes(docs.text, bad))) == list(range(1, 8))
    marked = docs.where("docnum = 7").select(analysis.highlighted(docs.text, ["the"])).first()[0]
    assert marked == "<B>the</B> <B>the</B> cat\n<B>the</B> dog"


def test_merge(spark, docs, coll):
    old = index.build(docs.where("docnum <> 5"))
    grown = merge.append(old, docs.where("docnum = 5"))
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(grown.lexicon) == rows(coll.lexicon) and rows(grown.postings) == rows(coll.postings)
    assert {r["docnum"]: r["w"] for r in grown.weights.collect()} == pytest.approx({r["docnum"]: r["w"] for r in coll.weights.collect()})


def test_append_saved(spark, docs, coll, tmp_path):
    """Batches of files; a broken or repeated batch is replaced; numbers must be new."""
    path = str(tmp_path / "c")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert merge.batches(spark, path) == 0
    merge.append_saved(path, docs.where("docnum <= 3"))
    merge.append_saved(path, docs.where("docnum = 4"))
    docs.where("docnum = 5").write.parquet(f"{path}/docs/batch=2")  # a batch that was broken off
    old = index.Collection.open(spark, path)
    assert numbers(old.docs) == [1, 2, 3, 4] and merge.batches(spark, path) == 2
    with pytest.raises(ValueError):
        merge.append_saved(path, docs.where("docnum = 4"))
    for _ in range(2):
        new = merge.append_saved(path, docs.where("docnum > 4"), number=2)
    assert rows(new.postings) == rows(coll.postings) and rows(new.lexicon) == rows(coll.lexicon) and rows(new.meta) == rows(coll.meta)
    before = {r["docnum"]: r["w"] for r in old.weights.collect()}
    after = {r["docnum"]: r["w"] for r in new.weights.collect()}
    assert {k: after[k] for k in before} == before and set(after) == {r["docnum"] for r in coll.weights.collect()}
    new = merge.append_saved(path, spark.createDataFrame([(1, "zebra")], docs.schema), renumber=True, weights="exact")
    whole = index.build(docs.unionByName(spark.createDataFrame([(8, "zebra")], docs.schema)))
    assert {r["docnum"]: r["w"] for r in new.weights.collect()} == pytest.approx({r["docnum"]: r["w"] for r in whole.weights.collect()})


def test_codes():
    lengths = compression.code_lengths({c: n for n, c in enumerate("abcdefgh", 1)})
    found = compression.canonical_codes(lengths)
    assert sum(2.0 ** -n for n in lengths.values()) == 1 and {s: len(c) for s, c in found.items()} == lengths
    assert not any(a != b and found[b].startswith(found[a]) for a in found for b in found)


def test_escapes():
    assert present.unescaped(r"a\tb\n\x41\1018\q\\") == "a\tb\nAA8\\" and present.unescaped("x\\") == "x\\"


def test_best_paragraph_marked(spark, docs):
    best = spark.createDataFrame([(7, 1)], "docnum long, paragraph int")
    assert present.with_paragraphs(best, docs, best, " / ").first()["text"] == "the the cat / **the dog**"


def test_registry(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\n\ntwo\n")
    (tmp_path / "b.txt").write_text("three")
    table = registry.parsed(f"# name, kind, files\nx\tPARA\t{tmp_path}\ny\tdir2\t{tmp_path}\n")
    assert [(r["docnum"], r["text"].strip()) for r in registry.numbered(spark, table["x"]).orderBy("docnum").collect()] == [(1, "one"), (2, "two"), (3, "three")]
    assert registry.documents(spark, table["y"]).count() == 2
    for bad in ("x\tSQL\t/a", "x\tPARA"):
        with pytest.raises(ValueError):
            registry.parsed(bad)


def test_compression(spark):
    rng = random.Random(3)
    for _ in range(200):
        raw = "".join(rng.choice("abc12345 .é") for _ in range(rng.randrange(80))).encode()
        found = compression.token_list(raw)
        assert b"".join(t for _, t in found) == raw
        assert all(a[0] != b[0] for a, b in zip(found, found[1:], strict=False)) and all(len(t) <= 15 for _, t in found)
    lengths = compression.code_lengths({"a": 5, "b": 2, "c": 1, "d": 1})
    assert lengths == {"a": 1, "b": 2, "c": 3, "d": 3}


def test_token_statistics(spark, docs):
    seen = Counter()
    first = {}
    for k, t in enumerate(TEXTS, 1):
        for pos, token in enumerate(compression.token_list((t or "").encode())):
            seen[token] += 1
            first.setdefault(token, (k, pos))
    stats = compression.token_statistics(docs)
    assert {(r["kind"], bytes(r["tok"])): (r["freq"], r["first_doc"], r["first_pos"]) for r in stats.collect()} == {t: (n, *first[t]) for t, n in seen.items()}
    assert compression.token_list(b"12345 " + b"a" * 16) == [(1, b"1234"), (0, b""), (1, b"5"), (0, b" "), (1, b"a" * 15), (0, b""), (1, b"a")]
    for by, key in (("frequency", lambda t: (-seen[t], len(t[1]), t[1])), ("first", lambda t: first[t])):
        want, used = set(), Counter()
        for t in sorted(seen, key=key):
            if used[t[0]] < 1024:
                want.add(t)
            used[t[0]] += len(t[1]) + 300
        got = compression.dictionary(stats, 1, by=by, pointer=300)
        assert {(r["kind"], bytes(r["tok"])) for r in got.collect()} == want


def test_sources(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.txt").write_text("one\n\n \ntwo\n")
    files = sources.whole_files(spark, str(tmp_path / "x"))
    assert [r["text"].strip() for r in sources.cut(files, "para").orderBy("part").collect()] == ["one", "two"]
    stars = spark.createDataFrame([("f", "a\n" + "*" * 20 + "\nb\n")], "file string, text string")
    assert [r["text"] for r in sources.cut(stars, "linesep").orderBy("part").collect()] == ["a\n", "b\n"]
    mail = spark.createDataFrame([("f", "From a\nx\nFrom b\ny\n")], "file string, text string")
    assert [r["text"] for r in sources.cut(mail, "mail").orderBy("part").collect()] == ["From a\nx\n", "From b\ny\n"]
    (tmp_path / "d.bin").write_text("one\x02two\x02")
    assert sorted(r["text"] for r in sources.delimited(spark, str(tmp_path / "d.bin")).collect()) == ["one", "two"]


def test_stream(spark, docs, coll, tmp_path):
    docs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    append.follow(stream, str(tmp_path / "index"), str(tmp_path / "state")).awaitTermination()
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(append.followed(spark, str(tmp_path / "index")).postings) == rows(coll.postings)


def test_saved(spark, docs, coll, tmp_path):
    index.saved(docs, str(tmp_path / "c"))
    again = index.Collection.open(spark, str(tmp_path / "c"))
    assert numbers(boolean.matches(again, "cat & !mat")) == numbers(boolean.matches(coll, "cat & !mat")) == [2, 7]
    assert re.search("PushedFilters: .*term", boolean.matches(again, "cat")._jdf.queryExecution().toString())
