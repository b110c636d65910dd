"""The training-data operators against brute force, exact round trips and held-out labels, with odd inputs."""

import base64
import collections
import hashlib
import random
import re
import textwrap

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quire.llm import byte_bpe, decontaminate, license_scan, license_texts, minhash, nearest, quality, suffix_dedup, toxicity, url_filter, warc, words
from quire.llm.queries import RANKS, RULES

DOC = "doc_id long, text string, lang string, source string, n_chars long, kept string, score double"
ODD = [None, "", " ", "\n\t", "é", "a", "a b", "A  B", "x" * 3000, "le " * 2000, "ünï " * 300]


def corpus(seed=1, n=60):
    """(doc_id, text): odd texts, near and exact copies, shared passages, ties."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 7))) for _ in range(80)]
    make = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passage, out = make(40), list(ODD)
    for _ in range(n):
        text = make(rng.randrange(5, 80))
        out.append(text)
        if rng.random() < 0.5:
            parts = text.split()
            parts[rng.randrange(len(parts))] = make(1)
            out.append(" ".join(parts))
        if rng.random() < 0.3:
            out.append(text)
        if rng.random() < 0.3:
            out.append(make(3) + " " + passage + " " + make(4))
    rng.shuffle(out)
    return list(enumerate(out))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 0.5) for i, t in rows], DOC)


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


# --- words ---


def test_words():
    rng = random.Random(5)
    texts = ["".join(rng.choice("aB é\t\n") for _ in range(rng.randrange(30))) for _ in range(200)]
    raw = [t.encode() for t in texts]
    at = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    w = words.words(np.frombuffer(b"".join(raw), np.uint8), at)
    want = [re.findall(r"[^\x20\x09-\x0D]+", t.replace("B", "b")) for t in texts]
    seen = {}
    for k, parts in enumerate(want):
        own = w.hash[w.first[k] : w.first[k + 1]].tolist()
        assert len(own) == len(parts)
        for h, p in zip(own, parts, strict=True):
            assert seen.setdefault(p, h) == h
    assert len(set(seen.values())) == len(seen)


# --- 1 ---


def test_quality(spark, empty):
    rng = random.Random(7)
    stop = "the of and to in a is that for it".split()
    make = lambda: " ".join(rng.choice(stop) if rng.random() < 0.5 else "".join(rng.choice("thernaedios") for _ in range(7)) + ("." if rng.random() < 0.2 else "") for _ in range(80))
    good = [make() for _ in range(120)]
    bad = [" ".join(w.upper() + "!!" for w in make().split()) for _ in range(15)] + [" ".join(w + "$$$" for w in make().split()) for _ in range(15)] + ["spam " * 100 for _ in range(10)]
    table = frame(spark, list(enumerate(good + bad + ODD)) + [(None, good[0])])
    got = {r["doc_id"]: r["keep"] for r in quality.judged(table).collect()}
    assert sum(got[k] for k in range(120)) >= 118 and sum(got[k] for k in range(120, 160)) <= 2
    table = table.withColumn("quality", F.lit("own")).withColumn("_quality", F.lit("own"))
    kept = quality.accepted(table)
    assert kept.dtypes == table.dtypes and kept.where("doc_id is null and quality = 'own' and _quality = 'own'").count() == 1
    long = frame(spark, [(1, " ".join(good)) if k % 3 else (1, " ".join(bad[k % 30 :])) for k in range(30)])  # one id, texts over PIECE alone
    scores = [(r["text"] in " ".join(good), r["score"]) for r in quality.scored(long, quality.trained(long, sample=20, piece=3000), "score").collect()]
    assert min(s for g, s in scores if g) > 0.5 > max(s for g, s in scores if not g)
    assert quality.judged(empty).count() == 0


def test_expectation_maximisation():
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.8
    right = np.array([0.9, 0.85, 0.8, 0.75, 0.7, 0.9, 0.8, 0.6])
    votes = np.where(rng.random((4000, 8)) < right, truth[:, None], ~truth[:, None])
    votes = np.where(rng.random((4000, 8)) < 0.2, 0, np.where(votes, 1, 2))
    seen, number, counts = np.unique(quality.pattern(votes), return_inverse=True, return_counts=True)
    good, chance = quality.posteriors(seen, counts.astype(float))
    assert ((good[number] > 0.5) == truth).mean() > 0.93
    assert np.abs(chance[1, :, 1] / 0.8 - right).max() < 0.08


# --- 2 ---


def test_nearest(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 8)).astype(np.float32)
    vectors = {k: base[k % 40] + (0 if k % 3 else rng.normal(size=8).astype(np.float32) * 0.1) for k in range(300)}
    table = [(int(k), [float(x) for x in v]) for k, v in vectors.items()]
    odd = [(1000, None), (1001, [0.0] * 8), (1002, [float("nan")] * 8), (1003, [None] * 8), (1004, [1.0] * 7), (None, [1.0] * 8), (1005, [])]
    df = spark.createDataFrame(table + odd, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    got = collections.defaultdict(list)
    for r in nearest.nearest(df, F.col("vec_id") % 10 == 0, 5).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], pytest.approx(r["score"], abs=1e-12)))
    for q in range(0, 300, 10):
        d = sorted((float(np.sqrt(((vectors[q].astype(float) - vectors[k].astype(float)) ** 2).sum())), k) for k in vectors if k != q)[:5]
        assert got[q] == [(k, x) for x, k in d]
    assert set(got) == set(range(0, 300, 10))
    assert nearest.nearest(df.where("false"), F.lit(True)).count() == 0


def test_nearest_in_doubles(spark):
    rows = [(0, [1.0, 1.0]), (1, [1.0, 1.0 + 1e-9]), (2, [1.0, 1.0 + 1.00005e-9]), (3, [1e39, 0.0]), (4, [-1e300, 1e300]), (5, [1e-320, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["vec_id"], r["score"]) for r in nearest.nearest(df, F.col("vec_id") == 0, 10).orderBy("rank").collect()]
    want = sorted((float(np.sqrt(((np.array(v) - np.array([1.0, 1.0])) ** 2).sum())), k) for k, v in rows if k)
    assert got == [(k, x) for x, k in want]


# --- 3 ---


def test_license(spark, empty):
    mit = license_texts.KNOWN["MIT"][0]
    changed = "Copyright (c) 2020 Someone\n\n" + mit.upper().replace(",", " ;").replace("sublicense", "sub-license").replace("SUBLICENSE", "SUB-LICENSE")
    table = frame(spark, [(1, mit), (2, changed), (3, mit + " more"), (4, "Some prose.\nReleased under the MIT licence!\nmore"), (5, None), (None, "")])
    got = {r["doc_id"]: (r["license_id"], r["notices"]) for r in license_scan.scan(table).collect()}
    assert got == {1: ("MIT", ""), 2: ("MIT", ""), 3: (None, ""), 4: (None, "MIT"), 5: (None, ""), None: (None, "")}
    texts = [mit, changed, "Licence © x\n© all\né", ""]
    assert [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(license_scan.canonical_column(F.col("t"))).collect()] == [license_scan.canonical(t) for t in texts]
    assert license_scan.scan(empty).count() == 0


def test_license_entire_texts(spark):
    """Entire long licences, wrapped anew; sentences that a wrap begins with "copyright" stay; texts given by the caller."""
    names = ["Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "Unlicense"]
    mit = license_texts.KNOWN["MIT"][0]
    rows = [(k, license_texts.KNOWN[n][0]) for k, n in enumerate(names)]
    rows += [(20, mit.replace("above copyright", "above\ncopyright")), (21, "Copyright (c) 2020 A B\nAll rights reserved.\n\n" + mit), (22, "Copyright The A Authors\n" + mit), (23, "Own terms.\n(c) 2021 Someone"), (24, license_texts.KNOWN["Apache-2.0"][0].replace("(c) You must retain", "(c) You may drop"))]
    got = {r["doc_id"]: r["license_id"] for r in license_scan.scan(frame(spark, rows), more={"Own": ["Own terms."]}).collect()}
    assert got == {**dict(enumerate(names)), 20: "MIT", 21: "MIT", 22: "MIT", 23: "Own", 24: None}


def test_license_at_each_wrap():
    """Every known licence, wrapped from 40 to 120 columns."""
    wrap = lambda t, width: "\n\n".join("\n".join(textwrap.wrap(" ".join(p.split()), width, break_long_words=False, break_on_hyphens=False)) for p in re.split(r"\n[ \t]*\n\s*", t))
    ids = license_scan.known()
    for name, texts in license_texts.KNOWN.items():
        for width in (40, 47, 55, 60, 61, 62, 68, 72, 76, 79, 80, 95, 100, 120):
            assert all(ids.get(license_scan.digest(wrap(t, width))) == name for t in texts), (name, width)
    assert license_scan.canonical("Licence licence, per cent PER CENT") == "license license percent percent"


# --- 4 ---


def removed(rows, least):
    owner, out = {}, {}
    for i, t in sorted(rows, key=lambda x: (x[0] is None, x[0])):
        key = suffix_dedup.LAST_ID if i is None else i
        b = (t or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - least + 1):
            if owner.setdefault(b[p : p + least], key) < key:
                gone[p : p + least] = [True] * least
        out[i] = bytes(c for c, g in zip(b, gone, strict=True) if not g)
    return out


@pytest.mark.parametrize("least,gram,hot", [(50, 20, 20_000), (20, 8, 20_000), (20, 8, 3), (50, 50, 20_000)])
def test_suffix_dedup(spark, docs, rows, least, gram, hot):
    got = {r["doc_id"]: bytes(r["kept"]) for r in suffix_dedup.deduplicated(docs, least=least, gram=gram, hot=hot).collect()}
    assert got == removed(rows, least)


def test_suffix_dedup_odd(spark, empty):
    assert suffix_dedup.digests(empty).count() == 0
    same = "to be or not to be, that is the question whether it is nobler"
    table = frame(spark, [(7, same), (7, same), (9, same), (None, same)])
    got = sorted((r["doc_id"] or 99, r["n_removed"], r["n_spans"]) for r in suffix_dedup.digests(table).collect())
    assert got == [(7, 0, 0), (7, 0, 0), (9, len(same), 1), (99, len(same), 1)]


def test_suffix_dedup_answers_stay_small(spark, rows, monkeypatch):
    """What ranges tell the blocks is a bit for a key or content, and ranges that overlap are one."""
    told, write = {}, suffix_dedup.written

    def seen(df, what):
        out = write(df, what)
        columns = [n for n, t in out.dtypes if t == "binary"]
        told[what] = out.select(F.sum(sum(F.octet_length(c) for c in columns))).first()[0]
        return out

    monkeypatch.setattr(suffix_dedup, "written", seen)
    docs = frame(spark, rows).repartition(3, "doc_id")
    got = {r["doc_id"]: bytes(r["kept"]) for r in suffix_dedup.deduplicated(docs).collect()}
    assert got == removed(rows, 50)
    whole = sum(len((t or "").encode()) for _, t in rows)
    assert told.keys() == {"shared-keys", "answers"}
    assert told["shared-keys"] < whole / 20 and told["answers"] < whole / 20, (told, whole)
    for spans in suffix_dedup.resolve({b"ab" * 30: 1, b"ba" * 30: 2, b"c" + b"ab" * 20 + b"d" + b"ab" * 9: 3}, 4, 2).values():
        assert all(b < c for (_, b), (c, _) in zip(spans, spans[1:], strict=False))


def test_maximal_repeats():
    rng = random.Random(4)
    for _ in range(60):
        texts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(12))) for _ in range(4)]
        got = {(texts[p[0][0]][p[0][1] : p[0][1] + n], tuple(sorted(p))) for n, p in suffix_dedup.maximal_repeats(texts, 2)}
        want = set()
        places = collections.defaultdict(list)
        for t, x in enumerate(texts):
            for a in range(len(x)):
                for b in range(a + 2, len(x) + 1):
                    places[x[a:b]].append((t, a))
        for s, p in places.items():
            left = [texts[t][a - 1] if a else (t, a) for t, a in p]
            right = [texts[t][a + len(s)] if a + len(s) < len(texts[t]) else (t, a) for t, a in p]
            if len(p) > 1 and len(set(left)) > 1 and len(set(right)) > 1:
                want.add((s, tuple(sorted(p))))
        assert got == want


# --- 5 ---


def test_warc(spark):
    big, small = "é" * 600, "s" * 999
    pages = spark.createDataFrame([(1, "http://a/ b", big, 1), (5, None, big, 1), (3, "u", big, 1), (4, "u", small, 1), (6, "u", small, 1), (7, "u", None, 1), (None, "u", big, 1), (8, "u", "", 1)], "page_id long, url string, html string, payload_bytes int")
    got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.round_trip(pages).collect()}
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    assert got == {
        1: (1200, sha(big), "revisit", 5), 5: (1200, sha(big), "response", None), 3: (1200, sha(big), "revisit", 5), None: (1200, sha(big), "revisit", 5),
        4: (999, sha(small), "response", None), 6: (999, sha(small), "response", None), 7: (0, sha(""), "response", None), 8: (0, sha(""), "response", None),
    }
    index = warc.write(warc.plan(pages))
    back = {r["page_id"]: (r["url"], r["payload"]) for r in warc.read(index.where("page_id in (4, 5)")).collect()}
    assert back == {4: ("u", bytearray(small.encode())), 5: (None, bytearray(big.encode()))}
    assert warc.round_trip(pages.where("false")).count() == 0


def test_warc_one_id_with_two_payloads(spark):
    a, b = "a" * 1000, "b" * 1500
    pages = spark.createDataFrame([(5, "u", a), (5, "u", b), (3, "u", b), (4, "u", a), (5, "u", "c")], "page_id long, url string, html string")
    got = sorted(tuple(r) for r in warc.round_trip(pages).select("page_id", "payload_bytes", "record_type", F.coalesce("refers_to", F.lit(0))).collect())
    assert got == [(3, 1500, "revisit", 5), (4, 1000, "revisit", 5), (5, 1, "response", 0), (5, 1000, "response", 0), (5, 1500, "response", 0)]


def test_ranges():
    assert warc.coalesced([("a", 0, 5), ("a", 5, 5), ("a", 10 + warc.GAP + 1, 2), ("b", 0, 1)]) == [[("a", 0, 5), ("a", 5, 5)], [("a", 10 + warc.GAP + 1, 2)], [("b", 0, 1)]]


# --- 6 ---


def test_byte_bpe(spark, docs, rows, empty):
    import tiktoken

    raw = byte_bpe.read_ranks(public_tokenizers.path(RANKS))
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    df = byte_bpe.encode(docs, raw, public_tokenizers.PATTERN)
    got = {r["doc_id"]: r["a"] for r in df.select("doc_id", byte_bpe.id_array().alias("a")).collect()}
    assert got == {i: enc.encode_ordinary(t or "") for i, t in rows}
    back = {r["doc_id"]: bytes(r["decoded"]) for r in byte_bpe.decode(df, raw, public_tokenizers.PATTERN).collect()}
    assert back == {i: (t or "").encode() for i, t in rows}
    rng = random.Random(9)
    for _ in range(100):
        text = "".join(rng.choice("ab1 \n'.é\x1f\u00a0") for _ in range(300))
        assert [i for p in byte_bpe.pieces(text, 20) for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)
    assert byte_bpe.digests(empty, raw, public_tokenizers.PATTERN).count() == 0


def test_byte_bpe_long_runs(spark):
    """Texts of two million characters of one kind, and runs of white space of every kind, as the library has them where it can."""
    raw = byte_bpe.read_ranks(public_tokenizers.path(RANKS))
    enc = byte_bpe.encoding(raw, public_tokenizers.PATTERN)
    kinds = [" ", "\n", "\t", "\u3000", " \n", "a", "中", "!", "1", "é ", "\x1c"]
    long = [(k, f"x{c * (2_000_000 // len(c))}y") for k, c in enumerate(kinds)]
    got = {r["doc_id"]: r["decoded_sha256"] for r in byte_bpe.digests(spark.createDataFrame(long, "doc_id long, text string").repartition(4), raw, public_tokenizers.PATTERN).collect()}
    assert got == {k: hashlib.sha256(t.encode()).hexdigest() for k, t in long}
    rng, space = random.Random(6), " \t\n\r\x0b\x0c\x85\xa0\u1680\u2003\u2028\u2029\u202f\u205f\u3000\x1c\x1f\u200b"
    for _ in range(60):
        parts = [rng.choice(["ab", "1", "!", "'s", "é", "", "中 "]) + rng.choice([rng.choice(space) * rng.choice([1, byte_bpe.RUN - 1, byte_bpe.RUN, byte_bpe.RUN + 1]), "".join(rng.choice(space) for _ in range(6000)), " "]) for _ in range(rng.randrange(1, 6))]
        text = "".join(parts) + rng.choice(["", "z", "'s"])
        assert byte_bpe.encode_text(enc, text).tolist() == enc.encode_ordinary(text)


def test_byte_bpe_one_worker(spark, docs, rows):
    """Digests take one Python node, so a task holds one worker, and are those of encode and decode one after the other."""
    raw = byte_bpe.read_ranks(public_tokenizers.path(RANKS))
    got = byte_bpe.digests(docs, raw, public_tokenizers.PATTERN)
    assert len(re.findall(r"MapInArrow|PythonMapInArrow", got._jdf.queryExecution().optimizedPlan().toString())) == 1
    apart = byte_bpe.decode(byte_bpe.encode(docs, raw, public_tokenizers.PATTERN, keep_text=False), raw, public_tokenizers.PATTERN)
    want = {r["doc_id"]: (len(r["ids"]) // 4, hashlib.sha256(r["ids"]).hexdigest(), hashlib.sha256(r["decoded"]).hexdigest()) for r in apart.collect()}
    assert {r["doc_id"]: tuple(r)[1:] for r in got.collect()} == want and len(want) == len(rows)


# --- 7 ---


def contained(text, item):
    parts = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", (t or "").lower()) if w]
    there, here = parts(item), parts(text)
    size = min(5, len(there))
    grams = lambda w: [tuple(w[k : k + size]) for k in range(len(w) - size + 1)]
    if not there:
        return None
    own, best = grams(there), None
    if set(own).isdisjoint(grams(here)):
        return None
    for start in range(-len(there), len(here)):
        window = grams(here[max(start, 0) : max(start + len(there), 0)])
        if not set(own).isdisjoint(window):
            a, b = collections.Counter(own), collections.Counter(window)
            both = sum((a & b).values())
            if 100 * both >= 80 * (len(own) + len(window) - both):
                best = max(best or (0, 0), (both / (len(own) + len(window) - both), -start))
    return best


def test_decontaminate(spark, empty):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdef") for _ in range(3)) for _ in range(60)]
    make = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    items = [(k, make(rng.choice([20, 30, 45]))) for k in range(12)] + [(90, "only three words"), (91, ""), (92, None), (93, "Aa aa AA aa aa aa aa aa aa")]
    texts = []
    for k in range(12):
        part = items[k][1].split()
        texts += [f"{make(9)} {items[k][1].upper()} {make(5)}", f"{make(9)} {' '.join(part[:-2])}", f"{make(3)} {' '.join(part[: len(part) // 2] + [make(1)] + part[len(part) // 2 :])}", make(60)]
    texts += ["ONLY three\nwords", "words only three", "aa " * 12, *ODD]
    table = list(enumerate(texts))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["similarity"], -r["start"]) for r in decontaminate.matches(frame(spark, table), bench).collect()}
    want = {(i, j): best for i, t in table for j, x in items if (best := contained(t, x))}
    assert got == {k: (pytest.approx(v[0]), v[1]) for k, v in want.items()} and len(want) > 20
    assert decontaminate.clean(frame(spark, table), bench).count() == len(table) - len({i for i, _ in want})
    assert decontaminate.matches(empty, bench).count() == 0 and decontaminate.matches(frame(spark, table), bench.where("false")).count() == 0


def test_decontaminate_at_any_offset(spark):
    """Items with their parts swapped, rotated or cut apart: no shingle stands at the item's own offset in the best window."""
    rng = random.Random(12)
    items = [(k, " ".join(f"w{k}x{j}" for j in range(n))) for k, n in enumerate([45, 59, 45, 59, 100, 12])]
    texts = []
    for k, (_, x) in enumerate(items):
        p, pre = x.split(), [f"f{k}y{j}" for j in range(15)]
        for at in (len(p) // 2, len(p) // 3, 1):
            texts.append(" ".join([*pre, *p[at:], *p[:at], *pre]))
        texts.append(" ".join([*p[len(p) // 2 :], *p[: len(p) // 2]]))
        texts.append(" ".join([*p, *pre, *p, *p[5:], *p[:5]]))
        texts.append(" ".join(rng.sample(p, len(p))))
        third = len(p) // 3
        texts.append(" ".join([*p[:third], *p[2 * third :], *p[third : 2 * third]]))
    bag = lambda w: collections.Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
    want = {}
    for i, t in enumerate(texts):
        w = t.split()
        for j, x in items:
            b = bag(x.split())
            n = sum(b.values()) + 4
            for s in range(4 - n, len(w)):
                a = bag(w[max(s, 0) : max(s + n, 0)])
                both = sum((a & b).values())
                if both and 100 * both >= 80 * sum((a | b).values()):
                    want[i, j] = max(want.get((i, j), (0, 0)), (both / sum((a | b).values()), -s))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["similarity"], -r["start"]) for r in decontaminate.matches(frame(spark, list(enumerate(texts))), bench).collect()}
    assert got == {k: (pytest.approx(v[0]), v[1]) for k, v in want.items()}
    assert {(0, 0), (3, 0), (7, 1), (10, 1)} <= set(want)


def test_decontaminate_by_row(spark):
    """Rows that share an id or have none, each by its own text; a long text that repeats an item; pieces of few places."""
    item = " ".join(f"q{k}" for k in range(30))
    rows = [(1, f"x {item} y"), (1, "innocent words that nobody has put into any benchmark"), (None, item), (None, "other innocent words"), (2, f"{item} " * 400), (3, None), (3, item.upper())]
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    table = frame(spark, rows).withColumns({"own": F.lit(1), "own_row": F.lit("x"), "row": F.lit(2)})
    kept = decontaminate.clean(table, bench)
    assert kept.columns == table.columns and kept.dtypes == table.dtypes
    assert sorted((r["doc_id"] or 99, r["text"], r["own"], r["own_row"], r["row"]) for r in kept.where("text is not null").collect()) == [(1, rows[1][1], 1, "x", 2), (99, rows[3][1], 1, "x", 2)]
    assert kept.where("doc_id = 3 and text is null").count() == 1
    whole = {tuple(r) for r in decontaminate.matches(table, bench).collect()}
    decontaminate.PIECE, before = 7, decontaminate.PIECE
    try:
        assert {tuple(r) for r in decontaminate.matches(table, bench).collect()} == whole
    finally:
        decontaminate.PIECE = before
    assert {(r[0], r[1]) for r in whole} == {(1, 7), (None, 7), (2, 7), (3, 7)}


# --- 8 ---


def test_url_rules(spark):
    urls = ["http://www.Example.com/en/x?y", "http://example.com/en/", "http://x.com/", "http://x.com", "http://a.net/es/1", "http://a.net/de/", "nothing", None, "ftp://h#/x", "http://notexample.com/en/", "x://a?://b/c"]
    pages = spark.createDataFrame([(k, u, "", "x") for k, u in enumerate(urls)], "page_id long, url string, html string, rule string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judged(pages, RULES).collect()}
    assert got == {
        0: ("www.example.com", "/en/x", "www.example.com/en/", "allow"), 1: ("example.com", "/en/", "example.com/en/", "block"), 2: ("x.com", "/", "com/", "allow"), 3: ("x.com", "", None, "allow"),
        4: ("a.net", "/es/1", "net/es/", "block"), 5: ("a.net", "/de/", None, "block"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"), 8: ("h", "", None, "allow"),
        9: ("notexample.com", "/en/", "com/", "allow"), 10: ("a", "", None, "allow"),
    }
    assert url_filter.judged(pages.where("false"), RULES).count() == 0


def test_propagation(spark):
    links = [("a", "b", 3), ("b", "c", 1), ("b", "d", 1), ("x", "y", 2), ("z", "x", 1)]
    seeds = {"a": (1.0, 0.0), "y": (0.0, 1.0), "q": (0.0, 0.0)}
    df = url_filter.propagated(spark.createDataFrame([(h, *s) for h, s in seeds.items()], "host string, trust double, distrust double"), spark.createDataFrame(links, "src string, dst string, n long"), rounds=6)
    got = {r["host"]: (r["trust"], r["distrust"]) for r in df.collect()}
    names = sorted({h for s, d, _ in links for h in (s, d)} | set(seeds))
    now = {h: seeds.get(h, (0.0, 0.0)) for h in names}
    for _ in range(6):
        new = {}
        for h in names:
            t = sum(now[s][0] * n / sum(m for s2, _, m in links if s2 == s) for s, d, n in links if d == h)
            b = sum(now[d][1] * n / sum(m for _, d2, m in links if d2 == d) for s, d, n in links if s == h)
            s0 = seeds.get(h, (0.0, 0.0))
            new[h] = (0.15 * s0[0] + 0.85 * t, 0.15 * s0[1] + 0.85 * b)
        now = new
    sums = [sum(v[k] for v in now.values()) for k in (0, 1)]
    assert {h: pytest.approx((v[0] / sums[0], v[1] / sums[1])) for h, v in now.items()} == got
    assert got["x"][1] > got["z"][1] > 0 and got["c"][0] == got["d"][0] > 0
    pages = spark.createDataFrame([(1, "http://a/", '<a href="http://B/x">'), (2, "http://a/", "<A HREF='//b?q'><a href=/c>"), (3, None, None)], "page_id long, url string, html string")
    assert [tuple(r) for r in url_filter.host_links(pages).collect()] == [("a", "b", 2)]


def test_propagation_to_the_end(spark):
    """A chain of 20 links to a blocked host, against the solved fixed point."""
    links = [(f"h{k}", f"h{k + 1}", 1) for k in range(20)] + [("c0", "c1", 2), ("c1", "h15", 1)]
    seeds = {"h20": (0.0, 1.0), "c0": (1.0, 0.0)}
    names = sorted({h for s, d, _ in links for h in (s, d)})
    at = {h: k for k, h in enumerate(names)}
    count = np.zeros((len(names), len(names)))
    for s, d, n in links:
        count[at[s], at[d]] = n
    along = (count / np.maximum(count.sum(1, keepdims=True), 1)).T
    against = count / np.maximum(count.sum(0, keepdims=True), 1)
    seed = np.array([seeds.get(h, (0.0, 0.0)) for h in names])
    want = []
    for k, m in enumerate((along, against)):  # columns without links go to the seeds
        full = m + np.outer(seed[:, k], m.sum(0) == 0)
        want.append(np.linalg.solve(np.eye(len(names)) - 0.85 * full, 0.15 * seed[:, k]))
    want = np.stack(want, 1)
    df = url_filter.propagated(spark.createDataFrame([(h, *s) for h, s in seeds.items()], "host string, trust double, distrust double"), spark.createDataFrame(links, "src string, dst string, n long"))
    got = {r["host"]: (r["trust"], r["distrust"]) for r in df.collect()}
    assert got == {h: (pytest.approx(want[at[h], 0], abs=1e-8), pytest.approx(want[at[h], 1], abs=1e-8)) for h in names}
    assert got["h0"][1] > got["h0"][0] == 0


def test_url_filter_as_sql(spark):
    """Verdicts that links alone decide, and the same judgement in SQL; the first link changes no score by leaps."""
    import duckdb

    rows = [(1, "http://good.com/a", "<a href='http://shop.org/'>"), (2, "http://bad.net/es/x", ""), (3, "http://shop.org/", '<a href="http://bad.net/es/x"><a href=/own>'), (4, "http://ring.org/b/c", "<a href=http://bad.net/es/><a href='mailto:a@b'>")]
    rows += [(5, "http://good.com/b", "<a href=//shop.org/1>"), (6, "http://alone.org/", "<a href=../x#y><a href=javascript:void(0)>"), (7, None, "<a href='http://bad.net/'>"), (8, "http://good.com/c", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in url_filter.judged(pages, RULES).collect()}
    assert {k: r["verdict"] for k, r in got.items()} == {1: "allow", 2: "block", 3: "allow", 4: "block", 5: "allow", 6: "allow", 7: "allow", 8: "allow"}
    con = duckdb.connect()
    con.register("pages", pages.toPandas())
    want = con.sql(url_filter.oracle_sql(RULES, 200)).df()
    for r in want.itertuples():
        mine = got[r.page_id]
        assert (mine["host"], mine["path"], mine["verdict"]) == (r.host, r.path, r.verdict) and (mine["rule"] or "") == ("" if r.rule is None or r.rule != r.rule else r.rule)
        assert mine["host"] == "" or (mine["trust"], mine["distrust"]) == (pytest.approx(r.trust, abs=1e-8), pytest.approx(r.distrust, abs=1e-8))
    alone = pages.withColumn("html", F.lit(""))
    one = alone.withColumn("html", F.when(F.col("page_id") == 6, F.lit("<a href='http://else.org/'>")).otherwise(F.col("html")))
    trust = lambda df: {r["page_id"]: r["trust"] for r in url_filter.judged(df, RULES).collect() if r["host"]}
    assert trust(alone) == {k: pytest.approx(v) for k, v in trust(one).items()}


# --- 9 ---


def near_components(rows, size, percent):
    sets = {}
    for i, t in rows:
        parts = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets[i] = {tuple(parts[k : k + size]) for k in range(max(len(parts) - size + 1, 1))} if parts else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize("size", [2, 5])
def test_minhash(spark, docs, rows, size):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.components(docs, size=size).collect()}
    assert got == near_components(rows, size, 80)


def test_minhash_leaves(spark, empty):
    """Leaves linked with one another and not with their centre, some by shared new words."""
    rng = random.Random(3)
    base = [f"w{k}" for k in range(120)]
    table = []
    for k in range(60):
        t = list(base)
        for _ in range(rng.choice([2, 4, 9, 12])):
            t[rng.randrange(len(t))] = f"n{k}x{rng.randrange(1000)}"
        if k % 4 == 0:
            t[20:32] = [f"shared{j}" for j in range(12)]
        table.append((k, " ".join(t)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.components(frame(spark, table), size=2).collect()}
    assert got == near_components(table, 2, 80)
    assert minhash.components(empty).count() == 0
    odd = frame(spark, [(None, "a b c"), (4, "a b c"), (4, "a b c"), (2, "a b c"), (9, None)])
    rows = sorted(((r["doc_id"] or 99), r["component_id"], r["kept"]) for r in minhash.components(odd).collect())
    assert rows == [(2, 2, True), (4, 2, False), (4, 2, False), (9, 9, True), (99, None, True)]


def test_minhash_repeated_ids(spark):
    """Texts under one id aren't linked by it, and of each group one row stays."""
    make = lambda k: " ".join(f"{k}w{j}" for j in range(40))
    x, y, z = make("x"), make("y"), make("z")
    rows = [(3, y), (5, y), (5, x), (9, x)]
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.components(frame(spark, rows)).collect())
    assert got == [(3, 36, 3, True), (5, 36, 3, False), (5, 36, 5, True), (9, 36, 5, False)]
    assert sorted((r["doc_id"], r["text"]) for r in minhash.one_of_each(frame(spark, rows)).collect()) == [(3, y), (5, x)]
    rows = [(2, y), (5, y + " more"), (5, x), (5, z), (5, z), (9, z), (None, z), (5, ""), (5, None), (1, None), (5, x + " again")]
    out = minhash.one_of_each(frame(spark, rows).withColumns({"own_id": F.lit(1), "row": F.lit("r")}))
    left = sorted((r["doc_id"] or 99, r["text"] or "") for r in out.collect())
    either = x if (5, x) in left else x + " again"
    assert left == sorted([(1, ""), (2, y), (5, ""), (5, ""), (5, either), (5, z), (99, z)])


def test_minhash_large_group(spark):
    """Members that differ in different measure from a common origin, some little: pairs grow with the group, not with its square."""
    rng, base, n = random.Random(4), [f"b{k}" for k in range(100)], 600
    table = []
    for k in range(n):
        t = list(base)
        for j in rng.sample(range(100), rng.randrange(1, 8)):
            t[j] = f"n{k}x{j}"
        table.append((k, " ".join(t)))
    seen, before = [], minhash.compared
    minhash.compared = lambda pairs, *a, **k: (seen.append(pairs.count()), before(pairs, *a, **k))[1]
    try:
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.components(frame(spark, table), size=2).collect()}
    finally:
        minhash.compared = before
    assert got == near_components(table, 2, 80)
    assert sum(seen) < 40 * n, seen  # all pairs would be 300 * n


# --- 10 ---


def test_marginals():
    rng = np.random.default_rng(3)
    sizes = [0, 1, 5, 700, 256, 257, 0, 600]
    first = np.concatenate(([0], np.cumsum(sizes)))
    odds, move = np.exp(rng.normal(size=first[-1]) * 2), np.exp(rng.normal(size=(2, 2)))
    p, _, _ = toxicity.marginals(odds, first, move)
    for a, b in zip(first[:-1], first[1:], strict=True):
        e = np.column_stack([np.ones(b - a), odds[a:b]])
        alpha, beta = np.zeros((b - a, 2)), np.ones((b - a, 2))
        for t in range(b - a):
            alpha[t] = (move[0] if t == 0 else alpha[t - 1] @ move) * e[t]
            alpha[t] /= alpha[t].sum()
        for t in range(b - a - 2, -1, -1):
            beta[t] = move @ (e[t + 1] * beta[t + 1])
            beta[t] /= beta[t].sum()
        want = alpha * beta
        assert p[a:b] == pytest.approx(want[:, 1] / want.sum(1), abs=1e-9)


def test_toxicity(spark, empty):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("thernaedios") for _ in range(rng.randrange(2, 8))) for _ in range(400)]
    rows, labels = [], []
    for k in range(700):
        t, bad = [rng.choice(vocabulary) for _ in range(rng.randrange(20, 120))], k % 4 == 0
        for _ in range(3 * bad):
            t.insert(rng.randrange(len(t)), rng.choice(["Zwickul,", "gruffo", "gruffoly", "zwickulen"]))
        rows.append((k, " ".join(t)))
        labels.append((k, int(bad)))
    table = frame(spark, rows + [(5000 + k, t) for k, t in enumerate(ODD)] + [(None, "gruffo zwickul")])
    marked = spark.createDataFrame([*labels, (1, 1 - labels[1][1] if False else labels[1][1]), (None, 1), (6000, None)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.judged(table, marked).collect()}
    held = [k for k in range(700) if got[k]["held_out"]]
    assert 90 < len(held) < 190 and all(got[k]["predicted"] == labels[k][1] for k in held)
    assert got[None]["predicted"] == 1 and not got[None]["held_out"] and all(0 <= r["score"] <= 1 for r in got.values())
    model = toxicity.trained(table, marked)
    spans = toxicity.scored(frame(spark, [(1, f"{rows[1][1]} Zwickul, x")]), model).first()
    assert [(a, b) for a, b in zip(spans["span_starts"], spans["span_ends"], strict=True)] == [(len(rows[1][1]) + 1, len(rows[1][1]) + 8)]
    assert toxicity.judged(empty, marked).count() == 0
    assert {r["score"] for r in toxicity.judged(table, marked.where("false")).collect()} == {0.0}


def test_removed_rows_move_alone(spark):
    """Where rows are taken out by a join, only texts that may go are shuffled; the others stay where they are."""
    rng = random.Random(7)
    rows = [(k if k % 50 else None, rng.randbytes(1500).hex()) for k in range(2000)] + [(7, "another text"), (14, None)]
    docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(4).cache()
    docs.count()
    keyed = docs.withColumn("own_row", minhash.row_key(F.col("text")))
    goes = keyed.where("doc_id % 21 = 7 and text <> 'another text'").select(F.col("doc_id").cast("long").alias("own_id"), "own_row").cache()
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    store, stages = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    moved = lambda: (lambda found: sum(found.apply(k).shuffleWriteBytes() for k in range(found.size())))(store.stageList(None, False, False, stages, None))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = moved()
        found = [(r["doc_id"], r["text"]) for r in minhash._without(keyed, goes, "own_id", "own_row").collect()]
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        went = moved() - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    want = [r for r in rows if r[0] is None or r[0] % 21 != 7 or r[1] == "another text"]
    assert sorted(map(str, found)) == sorted(map(str, want))
    assert 0 < went < 0.35 * sum(len(t or "") for _, t in rows) / 2  # hexadecimal digits are packed to a half at best
