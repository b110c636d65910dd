"""Near-duplicates by one-permutation MinHash.

1. Each text becomes the set of hashes of its word shingles. One permutation hashing keeps the least hash in each of
   256 bins; an empty bin takes the value of the first filled bin on a probe sequence of its own (optimal densification).
2. Texts with equal sets are one node, found by a partial aggregate on a digest of the set.
3. 42 bands of 6 bins deal the nodes into buckets; a pair with a similarity of 0.8 misses all of them with a
   probability of 3 in a million.
4. Candidates are stars: the bucket's smallest id with each other member, so pairs grow with rows, not with their squares.
   A star alone could lose links between its leaves. Where a leaf isn't connected to its centre, two leaves become
   centres too (``recentred``), and where that leaves some apart, ``leaf_pairs`` finds the pairs of leaves that can still be
   linked, from how they differ from the centre; a pair that is connected already needs no test, so no connection is lost.
5. Each candidate is confirmed on the full sets, and components grow by large-star and small-star steps.

The texts of nodes that share a bucket are written once, in a table bucketed by id, so that no round shuffles them again.

Defined results: a null or empty text, or one without words, has an empty set and is linked with nothing; a text with
fewer words than a shingle is one shingle; a row with a null id is linked with nothing and stays; rows that repeat an id
are each judged by their own text, and texts under one id are not linked by it; an empty table gives no rows; extra columns are ignored by ``components``.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import arrowtools, words
from quire.session import remove, scratch, shared_dir, ship, unused, written

BITS, BANDS, ROWS = 8, 42, 6
#: Leaves of one centre that may share a shingle before it counts as the centre's.
COMMON = 8
#: Words of the bitmaps by which leaves are held against each other.
WORDS = 32
#: Partners of one text that a task compares it with.
SPLIT = 256
#: Bytes of text that are hashed at once.
CHUNK = 1 << 20
#: Bits for each id that rows are held against before they are shuffled, and words of 64 such bits at most.
BITS_AN_ID, MOST_WORDS = 16, 1 << 18

_EDGES = np.arange((1 << BITS) + 1, dtype=np.uint64)
_ODD = words.mix(np.arange(1, ROWS + 1)) | np.uint64(1)
_SALT = words.mix(np.arange(1000, 1000 + BANDS))


def _probe(bins: np.ndarray, attempt: int) -> np.ndarray:
    return (words.mix(bins.astype(np.uint64) * np.uint64(0x10001) + np.uint64(attempt << 20)) & np.uint64((1 << BITS) - 1)).astype(np.int64)


def signature(unique: np.ndarray) -> np.ndarray:
    """The least hash of each bin, densified; ``unique`` is sorted and not empty."""
    top = (unique >> np.uint64(64 - BITS)).astype(np.int64)
    at = np.searchsorted(top, np.arange((1 << BITS) + 1))
    filled = at[1:] > at[:-1]
    out = unique[np.minimum(at[:-1], len(unique) - 1)]
    empty, attempt = np.flatnonzero(~filled), 0
    while len(empty):
        there = _probe(empty, attempt)
        good = filled[there]
        out[empty[good]] = out[there[good]]
        empty, attempt = empty[~good], attempt + 1
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band."""
    parts = sig[: BANDS * ROWS].reshape(BANDS, ROWS)
    return words.mix((words.mix(parts) * _ODD).sum(1, dtype=np.uint64) ^ _SALT)


def text_sets(column: pa.Array, size: int) -> list[np.ndarray]:
    """The sorted shingle hashes of each text."""
    data, at = arrowtools.flat_utf8(column)
    hashes, first = words.shingles(words.words(data, at), size)
    return [np.unique(hashes[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


def signatures(documents: DataFrame, size: int) -> DataFrame:
    """doc_id, row (a digest of the text), n_shingles, set_key (null for an empty set) and bands."""
    ship(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in arrowtools.slices(whole, "text", CHUNK):
                sets = text_sets(batch.column("text"), size)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        batch.column("row"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                        pa.array([band_keys(signature(s)).view(np.int64) if len(s) else None for s in sets], pa.list_(pa.int64())),
                    ],
                    ["doc_id", "row", "n_shingles", "set_key", "bands"],
                )

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(F.col("text")).alias("row"), "text")
    return rows.mapInArrow(run, "doc_id long, row binary, n_shingles long, set_key binary, bands array<long>")


def row_key(text: Column) -> Column:
    """Tells apart rows that repeat an id with different texts."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def _beside(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b, text_a, text_b. A text with over ``SPLIT`` partners goes to several tasks, each with its share of them."""
    of_b = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    of_a = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    plain = lambda p: p.join(of_b.hint("merge"), "b").join(of_a.hint("merge"), "a").select("a", "b", "text_a", "text_b")
    pairs = written(pairs, "pairs")
    hot = written(pairs.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") > SPLIT).select("a", F.ceil(F.col("n") / SPLIT).cast("int").alias("shares")), "hot")
    if hot.isEmpty():
        return plain(pairs)
    dealt = pairs.join(hot, "a").withColumn("share", F.pmod(F.xxhash64("b"), F.col("shares")).cast("int")).drop("shares")
    copies = of_a.join(hot, "a").select("a", "text_a", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    spread = dealt.join(of_b.hint("merge"), "b").join(copies.hint("merge"), ["a", "share"]).select("a", "b", "text_a", "text_b")
    return plain(pairs.join(hot, "a", "left_anti")).unionByName(spread)


def compared(pairs: DataFrame, texts: DataFrame, size: int, *, novel: bool = False) -> DataFrame:
    """a, b, size_a, size_b, common on the full sets; with ``novel`` also the shingles of b that a lacks, and a bitmap of all of b's in ``WORDS`` words of 64 bits."""
    kinds = "a long, b long, size_a long, size_b long, common long" + ", novel array<long>, bitmap array<long>" * novel

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept = None, np.zeros(0, np.uint64)
        for whole in batches:
            for batch in arrowtools.slices(whole, "text_b", CHUNK):
                rows, more, maps = [], [], []
                starts = batch.column("text_a")
                for k, (a, there) in enumerate(zip(batch.column("a").to_pylist(), text_sets(batch.column("text_b"), size), strict=True)):
                    if a != last:
                        last, kept = a, text_sets(starts.slice(k, 1), size)[0]
                    both = np.concatenate((kept, there))
                    both.sort()
                    rows.append((len(kept), len(there), int((both[1:] == both[:-1]).sum())))
                    if novel:
                        more.append(np.setdiff1d(there, kept, assume_unique=True).view(np.int64))
                        bits = np.zeros(64 * WORDS, np.uint8)
                        bits[(there % np.uint64(64 * WORDS)).astype(np.int64)] = 1
                        maps.append(np.packbits(bits).view(np.int64))
                made = [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)]
                if novel:
                    made += [pa.array(more, pa.list_(pa.int64())), pa.array(maps, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), *made], ["a", "b", "size_a", "size_b", "common", *["novel", "bitmap"] * novel])

    return _beside(pairs, texts).mapInArrow(run, kinds)


def linked(size_x: str, size_y: str, common: Column, percent: int) -> Column:
    return common * 100 >= (F.col(size_x) + F.col(size_y) - common) * percent


def connected(links: DataFrame) -> DataFrame:
    """node, component (its smallest node): large-star and small-star steps until nothing changes."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = written(edges, "edges")
    while True:
        # each node's larger neighbours move to its least neighbour
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # each node and its smaller neighbours move to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.col("u"), F.col("v"))).alias("u"), F.col("m").alias("v"))
        after = written(small.where("u <> v").distinct(), "edges")
        changed = after.join(edges, ["u", "v"], "left_anti").limit(1).count() + edges.join(after, ["u", "v"], "left_anti").limit(1).count()
        edges = after
        if not changed:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _with_groups(stars: DataFrame, groups: DataFrame) -> DataFrame:
    """The stars' pairs with the components of leaf (own) and centre (main)."""
    of_b, of_a = (groups.select(F.col("node").alias(n), F.col("component").alias(c)) for n, c in (("b", "own"), ("a", "main")))
    named = stars.join(of_b, "b", "left").join(of_a, "a", "left")
    return written(named.select("a", "b", "size_a", "size_b", "common", F.coalesce("own", "b").alias("own"), F.coalesce("main", "a").alias("main")), "leaves")


def recentred(named: DataFrame) -> DataFrame | None:
    """New stars' pairs where a leaf isn't connected to its centre; none if there is no such leaf.

    The leaf most like the centre becomes the second centre, and the most alike of those that aren't connected the third: each
    meets the leaves of other components. In a group whose members differ from a common origin in different measure,
    the second centre is the one nearest to the origin, which more of them are similar to.
    """
    alike = F.col("common") / (F.col("size_a") + F.col("size_b") - F.col("common"))
    rank = F.struct(alike.alias("alike"), (-F.col("b")).alias("before"), "b", "own")
    apart = F.col("own") != F.col("main")
    open_ = written(named.groupBy("a").agg(F.count("*").alias("n"), F.max(apart).alias("apart"), F.max(rank).alias("one"), F.max(F.when(apart, rank)).alias("two")).where("n > 1 and apart"), "open")
    if open_.isEmpty():
        return None
    chosen = open_.select("a", F.explode(F.array("one", "two")).alias("centre"))
    return named.select("a", "b", "own").join(chosen, "a").where("own <> centre.own").select(F.col("centre.b").alias("a"), "b").distinct()


def leaf_pairs(named: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame | None:
    """The pairs of one centre's leaves that may still be linked and aren't connected yet; none if no leaf is apart from its centre.

    Let c be the centre's set with all shingles that over ``COMMON`` of its leaves have. Of two leaves x and y, either
    both have a shingle that isn't in c, which at most ``COMMON`` leaves share, or their intersection lies in c and has at
    most min(|x & c|, |y & c|) shingles. So a join on such shingles and a join on sizes find every pair that can reach the
    similarity. Of these, only pairs whose bitmaps allow it are compared: the intersection is at most the bits that both
    have, and as many more as share a bit in either. Leaves that differ from the centre each in their own way, however
    many, give few.
    """
    named = named.select("a", "b", "own", "main")
    open_ = named.groupBy("a").agg(F.count("*").alias("n"), F.max(F.col("own") != F.col("main")).alias("apart")).where("n > 1 and apart")
    wanted = written(named.join(open_.select("a"), "a", "left_semi"), "open")
    if wanted.isEmpty():
        return None
    full = written(compared(wanted.select("a", "b"), texts, size, novel=True), "novel")
    each = full.select("a", "b", F.explode("novel").alias("t"))
    often = each.groupBy("a", "t").agg(F.count("*").alias("times")).where("times > 1")
    shared = written(each.join(often, ["a", "t"]), "shared-novel")
    in_c = shared.where(F.col("times") > COMMON).groupBy("a", "b").agg(F.count("*").alias("h"))
    held = reduce(lambda x, y: x + y, (F.bit_count(F.get("bitmap", F.lit(k))) for k in range(WORDS)))
    width = float(np.log(101 / percent))  # sizes that can be similar enough lie in one bin or the next
    leaves = full.drop("novel", "size_a").join(in_c, ["a", "b"], "left").join(wanted, ["a", "b"])
    leaves = written(leaves.select("a", "b", "own", "main", F.col("size_b").alias("n"), "bitmap", (F.col("size_b") - held).alias("more"), (F.col("common") + F.coalesce("h", F.lit(0))).alias("i"), F.floor(F.log(F.col("size_b").cast("double")) / F.lit(width)).alias("bin")), "leaves")
    side = lambda df, s, *columns: df.select("a", *(F.col(c).alias(f"{c}_{s}") for c in columns))
    known = ("b", "own", "n", "bitmap", "more")
    left = side(leaves.where("own <> main"), "x", *known, "i", "bin").withColumn("bin", F.explode(F.sequence(F.col("bin_x") - 1, F.col("bin_x") + 1)))
    right = side(leaves, "y", *known, "i", "bin").withColumnRenamed("bin_y", "bin")
    both = (F.bit_count(F.get("bitmap_x", F.lit(k)).bitwiseAND(F.get("bitmap_y", F.lit(k)))) for k in range(WORDS))
    most = reduce(lambda x, y: x + y, both, F.least("more_x", "more_y"))
    apart = (F.col("own_x") != F.col("own_y")) & linked("n_x", "n_y", F.least("n_x", "n_y"), percent)
    by_size = left.join(right, ["a", "bin"]).where(apart & linked("n_x", "n_y", F.least("i_x", "i_y"), percent) & linked("n_x", "n_y", most, percent))
    rare = shared.where(F.col("times") <= COMMON).select("a", "b", "t").join(leaves, ["a", "b"])
    rare_y = side(rare, "y", *known, "t").withColumnRenamed("t_y", "t_x")
    by_shingle = side(rare.where("own <> main"), "x", *known, "t").join(rare_y, ["a", "t_x"]).where(apart & linked("n_x", "n_y", most, percent))
    pair = [F.least("b_x", "b_y").alias("a"), F.greatest("b_x", "b_y").alias("b")]
    return written(by_size.select(*pair).unionByName(by_shingle.select(*pair)).distinct(), "leaf-pairs")


def _nodes(sigs: DataFrame) -> tuple[DataFrame, bool]:
    """(set_key, rep, row, node of each different set, whether an id repeats): rep is the smallest id that has the set.

    A node is the set's rep. Where ids repeat with different texts, sets that share a rep with another get numbers
    above all ids instead (an error if so many aren't free).
    """
    named = sigs.where("set_key is not null and doc_id is not null")
    sets = named.groupBy("set_key").agg(F.min(F.struct("doc_id", "row")).alias("first")).select("set_key", F.col("first.doc_id").alias("rep"), "first.row", F.col("first.doc_id").alias("node"))
    repeats = not named.groupBy("doc_id").count().where("count > 1").isEmpty()
    sets = written(sets, "sets")
    if not repeats:
        return sets, False
    first = sets.groupBy("rep").agg(F.min("set_key").alias("own"), F.count("*").alias("n")).where("n > 1")
    others = sets.join(first, "rep").where("set_key <> own").select("set_key")
    last = sets.agg(F.max("rep")).first()[0]
    numbers = written(others.withColumn("number", F.monotonically_increasing_id() + F.lit((last or 0) + 1)), "numbers")
    return written(sets.join(numbers, "set_key", "left").withColumn("node", F.coalesce("number", "node")).drop("number"), "sets"), True


def row_components(documents: DataFrame, *, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, row, n_shingles, component_id, kept, node: ``node`` names the component, also where ids repeat; null where nothing is linked for want of words or of an id."""
    spark = documents.sparkSession
    shared_dir(spark)
    sigs = written(signatures(documents, size), "signatures")
    sets, repeats = _nodes(sigs)
    firsts = sigs.join(sets.select("set_key", F.col("rep").alias("doc_id"), "row", "node"), ["set_key", "doc_id", "row"])
    dealt = firsts.select("set_key", "node", "bands").dropDuplicates(["set_key"]).select("node", F.explode("bands").alias("bucket"))
    shared = dealt.groupBy("bucket").agg(F.min("node").alias("centre"), F.count("*").alias("n")).where("n > 1")
    members = written(dealt.join(shared, "bucket"), "members")
    ids = members.select("node").distinct()
    name, path = f"quire_texts_{uuid.uuid4().hex}", scratch(spark, "texts")
    if repeats:  # one row of each node's text
        rows = documents.select(F.col("doc_id").cast("long").alias("rep"), row_key(F.col("text")).alias("row"), "text")
        wanted = rows.join(sets.join(ids, "node", "left_semi").select("rep", "row", "node"), ["rep", "row"])
        wanted = wanted.select(F.col("node").alias("doc_id"), "text").dropDuplicates(["doc_id"])
    else:
        wanted = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids.withColumnRenamed("node", "doc_id"), "doc_id", "left_semi")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted.write.bucketBy(buckets, "doc_id").option("compression", "zstd").option("path", path).saveAsTable(name)
    try:
        texts = spark.table(name)
        near = linked("size_a", "size_b", F.col("common"), percent)
        stars = written(compared(members.where("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct(), texts, size), "stars")
        found = stars.where(near).select("a", "b")
        for step in (recentred, lambda named: leaf_pairs(named, texts, size, percent)):
            more = step(_with_groups(stars, connected(found)))
            if more is None:
                break
            found = found.unionByName(written(compared(more, texts, size).where(near).select("a", "b"), "links"))
        groups = connected(found)
        by_set = sets.join(groups, "node", "left").select("set_key", "rep", F.coalesce("component", "node").alias("node"))
        if repeats:  # the smallest node of a component may be a number that stands for a repeated id
            by_set = by_set.join(by_set.groupBy("node").agg(F.min("rep").alias("component_id")), "node")
        else:
            by_set = by_set.withColumn("component_id", F.col("node"))
        by_set = by_set.select("set_key", "node", "component_id")
        usable = F.col("set_key").isNotNull() & F.col("doc_id").isNotNull()
        own = sigs.select("doc_id", "row", "n_shingles", "set_key")
        with_set = own.where(usable).join(by_set, "set_key").drop("set_key")
        without = own.where(~usable).select("doc_id", "row", "n_shingles", F.lit(None).cast("long").alias("node"), F.col("doc_id").alias("component_id"))
        out = with_set.unionByName(without)
        return written(out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))), "components")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(spark, path)


def components(documents: DataFrame, *, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: the documents that links of that similarity connect, smallest id first."""
    return row_components(documents, size=size, percent=percent).select("doc_id", "n_shingles", "component_id", "kept")


def _without(documents: DataFrame, keys: DataFrame, own: str, own_row: str) -> DataFrame:
    """The rows of ``documents``, with ``own_row``, whose id and row ``keys`` (``own``, ``own_row``) doesn't have.

    A row whose id's hash is at no bit of the keys' ids stays as it is; only the others are shuffled with their texts and
    joined. So a join moves as many texts as there are keys, and few more. The bits are bounded, so many more keys than bits
    only bring more rows to the join.
    """
    bits = 64 * min(MOST_WORDS, max(1, -(-keys.count() * BITS_AN_ID // 64)))
    word, mask, own_word = unused("word", documents, keys), unused("mask", documents, keys), unused("own_word", documents, keys)
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    doc_id = documents["doc_id"].cast("long")
    masks = keys.select(place(F.col(own)).alias(word)).distinct()
    masks = masks.groupBy(F.floor(F.col(word) / 64).alias(own_word)).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({word} % 64 AS int))")).alias(mask))
    there = documents.withColumn(word, place(doc_id))
    there = there.join(F.broadcast(masks), F.floor(F.col(word) / 64) == F.col(own_word), "left")
    perhaps = F.coalesce(F.expr(f"getbit({mask}, cast({word} % 64 AS int))"), F.lit(0).cast("tinyint")) == 1
    sure = there.where(~perhaps).select(*documents.columns)
    doubtful = there.where(perhaps).select(*documents.columns)
    names = unused("key_id", doubtful, keys), unused("key_row", doubtful, keys)
    keys = keys.select(F.col(own).alias(names[0]), F.col(own_row).alias(names[1]))
    same = (F.col("doc_id").cast("long") == F.col(names[0])) & (F.col(own_row) == F.col(names[1]))
    return sure.unionByName(doubtful.join(keys, same, "left_anti"))


def one_of_each(documents: DataFrame, *, size: int = 5, percent: int = 80) -> DataFrame:
    """The documents' columns, one row of each component: that with the smallest id, then text digest. Rows without words or id stay."""
    found = row_components(documents, size=size, percent=percent).where("node is not null").select("node", "doc_id", "row")
    # written, so that the join with it can split a group that very many rows are in
    best = written(found.groupBy("node").agg(F.min(F.struct("doc_id", "row")).alias("best"), F.count("*").alias("n")).where("n > 1"), "best")
    judged = written(found.join(best.drop("n"), "node").withColumn("stays", F.struct("doc_id", "row") == F.col("best")).select("doc_id", "row", "stays"), "judged")
    own, own_row = unused("own_id", documents), unused("own_row", documents)
    keyed = documents.withColumn(own_row, row_key(F.col("text")))
    named = lambda df: df.select(F.col("doc_id").alias(own), F.col("row").alias(own_row)).distinct()
    kept = _without(keyed, named(judged.where("not stays")), own, own_row)
    again = judged.where("stays").groupBy("doc_id", "row").count().where("count > 1")
    if not again.isEmpty():  # else no text is shuffled for it
        again = named(again)
        match = (kept["doc_id"].cast("long") == again[own]) & (kept[own_row] == again[own_row])
        kept = kept.join(again, match, "left_anti").unionByName(kept.join(again, match, "left_semi").dropDuplicates(["doc_id", own_row]))
    return kept.select(*documents.columns)
