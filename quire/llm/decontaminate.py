"""Benchmark items found in documents, in DataFrame functions alone.

Words are runs of characters other than space and ASCII control white space, in lower case; shingles are five of them
(all of them, for an item with fewer), known by 64-bit hashes.

1. A window has an item's number of words and starts anywhere. To be similar enough it must hold at least PERCENT in a
   hundred of an item's shingles, at whatever offsets, so starts with fewer positions that hold a shingle of an item with as
   many words are left out: an exact necessary condition, counted over the positions that meet an item's shingle.
2. Each window and each item has a SimHash over its shingles, weighted by their counts. The 64 bits are cut into
   RADIUS + 1 blocks: two fingerprints within RADIUS agree in one of them at least, so a join on (words, block, bits)
   meets all of them. At a similarity of 0.8 fingerprints differ by 10 bits on average (standard deviation 3).
3. Pairs within the radius are decided by their exact weighted similarity, the sum of smaller counts over the sum of larger ones.

The items are broadcast in parts of about ``MOST_BROADCAST`` shingles: one part for a usual benchmark, and a pass over the
documents for each part beyond, so a broadcast never grows with the benchmark.

Defined results: a null or empty text has no words and matches nothing, as an item or a document; repeated rows are
judged each, and rows that repeat an id and match one item give one row of ``matches`` with the best match; a null doc_id or item_id is kept as such;
windows that reach over a text's ends are cut there; empty tables give no rows; extra columns are ignored by ``matches``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.session import shared_dir, written

WORDS, PERCENT, RADIUS = 5, 80, 23
#: Shingles and fingerprint blocks of items that are broadcast at once (about 100 bytes each).
MOST_BROADCAST = 500_000
#: Places of a document that are in one row as windows are cut, so that a window's row doesn't grow with its document.
PIECE = 4096

_BITS = 64
_CUTS = [k * _BITS // (RADIUS + 1) for k in range(RADIUS + 2)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


#: The bits of each block.
MASKS = [_signed(sum(1 << b for b in range(_CUTS[k], _CUTS[k + 1]))) for k in range(RADIUS + 1)]


def hashed_words(text: Column) -> Column:
    """array<bigint>: a hash of each word."""
    parts = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), "")
    return F.transform(parts, lambda w: F.xxhash64(w))


def shingled(words: Column, size: int) -> Column:
    """array<bigint>: a hash of each run of ``size`` words."""
    starts = F.slice(words, F.lit(1), F.greatest(F.size(words) - (size - 1), F.lit(0)))
    return F.transform(starts, lambda x, i: F.xxhash64(x, *(F.get(words, i + k) for k in range(1, size))))


def simhash(shingles: Column) -> Column:
    """The 64 signs of the shingles' summed bits; a shingle counts as often as it stands there."""
    bit = lambda x, b: F.call_function("shiftrightunsigned", x, b).bitwiseAND(F.lit(1).cast("long"))
    ones = lambda b: F.aggregate(shingles, F.lit(0).cast("long"), lambda n, x: n + bit(x, b))
    bits = F.transform(F.sequence(F.lit(0), F.lit(_BITS - 1)), lambda b: F.when(ones(b) * 2 > F.size(shingles), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))


def common(a: Column, b: Column) -> Column:
    """Summed smaller counts of two bags."""
    count = lambda bag, x: F.size(F.filter(bag, lambda y: y == x))
    both = F.array_intersect(a, b)
    # where no shingle repeats in one of them, each that both hold counts once
    single = (F.size(F.array_distinct(a)) == F.size(a)) | (F.size(F.array_distinct(b)) == F.size(b))
    return F.when(single, F.size(both)).otherwise(F.aggregate(both, F.lit(0), lambda n, x: n + F.least(count(a, x), count(b, x))))


def _items(benchmark: DataFrame) -> DataFrame:
    """no, item_id, n_words, size, there: an item's shingles of ``size`` words. Written, so that no lambda builds them again."""
    words = benchmark.select("item_id", hashed_words(F.col("text")).alias("words"))
    words = written(words.where(F.size("words") > 0).withColumn("no", F.monotonically_increasing_id()), "items")
    sized = words.select("no", "item_id", "words", F.size("words").alias("n_words"), F.least(F.size("words"), F.lit(WORDS)).alias("size"))
    several = F.when(F.col("size") == WORDS, shingled(F.col("words"), WORDS))
    for k in range(1, WORDS):
        several = several.when(F.col("size") == k, shingled(F.col("words"), k))
    return written(sized.select("no", "item_id", "n_words", "size", several.alias("there")), "items")


def _starts(met: Column, n_words: Column, size: int) -> Column:
    """array<struct<first, last>>: the runs of starts whose window has enough of the sorted positions ``met``."""
    n_shingles = n_words - (size - 1)
    need = F.ceil(n_shingles * PERCENT / 100).cast("int")
    # starts after the position before p that reach from p to the need-th position have p as their first
    reach = lambda k: F.get(met, k + need - 1) - (n_shingles - 1)
    after = lambda k: F.when(k > 0, F.greatest(F.get(met, k - 1) + 1, reach(k))).otherwise(reach(k))
    runs = F.transform(met, lambda p, k: F.struct(after(k).alias("first"), p.alias("last"), (k + need).alias("used")))
    return F.filter(runs, lambda r: (r["used"] <= F.size(met)) & (r["first"] <= r["last"]))


def _windows(documents: DataFrame, items: DataFrame, size: int) -> DataFrame:
    """doc_id, row, start, n_words, window: the windows that hold enough shingles of items with as many words, at any offset."""
    anchors = items.select("n_words", F.explode_outer("there").alias("shingle")).distinct()
    named = documents.select("doc_id", F.xxhash64("text").alias("row"), "text")
    words = named.select("doc_id", "row", hashed_words(F.col("text")).alias("words"))
    # explode would have its array built twice, within a filter on its size too; explode_outer has not
    runs = words.select("doc_id", "row", shingled(F.col("words"), size).alias("here")).select("doc_id", "row", F.posexplode_outer("here").alias("pos", "shingle"))
    met = runs.join(F.broadcast(anchors), "shingle").groupBy("doc_id", "row", "n_words").agg(F.array_sort(F.collect_set("pos")).alias("met"))
    met = written(met, "met")  # else the lambdas sort it again at each position
    starts = met.select("doc_id", "row", "n_words", F.inline(_starts(F.col("met"), F.col("n_words"), size)))
    starts = starts.select(F.col("doc_id").alias("own"), F.col("row").alias("own_row"), "n_words", F.explode_outer(F.sequence("first", "last")).alias("start"))
    starts = written(starts.withColumn("own_piece", F.expr(f"greatest(start, 0) div {PIECE}")), "starts")
    # shingles of the documents with such starts, in pieces that hold every window that begins in them whole
    both = named.join(starts.select("own", "own_row").distinct(), F.col("doc_id").eqNullSafe(F.col("own")) & (F.col("row") == F.col("own_row")), "left_semi")
    words = both.dropDuplicates(["doc_id", "row"]).select("doc_id", "row", hashed_words(F.col("text")).alias("words"))
    here = written(words.select("doc_id", "row", shingled(F.col("words"), size).alias("here")), "here")
    longest = items.agg(F.max("n_words")).first()[0] or 0
    part = lambda k: F.slice("here", k * PIECE + 1, F.lit(PIECE + longest))
    count = F.ceil(F.size("here") / PIECE).cast("int")
    pieces = here.where(F.size("here") > 0).select("doc_id", "row", F.posexplode_outer(F.transform(F.sequence(F.lit(0), count - 1), part)).alias("piece", "here"))
    each = pieces.join(starts, F.col("doc_id").eqNullSafe(F.col("own")) & (F.col("row") == F.col("own_row")) & (F.col("piece") == F.col("own_piece")))
    first = F.greatest("start", F.lit(0)) - F.col("piece") * PIECE
    end = F.least(F.size("here"), F.col("start") - F.col("piece") * PIECE + F.col("n_words") - (size - 1))
    return each.select("doc_id", "row", "start", "n_words", F.slice("here", first.cast("int") + 1, (end - first).cast("int")).alias("window"))


def _matches(documents: DataFrame, items: DataFrame, size: int) -> DataFrame:
    """The matches of items whose shingles have ``size`` words."""
    items = items.where(F.col("size") == size)
    windows = written(_windows(documents, items, size), "windows")
    windows = written(windows.withColumn("print", simhash(F.col("window"))), "windows")
    items = written(items.withColumn("item_print", simhash(F.col("there"))), "items")
    keyed = lambda df, name: df.select("*", F.posexplode_outer(F.array(*(F.col(name).bitwiseAND(F.lit(m)) for m in MASKS))).alias("block", "bits"))
    near = keyed(windows, "print").join(F.broadcast(keyed(items.select("no", "n_words", "item_print"), "item_print")), ["n_words", "block", "bits"])
    differ = F.col("print").bitwiseXOR(F.col("item_print"))
    # a pair that agrees in several blocks counts in the first
    blocks = F.array(*(F.lit(m) for m in MASKS))
    sooner = F.exists(F.slice(blocks, F.lit(1), F.col("block")), lambda m: differ.bitwiseAND(m) == 0)
    near = near.where((F.bit_count(differ) <= RADIUS) & ~sooner).join(F.broadcast(items.select("no", "item_id", "there")), "no")
    # written, so that the filter doesn't compare the bags again
    near = written(near.select("doc_id", "row", "item_id", "start", common(F.col("there"), F.col("window")).alias("both"), (F.size("there") + F.size("window")).alias("sizes")), "near")
    return near.where(F.col("both") * 100 >= (F.col("sizes") - F.col("both")) * PERCENT)


def row_matches(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, row, item_id, both, sizes, start: every window that matches; ``row`` is ``xxhash64(text)``."""
    shared_dir(documents.sparkSession)
    items = _items(benchmark)
    sizes = items.groupBy("size").agg(F.sum(F.size("there") + len(MASKS)).alias("n")).collect()  # five rows at most
    found = []
    for size, n in sorted((r["size"], r["n"]) for r in sizes) or [(WORDS, 0)]:
        parts = 1 + n // MOST_BROADCAST
        part = F.pmod(F.xxhash64("no"), F.lit(parts))
        found += [_matches(documents, items.where(part == k) if parts > 1 else items, size) for k in range(parts)]
    return reduce(DataFrame.unionByName, found)


def matches(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, similarity, start: each item that a document holds, with its best window (its first word's position, from 0)."""
    best = F.struct((F.col("both") / (F.col("sizes") - F.col("both"))).alias("similarity"), (-F.col("start")).alias("start"))
    found = row_matches(documents, benchmark).groupBy("doc_id", "item_id").agg(F.max(best).alias("best"))
    return found.select("doc_id", "item_id", "best.similarity", (-F.col("best.start")).alias("start"))


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item. Rows that share an id, or have none, are judged each by its own text."""
    found = row_matches(documents, benchmark).select(F.col("doc_id").alias("own"), F.col("row").alias("own_row")).distinct()
    held = documents["doc_id"].eqNullSafe(found["own"]) & (F.xxhash64(documents["text"]) == found["own_row"])
    return documents.join(found, held, "left_anti").select(*documents.columns)
