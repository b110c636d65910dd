"""The text compression model: tokens, their statistics, dictionaries, code lengths and size estimates."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import codes
from quire.operators.index import Collection, numbered
from quire.session import ship, unused, written

#: Longest token, and most digits in a word. Fixed values.
LONGEST, DIGITS = 15, 4
_WORD = frozenset(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_DIGIT = frozenset(b"0123456789")


_RUN = re.compile(rb"[0-9A-Za-z]+|[^0-9A-Za-z]+")
_MANY_DIGITS = re.compile(rb"(?:[^0-9]*[0-9]){%d}" % (DIGITS + 1))


def _pieces(run: bytes, kind: int) -> list[bytes]:
    """A run of one kind in tokens."""
    out, at = [], 0
    while at < len(run):
        end, digits = at, 0
        while end < len(run) and end - at < LONGEST:
            if kind and run[end] in _DIGIT:
                if digits == DIGITS:
                    break
                digits += 1
            end += 1
        out.append(run[at:end])
        at = end
    return out


def token_list(raw: bytes) -> list[tuple[int, bytes]]:
    """(kind, token): words (1) and what is between them (0) in turn, each up to LONGEST bytes; where two of a kind would follow, an empty one of the other stands between."""
    out: list[tuple[int, bytes]] = []
    for run in _RUN.findall(raw):
        kind = int(run[0] in _WORD)
        if len(run) <= LONGEST and not (kind and len(run) > DIGITS and _MANY_DIGITS.match(run)):
            out.append((kind, run))
            continue
        for k, piece in enumerate(_pieces(run, kind)):
            if k:
                out.append((1 - kind, b""))
            out.append((kind, piece))
    return out


def token_statistics(docs: DataFrame) -> DataFrame:
    """kind, tok (binary), freq, first_doc, first_pos of the documents' tokens: frequency and first occurrence.

    Tokens are counted where their texts are, so what is shuffled grows with vocabularies.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[tuple[int, bytes], list[int]] = {}
            for docnum, text in zip(batch.column("docnum").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for pos, token in enumerate(token_list((text or "").encode())):
                    got = seen.get(token)
                    if got is None:
                        seen[token] = [1, docnum, pos]
                    else:
                        got[0] += 1
                        if docnum < got[1]:
                            got[1:] = docnum, pos
            yield pa.RecordBatch.from_pydict(
                {
                    "kind": pa.array([k for k, _ in seen], pa.int32()), "tok": pa.array([t for _, t in seen], pa.binary()),
                    **{n: pa.array([v[j] for v in seen.values()], pa.int64()) for j, n in enumerate(("freq", "first_doc", "first_pos"))},
                }
            )

    ship(docs.sparkSession)
    parts = docs.select(F.col("docnum").cast("long").alias("docnum"), "text").mapInArrow(run, "kind int, tok binary, freq long, first_doc long, first_pos long")
    first = F.min(F.struct("first_doc", "first_pos"))
    return parts.groupBy("kind", "tok").agg(F.sum("freq").alias("freq"), first.alias("first")).select("kind", "tok", "freq", "first.first_doc", "first.first_pos")


def dictionary(stats: DataFrame, kilobytes: int | None, *, by: str = "frequency", pointer: int = 8) -> DataFrame:
    """The tokens that fit: taken by frequency (then length) or by first occurrence, up to the one that crosses the limit; all without a limit.

    A token takes at least its pointer, so only so many can fit; the running sum goes over those alone.
    """
    if kilobytes is None:
        return stats
    order = [F.desc("freq"), F.octet_length("tok"), "tok"] if by == "frequency" else ["first_doc", "first_pos"]
    most = kilobytes * 1024 // pointer + 1
    first = reduce(DataFrame.unionByName, (stats.where(F.col("kind") == k).orderBy(*order).limit(most) for k in (0, 1)))
    before = F.sum(F.octet_length("tok") + pointer).over(Window.partitionBy("kind").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return first.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < kilobytes * 1024).drop("before")


def novel(stats: DataFrame, chosen: DataFrame) -> DataFrame:
    """The tokens that the dictionary lacks: what an auxiliary dictionary holds."""
    return stats.join(chosen.select("kind", "tok"), ["kind", "tok"], "left_anti")


def code_lengths(frequencies: dict) -> dict:
    """Huffman code length of each symbol; a single symbol has one bit."""
    heap = [(f, k, (s,)) for k, (s, f) in enumerate(sorted(frequencies.items(), key=lambda x: (x[1], str(x[0])))) if f > 0]
    if len(heap) == 1:
        return {heap[0][2][0]: 1}
    lengths = dict.fromkeys((s for _, _, own in heap for s in own), 0)
    heapq.heapify(heap)
    n = len(heap)
    while len(heap) > 1:
        (f, _, a), (g, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        for s in a + b:
            lengths[s] += 1
        heapq.heappush(heap, (f + g, n, a + b))
        n += 1
    return lengths


def canonical_codes(lengths: dict) -> dict:
    """Code of each symbol as a string of bits: numbers that count up within a length, symbols in order."""
    code, last, out = 0, 0, {}
    for symbol, length in sorted(lengths.items(), key=lambda x: (x[1], str(x[0]))):
        code <<= length - last
        out[symbol] = format(code, f"0{length}b")
        code, last = code + 1, length
    return out


def coded(chosen: DataFrame, aside: DataFrame) -> DataFrame:
    """kind, tok, freq, bits, code of a dictionary's tokens, and for each kind an escape (tok null) as often as tokens of ``aside`` occur.

    A dictionary has a bounded size, so its codes are made on the driver.
    """
    escapes = {r["kind"]: r["n"] for r in aside.groupBy("kind").agg(F.sum("freq").alias("n")).collect()}  # two rows
    rows = [(r["kind"], bytes(r["tok"]), r["freq"]) for r in chosen.select("kind", "tok", "freq").collect()]
    out = []
    for kind in (0, 1):
        own = {tok: f for k, tok, f in rows if k == kind} | ({None: escapes[kind]} if escapes.get(kind) else {})
        lengths = code_lengths(own)
        codes_ = canonical_codes(lengths)
        out += [(kind, tok, f, lengths[tok], codes_[tok]) for tok, f in own.items()]
    return chosen.sparkSession.createDataFrame(out, "kind int, tok binary, freq long, bits int, code string")


#: Bits that a document's end takes on average. Fixed value.
END_BITS = 5.5


def compressed_size(chosen: DataFrame, aside: DataFrame, n_docs: int) -> DataFrame:
    """One row of estimated bits: dictionary tokens and escapes by their codes, novel tokens by the delta code of their rank
    by frequency, spelt out once in eight bits a byte, and the documents' ends."""
    known = coded(chosen, aside).agg(F.coalesce(F.sum(F.col("freq") * F.col("bits")), F.lit(0)).alias("code_bits"), F.lit(1).alias("one"))
    ranked = numbered(aside.select(F.struct((-F.col("freq")).alias("f"), "kind", "tok").alias("rank"), "freq", "tok"), "rank")
    spelt = ranked.agg(
        F.coalesce(F.sum(F.col("freq") * codes.delta(F.col("docnum") + 1)), F.lit(0)).alias("novel_bits"),
        F.coalesce(F.sum(8 * (F.octet_length("tok") + 1)), F.lit(0)).alias("spelling_bits"),
        F.lit(1).alias("one"),
    )
    return known.join(spelt, "one").select("code_bits", "novel_bits", "spelling_bits", F.lit(END_BITS * n_docs).alias("end_bits"))


def entropy(stats: DataFrame) -> DataFrame:
    """kind, bits: the least bits that a code of these tokens takes."""
    total = stats.groupBy("kind").agg(F.sum("freq").alias("total"))
    return stats.join(total, "kind").groupBy("kind").agg(F.sum(-F.col("freq") * F.log2(F.col("freq") / F.col("total"))).alias("bits"))


def index_sizes(postings: DataFrame, lexicon: DataFrame, n_docs: int) -> DataFrame:
    """One row of estimated bits: gaps by the model 0.99 + f(1.6 + log2(N/f)), and f_dt in gamma codes."""
    gaps = lexicon.agg(F.sum(F.lit(0.99) + F.col("f_t") * (F.lit(1.6) + F.log2(F.lit(float(n_docs)) / F.col("f_t")))).alias("gap_bits"), F.lit(1).alias("one"))
    counts = postings.agg(F.sum(codes.gamma(F.col("f_dt"))).cast("long").alias("gamma_bits"), F.sum("f_dt").alias("unary_bits"), F.lit(1).alias("one"))
    return gaps.join(counts, "one").drop("one")


def running(df: DataFrame, key: str, *values: str) -> DataFrame:
    """df with the running sums of ``values`` in order of ``key``: sums within written ranges of the key, and each range's offset."""
    part = unused("part", df)
    ranges = written(df.repartitionByRange(key).withColumn(part, F.spark_partition_id()), "running")
    total, rows = [0] * len(values), []
    for row in sorted(tuple(r) for r in ranges.groupBy(part).agg(*(F.sum(v) for v in values)).collect()):  # a row a partition
        rows.append((row[0], *total))
        total = [a + (b or 0) for a, b in zip(total, row[1:], strict=True)]
    names = [f"before {v}" for v in values]
    offsets = df.sparkSession.createDataFrame(rows, f"`{part}` int, " + ", ".join(f"`{n}` long" for n in names))
    within = Window.partitionBy(part).orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    out = ranges.join(F.broadcast(offsets), part)
    return out.withColumns({v: F.col(n) + F.sum(v).over(within) for v, n in zip(values, names, strict=True)}).drop(part, *names)


def growth(docs: DataFrame, kilobytes: int = 64) -> DataFrame:
    """chunk, n_docs, n_bytes: the documents and bytes so far, each time that another ``kilobytes`` of text in order of docnum are full."""
    sizes = docs.select("docnum", F.lit(1).cast("long").alias("n_docs"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    chunk = F.floor(F.col("n_bytes") / F.lit(kilobytes * 1024))
    return running(sizes, "docnum", "n_docs", "n_bytes").groupBy(chunk.alias("chunk")).agg(F.max("n_docs").alias("n_docs"), F.max("n_bytes").alias("n_bytes"))


def report(path: str, spark: SparkSession) -> DataFrame:
    """name, bytes, percent: the size of each table of a saved collection, and its share of the text."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    sizes = {n: store.getContentSummary(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}")).getLength() for n in Collection.TABLES}
    text = Collection.open(spark, path).meta.first()["n_bytes"] or 1
    return spark.createDataFrame([(n, b, 100.0 * b / text) for n, b in sizes.items()], "name string, bytes long, percent double")
