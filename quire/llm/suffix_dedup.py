"""Removal of long byte strings that an earlier document holds already.

A byte goes if a string of ``least`` bytes that covers it also starts in a document with a smaller id; strings are
compared on the input, never across documents.

Two strings that share ``least`` bytes share the least hash among the grams in them, so each window of ``least`` bytes
has a key (the minimum over its grams), neighbouring windows with one key form a segment, and equal windows meet under
one key:

1. Documents are packed into blocks where they are read, and written once as a table bucketed by block: no later step
   shuffles text.
2. Each block sends its distinct keys, in packed arrays, to ranges of the key space; a range tells each block which
   of its keys other documents have too, by a bit for each in the order sent.
3. Each block sends the segments under those keys, each distinct content once with the smallest id that has it there;
   their places stay in the block. Contents that several documents
   have whole need no search; among different contents of one key, an enhanced suffix array with its common-prefix
   interval tree (a stack scan that keeps intervals whose suffixes differ in the byte before them) lists the maximal
   repeats with all occurrences. Keys that very many documents have are dealt out by their single windows, so
   of a content that very many documents hold a range sees one row a block.
4. A range tells each block which of its contents another block has under a smaller id, a bit for each in the order sent
   (a content without it has its smallest id in the block, which knows it), and in the contents that stay the ranges that
   others hold, joined where they overlap. The blocks find keys, contents and places again.

Defined results: a null or empty text has no bytes; a null id counts as larger than every id; rows that repeat an id
don't remove each other's bytes; equal texts leave only the one with the smallest id; texts may be of any length; an
empty table gives no rows; extra columns pass through ``deduplicated``, and its own names replace clashing ones.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm import arrowtools
from quire.llm.words import mix
from quire.session import scratch, shared_dir, ship, written

LEAST, GRAM = 50, 20
#: Bytes of text in a block, and hashed at once.
BLOCK, CHUNK = 1 << 20, 1 << 17
#: Blocks to a range of the key space, at most.
BLOCKS = 16
#: Windows of a segment at most.
WINDOWS = 64
#: A key that more documents have is dealt out by windows.
HOT = 20_000
LAST_ID = np.iinfo(np.int64).max

_BASE = 0x9E3779B97F4A7C15 | 1


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` bytes, by doubling."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    part, width = data.astype(np.uint64) + np.uint64(1), 1
    made, covered = None, 0
    while True:
        if size & width:
            if made is None:
                made, covered = part, width
            else:
                made = part[: len(made) - width] * np.uint64(pow(_BASE, covered, 1 << 64)) + made[width:]
                covered += width
        if covered == size:
            return mix(made[:n])
        part = part[:-width] * np.uint64(pow(_BASE, width, 1 << 64)) + part[width:]
        width *= 2


def window_keys(data: np.ndarray, least: int, gram: int) -> np.ndarray:
    """For each start of ``least`` bytes the least hash of the grams within."""
    low = gram_hashes(data, gram)
    width, want = 1, least - gram + 1
    if len(low) < want:
        return np.zeros(0, np.uint64)
    while width * 2 <= want:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < want:
        low = np.minimum(low[: len(low) - (want - width)], low[want - width :])
    return low


def segments(data: np.ndarray, at: np.ndarray, least: int, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of windows under one key, never across documents: (key, first window, windows, document), a chunk at a time."""
    a = 0
    while a < len(at) - 1:
        b = max(a + 1, int(np.searchsorted(at, at[a] + CHUNK, "right")) - 1)
        own, there = data[at[a] : at[b]], at[a : b + 1] - at[a]
        keys = window_keys(own, least, gram)
        count = np.maximum(np.diff(there) - least + 1, 0)
        if len(keys) and count.any():
            # windows that lie in one document, in order
            doc = np.repeat(np.arange(b - a), count)
            first = np.concatenate(([0], np.cumsum(count)))
            start = np.arange(first[-1]) + np.repeat(there[:-1] - first[:-1], count)
            value = keys[start]
            new = np.empty(len(value), bool)
            new[0] = True
            new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
            runs = np.flatnonzero(new)
            # a text that repeats itself has runs without end: they are cut, so contents stay short
            size = np.diff(np.append(runs, len(value)))
            parts = -(-size // WINDOWS)
            step = (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)) * WINDOWS
            runs, size = np.repeat(runs, parts), np.minimum(np.repeat(size, parts) - step, WINDOWS)
            # minima crowd at the low end of the key space, so they are mixed once more
            yield mix(value[runs]), start[runs] + at[a] + step, size, doc[runs] + a
        a = b


# --- the common-prefix interval tree -------------------------------------------------------------------------------


def enhanced_suffix_array(texts: list[bytes], least: int) -> tuple[list[tuple[int, int]], list[int]]:
    """(text, offset) of all suffixes of at least ``least`` bytes in byte order, and each one's common prefix with the one before."""
    order = sorted(((t, o) for t, x in enumerate(texts) for o in range(len(x) - least + 1)), key=lambda s: texts[s[0]][s[1] :])
    common = [0] * len(order)
    for k in range(1, len(order)):
        (t, o), (u, p) = order[k - 1], order[k]
        x, y = texts[t][o:], texts[u][p:]
        n = min(len(x), len(y))
        if x[:n] == y[:n]:
            common[k] = n
        elif x[:least] == y[:least]:
            low, high = least, n - 1
            while low < high:  # the longest equal prefix
                mid = (low + high + 1) // 2
                low, high = (mid, high) if x[:mid] == y[:mid] else (low, mid - 1)
            common[k] = low
    return order, common


def maximal_repeats(texts: list[bytes], least: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(length, all occurrences) of each string of at least ``least`` bytes that occurs twice and can be extended on neither side in all occurrences."""
    order, common = enhanced_suffix_array(texts, least)
    before = [texts[t][o - 1] if o else -1 - k for k, (t, o) in enumerate(order)]
    # a stack of open intervals: [common prefix, first suffix, the byte before if it is one, whether it differs]
    stack: list[list] = []
    for k in range(1, len(order) + 1):
        here = common[k] if k < len(order) else 0
        first, left, diverse = k - 1, before[k - 1], False
        while stack and stack[-1][0] > here:
            depth, first, own, differs = stack.pop()
            differs = differs or diverse or own != left
            left, diverse = own, differs
            if differs:
                yield depth, order[first:k]
        if here >= least:
            if stack and stack[-1][0] == here:
                top = stack[-1]
                top[3] = top[3] or diverse or top[2] != left
            else:
                stack.append([here, first, left, diverse])


def joined(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same positions in the fewest ranges."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def earlier(contents: list[bytes], ids: list[int], least: int) -> dict[int, list[tuple[int, int]]]:
    """For each content the ranges in it that a content of a smaller id holds too."""
    found: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for length, places in maximal_repeats(contents, least):
        first = min(ids[t] for t, _ in places)
        for t, o in places:
            if ids[t] > first:
                found[t].append((o, o + length))
    return {t: joined(ranges) for t, ranges in found.items()}  # intervals nest, so one place is found many times


# --- the steps -----------------------------------------------------------------------------------------------------


def _packed(df: DataFrame, name: str, text: str) -> DataFrame:
    """The rows in blocks, written as a table bucketed by block."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for whole in batches:
            for batch in arrowtools.slices(whole, text, BLOCK):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema) as w:
                    w.write_batch(batch)
                yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "rows": pa.array([sink.getvalue().to_pybytes()], pa.binary())})
                block += 1

    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = df.mapInArrow(run, "block long, rows binary")
    blocks.write.bucketBy(n, "block").option("compression", "zstd").option("path", scratch(spark, "blocks")).saveAsTable(name)
    return spark.table(name)


def _unpack(raw: pa.Buffer) -> pa.RecordBatch:
    with pa.ipc.open_stream(pa.BufferReader(raw)) as r:
        return r.read_next_batch()


def _each(batch: pa.RecordBatch, *columns: str) -> Iterator[tuple]:
    """The rows one at a time, so that one block is in memory as Python values."""
    found = [batch.column(c) for c in columns]
    for k in range(batch.num_rows):
        yield tuple(c[k].as_buffer() if n == "rows" else c[k].as_py() for n, c in zip(columns, found, strict=True))


def _ids(batch: pa.RecordBatch, doc_id: str) -> np.ndarray:
    return np.asarray(batch.column(doc_id).cast(pa.int64()).fill_null(LAST_ID))


def _in_range(keys: np.ndarray, ranges: int) -> np.ndarray:
    """The range of each key; ranges cut the key space evenly."""
    return ((keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def _rows(**columns) -> pa.RecordBatch:
    kinds = {"range": pa.int32(), "block": pa.int64()}
    return pa.RecordBatch.from_pydict({k: pa.array(v, kinds.get(k, pa.binary())) for k, v in columns.items()})


def _bits(marks: np.ndarray) -> bytes:
    """A bit for each mark; nothing where none is set."""
    return np.packbits(marks).tobytes() if marks.any() else b""


def _marks(bits: bytes, n: int) -> np.ndarray:
    """What ``_bits`` packed."""
    return np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool) if bits else np.zeros(n, bool)


def _send_keys(blocks: DataFrame, text: str, ranges: int, least: int, gram: int) -> DataFrame:
    """Each block's distinct keys and in how many of its documents they are (up to 255), by range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, raw in _each(batch, "block", "rows"):
                data, at = arrowtools.flat_utf8(_unpack(raw).column(text))
                keys, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
                for key, _, _, doc in segments(data, at, least, gram):
                    keys.append(key)
                    docs.append(doc)
                key, doc = np.concatenate(keys), np.concatenate(docs)
                order = np.argsort(key, kind="stable")  # documents stay in order within a key
                key, doc = key[order], doc[order]
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
                key = key[new]
                first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
                many = np.minimum(np.diff(np.append(first, len(key))), 255).astype(np.uint8)
                key = key[first]
                cuts = np.searchsorted(_in_range(key, ranges), np.arange(ranges + 1))
                some = np.flatnonzero(np.diff(cuts))
                yield _rows(
                    range=some.tolist(),
                    block=[block] * len(some),
                    keys=[key[cuts[r] : cuts[r + 1]].tobytes() for r in some],
                    many=[many[cuts[r] : cuts[r + 1]].tobytes() for r in some],
                )

    return blocks.select("block", "rows").mapInArrow(run, "range int, block long, keys binary, many binary")


def _shared_keys(sent: DataFrame, hot: int) -> DataFrame:
    """For each block and range marks of the keys sent: which a second document has, and which of them are hot."""

    def run(table: pa.Table) -> pa.Table:
        numbers, blocks = table.column("range").to_pylist(), table.column("block").to_pylist()
        parts = [np.frombuffer(x, np.uint64) for x in table.column("keys").to_pylist()]
        key = np.concatenate(parts)
        many = np.concatenate([np.frombuffer(x, np.uint8) for x in table.column("many").to_pylist()]).astype(np.int64)
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1])))
        total = np.add.reduceat(many[order], first)
        per_key = np.empty(len(key), np.int64)
        per_key[order] = np.repeat(total, np.diff(np.append(first, len(key))))
        cuts = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        out: dict[str, list] = {"range": [], "block": [], "shared": [], "hot": []}
        for r, block, a, b in zip(numbers, blocks, cuts[:-1], cuts[1:], strict=True):
            mine = per_key[a:b] > 1
            if mine.any():
                out["range"].append(r)
                out["block"].append(block)
                out["shared"].append(_bits(mine))
                out["hot"].append(_bits(mine & (per_key[a:b] > hot)))
        return pa.Table.from_batches([_rows(**out)])

    return sent.groupBy("range").applyInArrow(run, "range int, block long, shared binary, hot binary")


def _gathered(table: DataFrame, *columns: str) -> DataFrame:
    """The binary values of a block in lists; a block's share is bounded by the block."""
    return table.groupBy("block").agg(F.collect_list(F.struct(*columns)).alias("parts"))


class _Shared:
    """A block's segments under shared keys, by range, each range's distinct contents in order of first occurrence.

    The same for the same block and marks, so that answers for contents find their places again.
    """

    def __init__(self, rows: pa.RecordBatch, parts: list[dict], text: str, doc_id: str, ranges: int, least: int, gram: int) -> None:
        data, at = arrowtools.flat_utf8(rows.column(text))
        self.whole, ids = data.tobytes(), _ids(rows, doc_id)
        cut = list(segments(data, at, least, gram))
        key, number = np.unique(np.concatenate([c[0] for c in cut]), return_inverse=True)  # as they were sent
        cuts = np.searchsorted(_in_range(key, ranges), np.arange(ranges + 1))
        shared, hot = np.zeros(len(key), bool), np.zeros(len(key), bool)
        for p in parts:
            a, b = cuts[p["range"]], cuts[p["range"] + 1]
            shared[a:b], hot[a:b] = _marks(p["shared"], b - a), _marks(p["hot"], b - a)
        found = [[np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
        used = 0
        for value, start, count, doc in cut:
            k = number[used : used + len(value)]
            used += len(value)
            single = hot[k]
            plain = shared[k] & ~single
            for to, x in zip(found, (value[plain], start[plain], count[plain] + least - 1, doc[plain]), strict=True):
                to.append(x)
            if single.any():  # a hot key's windows, each under a key of its own
                n = count[single]
                first = np.concatenate(([0], np.cumsum(n)))
                each = np.arange(first[-1]) + np.repeat(start[single] - first[:-1], n)
                power = gram_hashes(data[each[0] : each[-1] + least], least)[each - each[0]]
                for to, x in zip(found, (power, each, np.full(len(each), least), np.repeat(doc[single], n)), strict=True):
                    to.append(x)
        value, start, size, doc = (np.concatenate(x) for x in found)
        where = _in_range(value, ranges)
        order = np.argsort(where, kind="stable")
        where, self.start, self.size, self.doc = where[order], start[order], size[order], ids[doc[order]]
        self.cuts = np.searchsorted(where, np.arange(ranges + 1))
        self.ranges = np.flatnonzero(np.diff(self.cuts)).tolist()

    def contents(self, r: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """A range's distinct contents, the number of each segment's content, and the smallest id of each content here."""
        distinct: dict[bytes, int] = {}
        part = slice(self.cuts[r], self.cuts[r + 1])
        whole = self.whole
        found = [distinct.setdefault(whole[s : s + n], len(distinct)) for s, n in zip(self.start[part].tolist(), self.size[part].tolist(), strict=True)]
        number, low = np.array(found, np.int64), np.full(len(distinct), LAST_ID)
        np.minimum.at(low, number, self.doc[part])
        return list(distinct), number, low


def _send_segments(blocks: DataFrame, shared: DataFrame, text: str, doc_id: str, ranges: int, least: int, gram: int) -> DataFrame:
    """The segments under shared keys, by range: each distinct content once, with the smallest id that has it here.

    Places stay in the block, so a content that very many documents hold costs a range one row a block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, raw, parts in _each(batch, "block", "rows", "parts"):
                own = _Shared(_unpack(raw), parts, text, doc_id, ranges, least, gram)
                out: dict[str, list] = {c: [] for c in ("range", "block", "sizes", "contents", "ids")}
                for r in own.ranges:
                    texts, _, low = own.contents(r)
                    out["range"].append(r)
                    out["block"].append(block)
                    out["sizes"].append(np.fromiter(map(len, texts), np.uint32, len(texts)).tobytes())
                    out["contents"].append(b"".join(texts))
                    out["ids"].append(low.tobytes())
                yield _rows(**out)

    joined = blocks.select("block", "rows").join(_gathered(shared, "range", "shared", "hot").hint("shuffle_hash"), "block")
    return joined.mapInArrow(run, "range int, block long, sizes binary, contents binary, ids binary")


def resolve(contents: dict[bytes, int], least: int, gram: int) -> dict[bytes, list[tuple[int, int]]]:
    """Of contents with the smallest id of each: the ranges that a different content of a smaller id holds too."""
    texts = list(contents)
    if not texts:
        return {}
    data = np.frombuffer(b"".join(texts), np.uint8)
    at = np.concatenate(([0], np.cumsum([len(x) for x in texts])))
    windows = gram_hashes(data, least)
    count = np.diff(at) - least + 1
    first = np.concatenate(([0], np.cumsum(count)))
    owner = np.repeat(np.arange(len(texts)), count)
    value = windows[np.arange(first[-1]) + np.repeat(at[:-1] - first[:-1], count)]
    # contents are searched together if a window of one may be a window of another
    order = np.argsort(value, kind="stable")
    value, owner = value[order], owner[order]
    meets = (value[1:] == value[:-1]) & (owner[1:] != owner[:-1])
    if not meets.any():
        return {}
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in set(zip(owner[:-1][meets].tolist(), owner[1:][meets].tolist(), strict=True)):
        parent[root(a)] = root(b)
    groups: dict[int, list[int]] = defaultdict(list)
    for x in list(parent):
        groups[root(x)].append(x)
    found: dict[bytes, list[tuple[int, int]]] = {}
    for group in groups.values():
        own = [texts[x] for x in group]
        for t, spans in earlier(own, [contents[x] for x in own], least).items():
            found[own[t]] = spans
    return found


def _answers(sent: DataFrame, least: int, gram: int) -> DataFrame:
    """For each block and range marks of the contents sent that have a smaller id elsewhere, and in the rest the ranges (content, start, end) that others of smaller ids hold."""

    def run(table: pa.Table) -> pa.Table:
        messages = []
        smallest: dict[bytes, int] = {}
        for r, block, sizes, raw, ids in zip(*(table.column(c).to_pylist() for c in ("range", "block", "sizes", "contents", "ids")), strict=True):
            ends = np.cumsum(np.frombuffer(sizes, np.uint32).astype(np.int64))
            texts = [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
            for x, d in zip(texts, np.frombuffer(ids, np.int64).tolist(), strict=True):
                if d < smallest.get(x, LAST_ID + 1):
                    smallest[x] = d
            messages.append((r, block, texts, ids))
        partly = resolve(smallest, least, gram)
        out: dict[str, list] = {"range": [], "block": [], "later": [], "spans": []}
        for r, block, texts, ids in messages:
            later = np.fromiter((smallest[x] for x in texts), np.int64, len(texts)) < np.frombuffer(ids, np.int64)
            # of a content that has a smaller id elsewhere all places in the block go, so its ranges say nothing more
            spans = [(k, a, b) for k, (x, gone) in enumerate(zip(texts, later.tolist(), strict=True)) if not gone for a, b in partly.get(x, ())] if partly else []
            if spans or later.any():
                out["range"].append(r)
                out["block"].append(block)
                out["later"].append(_bits(later))
                out["spans"].append(np.array(spans, np.uint32).tobytes())
        return pa.Table.from_batches([_rows(**out)])

    return sent.groupBy("range").applyInArrow(run, "range int, block long, later binary, spans binary")


def _finished(blocks: DataFrame, shared: DataFrame, answers: DataFrame, schema: T.StructType, text: str, doc_id: str, ranges: int, least: int, gram: int, made: tuple[str, str, str]) -> DataFrame:
    """Each block finds the places of its contents again and cuts out what the answers say."""
    names = [n for n in schema.names if n not in made]
    kinds = T.StructType([*(schema[n] for n in names), *(T.StructField(n, t) for n, t in zip(made, (T.BinaryType(), T.ArrayType(T.LongType()), T.ArrayType(T.LongType())), strict=True))])

    def removed(rows: pa.RecordBatch, parts: list[dict], told: list[dict]) -> tuple[np.ndarray, np.ndarray]:
        own = _Shared(rows, parts, text, doc_id, ranges, least, gram)
        starts, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        answers = {t["range"]: t for t in told}
        for r in own.ranges:
            part = slice(own.cuts[r], own.cuts[r + 1])
            place, size, doc = own.start[part], own.size[part], own.doc[part]
            if r not in answers and (doc == doc[0]).all():
                continue
            t = answers.get(r, {"later": b"", "spans": b""})
            spans = np.frombuffer(t["spans"], np.uint32).reshape(-1, 3).astype(np.int64)
            _, number, low = own.contents(r)
            # a block with the smallest id of a content may have later documents of its own
            whole = (doc > low[number]) | _marks(t["later"], len(low))[number]
            starts.append(place[whole])
            ends.append(place[whole] + size[whole])
            if len(spans):  # each span at each place of its content that stays
                rest = np.flatnonzero(~whole)
                rest = rest[np.argsort(number[rest], kind="stable")]
                low, high = (np.searchsorted(number[rest], spans[:, 0], side) for side in ("left", "right"))
                n = high - low
                at = place[rest[np.arange(n.sum()) + np.repeat(low - np.cumsum(n) + n, n)]]
                starts.append(at + np.repeat(spans[:, 1], n))
                ends.append(at + np.repeat(spans[:, 2], n))
        return np.concatenate(starts), np.concatenate(ends)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw, parts, told in _each(batch, "rows", "parts", "told"):
                rows = _unpack(raw)
                data, at = arrowtools.flat_utf8(rows.column(text))
                edge = np.zeros(len(data) + 1, np.int32)
                if parts:
                    for where, step in zip(removed(rows, parts, told or []), (1, -1), strict=True):
                        np.add.at(edge, where, step)
                gone = np.cumsum(edge[:-1]) > 0
                kept, starts, ends = [], [], []
                for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    here = gone[a:b]
                    if not here.any():
                        kept.append(data[a:b].tobytes())
                        starts.append([])
                        ends.append([])
                        continue
                    kept.append(data[a:b][~here].tobytes())
                    step = np.flatnonzero(np.diff(np.concatenate(([False], here, [False])).astype(np.int8)))
                    starts.append(step[::2].tolist())
                    ends.append(step[1::2].tolist())
                added = [pa.array(kept, pa.binary()), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*(rows.column(n) for n in names), *added], [*names, *made])

    both = _gathered(shared, "range", "shared", "hot").join(answers.groupBy("block").agg(F.collect_list(F.struct("range", "later", "spans")).alias("told")), "block", "left")
    joined = blocks.select("block", "rows").join(both.hint("shuffle_hash"), "block", "left")
    return joined.select("rows", "parts", "told").mapInArrow(run, kinds)


def deduplicated(documents: DataFrame, *, least: int = LEAST, gram: int = GRAM, hot: int = HOT, doc_id: str = "doc_id", text: str = "text", kept: str = "kept", span_starts: str = "span_starts", span_ends: str = "span_ends") -> DataFrame:
    """The documents' columns with kept (the remaining bytes), span_starts and span_ends (the removed runs, in bytes), under names that can be chosen."""
    if not 0 < gram <= least:
        raise ValueError("gram must be from 1 to least")
    spark = documents.sparkSession
    shared_dir(spark)
    name = f"quire_blocks_{uuid.uuid4().hex}"
    blocks = _packed(documents, name, text)
    # the key space is cut finer as the blocks grow in number, so a range's share stays the same
    ranges = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), blocks.count() // BLOCKS)
    shared = written(_shared_keys(_send_keys(blocks, text, ranges, least, gram), hot), "shared-keys")
    sent = _send_segments(blocks, shared, text, doc_id, ranges, least, gram)
    answers = written(_answers(sent, least, gram), "answers")
    out = _finished(blocks, shared, answers, documents.schema, text, doc_id, ranges, least, gram, (kept, span_starts, span_ends))
    spark.sql(f"DROP TABLE IF EXISTS {name}")  # the catalogue's entry; the files stay in the shared folder
    return out


def digests(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    out = deduplicated(documents.select("doc_id", "text"))
    n = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return out.select(
        "doc_id",
        n.alias("n_bytes"),
        (n - F.octet_length("kept")).alias("n_removed"),
        F.size("span_starts").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
