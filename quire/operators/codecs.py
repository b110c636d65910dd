"""Lossless image codecs, run where the images are: an adaptive arithmetic coder for bilevel images, with or without another
image that is known already, and a coder of grey images by ranges between neighbours (Howard and Vitter's).

The bit strings are this library's own; only the round trip is promised. Grey images of one width are coded side by side:
a step of Python goes to the same pixel of all of them. Bilevel images, and grey ones with few others of their width, cost a step
for each pixel. So a large image is best cut into strips (``strips``), which share steps and which tasks share.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.session import ship

#: Pixels before a pixel that are its context, as (row, column) offsets; and those of the other image around it.
BEFORE = ((-2, -1), (-2, 0), (-2, 1), (-1, -2), (-1, -1), (-1, 0), (-1, 1), (-1, 2), (0, -2), (0, -1))
AROUND = tuple((y, x) for y in (-1, 0, 1) for x in (-1, 0, 1))
TOP, HALF, QUARTER = (1 << 32) - 1, 1 << 31, 1 << 30
MOST_COUNT = 1 << 14
#: Rice parameters that a context chooses among.
RICE = range(8)
#: So few grey images of one width are coded one by one, and so many pixels at most side by side.
FEW, SIDE_BY_SIDE = 12, 1 << 22


class _Counts:
    """How often each bit followed each context."""

    def __init__(self) -> None:
        self.seen: dict[int, list[int]] = {}

    def split(self, context: int, low: int, high: int) -> int:
        """The last number of the part of low..high that stands for a zero."""
        zero, one = self.seen.setdefault(context, [1, 1])
        return low + (high - low) * zero // (zero + one)

    def add(self, context: int, bit: int) -> None:
        own = self.seen[context]
        own[bit] += 2
        if sum(own) > MOST_COUNT:
            own[:] = [own[0] // 2 + 1, own[1] // 2 + 1]


class Encoder:
    """Bits with contexts into bits."""

    def __init__(self) -> None:
        self.low, self.high, self.pending, self.out, self.counts = 0, TOP, 0, [], _Counts()

    def _emit(self, bit: int) -> None:
        self.out += [bit, *[1 - bit] * self.pending]
        self.pending = 0

    def put(self, context: int, bit: int) -> None:
        middle = self.counts.split(context, self.low, self.high)
        self.low, self.high = (middle + 1, self.high) if bit else (self.low, middle)
        self.counts.add(context, bit)
        while True:
            if self.high < HALF or self.low >= HALF:
                self._emit(int(self.low >= HALF))
                base = HALF if self.low >= HALF else 0
            elif self.low >= QUARTER and self.high < 3 * QUARTER:
                self.pending += 1
                base = QUARTER
            else:
                return
            self.low, self.high = 2 * (self.low - base), 2 * (self.high - base) + 1

    def done(self) -> bytes:
        self.pending += 1
        self._emit(int(self.low >= QUARTER))
        return np.packbits(np.array(self.out, np.uint8)).tobytes()


class Decoder:
    """What Encoder made, back into bits."""

    def __init__(self, raw: bytes) -> None:
        self.bits = iter(np.unpackbits(np.frombuffer(raw, np.uint8)).tolist())
        self.low, self.high, self.counts, self.value = 0, TOP, _Counts(), 0
        for _ in range(32):
            self.value = 2 * self.value + next(self.bits, 0)

    def get(self, context: int) -> int:
        middle = self.counts.split(context, self.low, self.high)
        bit = int(self.value > middle)
        self.low, self.high = (middle + 1, self.high) if bit else (self.low, middle)
        self.counts.add(context, bit)
        while True:
            if self.high < HALF or self.low >= HALF:
                base = HALF if self.low >= HALF else 0
            elif self.low >= QUARTER and self.high < 3 * QUARTER:
                base = QUARTER
            else:
                return bit
            self.low, self.high = 2 * (self.low - base), 2 * (self.high - base) + 1
            self.value = 2 * (self.value - base) + next(self.bits, 0)


def _bilevel(height: int, width: int, other: np.ndarray | None, step: Callable[[int, int, int], int]) -> np.ndarray:
    """Goes over the pixels with their contexts; ``step`` tells or learns each pixel."""
    page = np.zeros((height + 2, width + 4), np.int64)  # a margin above, to the left and to the right
    known = None if other is None else np.pad(other.astype(np.int64), 1).tolist()
    rows = page.tolist()
    for y in range(height):
        for x in range(width):
            context = 0
            for dy, dx in BEFORE:
                context = 2 * context + rows[y + 2 + dy][x + 2 + dx]
            if known is not None:
                for dy, dx in AROUND:
                    context = 2 * context + known[y + 1 + dy][x + 1 + dx]
            rows[y + 2][x + 2] = step(context, y, x)
    return np.array(rows, np.uint8).reshape(height + 2, width + 4)[2:, 2 : width + 2]


def encode_bilevel(pixels: np.ndarray, other: np.ndarray | None = None) -> bytes:
    """A bilevel image, given an image of the same size that the reader has too (a lossy copy, whose residue this then is)."""
    coder, rows = Encoder(), pixels.tolist()

    def step(context: int, y: int, x: int) -> int:
        coder.put(context, rows[y][x])
        return rows[y][x]

    _bilevel(*pixels.shape, other, step)
    return struct.pack("<II", *pixels.shape) + coder.done()


def decode_bilevel(raw: bytes, other: np.ndarray | None = None) -> np.ndarray:
    coder = Decoder(raw[8:])
    return _bilevel(*struct.unpack("<II", raw[:8]), other, lambda context, y, x: coder.get(context))


class _Bits:
    """Bits to write, or to read where given."""

    def __init__(self, raw: bytes | None = None) -> None:
        self.out: list[int] = []
        self.bits = None if raw is None else iter(np.unpackbits(np.frombuffer(raw, np.uint8)).tolist())

    def number(self, size: int, value: int | None) -> int:
        if self.bits is None:
            self.out += [value >> k & 1 for k in range(size - 1, -1, -1)]
            return value
        out = 0
        for _ in range(size):
            out = 2 * out + next(self.bits, 0)
        return out

    def unary(self, value: int | None) -> int:
        if self.bits is None:
            self.out += [1] * value + [0]
            return value
        n = 0
        while next(self.bits, 0):
            n += 1
        return n

    def adjusted(self, most: int, value: int | None) -> int:
        """A value in 0..most; the middle ones take a bit less where they don't all take the same."""
        size = most.bit_length()
        short = (1 << size) - (most + 1)  # values with a code of one bit less
        turn = (most + 1 - short) // 2
        if self.bits is None:
            v = (value - turn) % (most + 1)
            if v < short:
                self.number(size - 1, v)
            else:
                self.number(size, v + short)
            return value
        v = self.number(size - 1, None) if size else 0
        if size and v >= short:
            v = 2 * v + self.number(1, None) - short
        return (v + turn) % (most + 1)

    def rice(self, k: int, value: int | None) -> int:
        high = self.unary(None if value is None else value >> k)
        return high << k | self.number(k, None if value is None else value & (1 << k) - 1)


def _grey(height: int, width: int, bits: _Bits, given: list[list[int]] | None) -> np.ndarray:
    rows = [[0] * width for _ in range(height)]
    costs: dict[int, list[int]] = {}
    for y in range(height):
        for x in range(width):
            value = None if given is None else given[y][x]
            near = [rows[y][x - 1]] * (x > 0) + [rows[y - 1][x]] * (y > 0) + ([rows[y][x - 2]] if y == 0 and x > 1 else []) + ([rows[y - 1][min(x + 1, width - 1)]] if x == 0 and y else [])
            if len(near) < 2:
                rows[y][x] = bits.number(8, value)
                continue
            low, high = min(near[:2]), max(near[:2])
            inside = bits.number(1, None if value is None else int(low <= value <= high))
            if inside:
                rows[y][x] = low + bits.adjusted(high - low, None if value is None else value - low)
                continue
            above = bits.number(1, None if value is None else int(value > high))
            own = costs.setdefault(high - low, [0] * len(RICE))
            k = min(RICE, key=own.__getitem__)
            rest = bits.rice(k, None if value is None else (value - high - 1 if above else low - value - 1))
            for j in RICE:
                own[j] += (rest >> j) + 1 + j
            if max(own) > MOST_COUNT:
                own[:] = [c // 2 for c in own]
            rows[y][x] = high + 1 + rest if above else low - 1 - rest
    return np.array(rows, np.uint8).reshape(height, width)


def encode_grey(pixels: np.ndarray) -> bytes:
    """A grey image: each pixel within the range of two neighbours, or how far beyond."""
    bits = _Bits()
    _grey(*pixels.shape, bits, pixels.tolist())
    return struct.pack("<II", *pixels.shape) + np.packbits(np.array(bits.out, np.uint8)).tobytes()


def decode_grey(raw: bytes) -> np.ndarray:
    return _grey(*struct.unpack("<II", raw[:8]), _Bits(raw[8:]), None)


def _adjusted_tables() -> list[np.ndarray]:
    """What ``_Bits.adjusted`` does, by 256 * most and the value or the next eight bits: bits, how many; value, how many bits with the flag before them."""
    most, v = np.divmod(np.arange(1 << 16), 256)
    size = np.array([int(m).bit_length() for m in range(256)])[most]
    short = (1 << size) - (most + 1)
    turn = (most + 1 - short) // 2
    turned = (v - turn) % (most + 1)
    less = (v >> np.minimum(9 - size, 8)) * (size > 0)
    long = (size > 0) & (less >= short)
    value = (np.where(long, (v >> 8 - size) - short, less) + turn) % (most + 1)
    return [turned + short * (turned >= short), size - 1 + (turned >= short), value, np.maximum(size, 1) + long]


_TAIL, _BITS, _VALUE, _STEP = _adjusted_tables()
_J = np.arange(len(RICE), dtype=np.int16)
#: Of eight flags, as bits, the first that is set.
_FIRST = np.array([0, *(8 - n.bit_length() for n in range(1, 256))])
_ONES = np.array([next((k for k in range(16) if not n >> 15 - k & 1), 16) for n in range(1 << 16)], np.int64)


class _Costs:
    """What each Rice parameter would have cost so far in each image's contexts; the eight 16-bit numbers of a context move as one of 128 bits."""

    def __init__(self, images: int) -> None:
        self.own = np.zeros(images * 256, np.complex128)

    def best(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = self.own.take(at, mode="clip").view(np.int16).reshape(-1, 8)
        least = np.minimum(own[:, :4], own[:, 4:])
        least = np.minimum(least[:, :2], least[:, 2:])
        return own, _FIRST.take(np.packbits(own == np.minimum(least[:, :1], least[:, 1:])))

    def add(self, at: np.ndarray, own: np.ndarray, rest: np.ndarray) -> None:
        own += (rest.astype(np.int16)[:, None] >> _J) + (1 + _J)
        if own.size and own.max() > MOST_COUNT:
            own[own.max(1) > MOST_COUNT] //= 2
        self.own[at] = own.view(np.complex128)[:, 0]


def _neighbours(row: np.ndarray, above: np.ndarray | None, x: int) -> tuple[np.ndarray, np.ndarray] | None:
    """The two pixels that tell of pixel x, of all images; ``row`` and ``above`` by column, then image."""
    if above is None:
        return (row[x - 1], row[x - 2]) if x > 1 else None
    return (row[x - 1], above[x]) if x else (above[0], above[min(1, len(above) - 1)])


def _encoded_side_by_side(images: list[np.ndarray]) -> list[bytes]:
    """What ``encode_grey`` makes of each; images of one width, the highest first."""
    width, count, height = images[0].shape[1], len(images), len(images[0])
    heights = np.array([len(i) for i in images])
    pixels = np.zeros((height, width, count), np.uint8)
    for k, image in enumerate(images):
        pixels[: len(image), :, k] = image
    # a pixel's code: inside or outside and on which side (none or two of ``head``), ones, and the last bits of ``tail``
    head, ones, tail, bits = (np.zeros((height, width, count), np.uint8) for _ in range(4))
    costs, base, above = _Costs(count), np.arange(count) * 256, None
    for y in range(height):
        n = int((heights > y).sum())
        row = pixels[y, :, :n].astype(np.int64)
        if above is None:  # the first pixels have no two neighbours; they count as outside, and what is said of them is said anew below
            near = np.concatenate((row[:1], row[:-1])), np.concatenate((row[:2], row[:-2]))[:width]
        else:
            near = np.concatenate((above[:1], row[:-1])), np.concatenate((above[min(1, width - 1)][None], above[1:]))
        low, high = np.minimum(*near), np.maximum(*near)
        most = high - low
        inside = (most << 8) + np.minimum(np.maximum(row - low, 0), 255)
        outer = (row < low) | (row > high)
        over = row > high
        head[y, :, :n], tail[y, :, :n], bits[y, :, :n] = np.where(outer, 2 + over, 1), _TAIL.take(inside), _BITS.take(inside)
        rest = np.where(over, row - high, low - row) - 1
        most += base[:n]
        for x in range(0 if above is not None else 2, width):
            out = np.flatnonzero(outer[x])
            if len(out):
                at, left = most[x].take(out), rest[x].take(out)
                own, k = costs.best(at)
                costs.add(at, own, left)
                ones[y, x, out], tail[y, x, out], bits[y, x, out] = left >> k, left & (1 << k) - 1, k + 1
        if above is None:
            head[y, :2, :n], tail[y, :2, :n], bits[y, :2, :n] = 0, row[:2], 8
        above = row[:, : int((heights > y + 1).sum())]
    few = max(1, (1 << 18) // (height * width))  # images whose bits are put together at once, by wider numbers
    packed = (raw for k in range(0, count, few) for raw in _packed(*(a[:, :, k : k + few].transpose(2, 0, 1).reshape(-1) for a in (head, ones, tail, bits)), min(few, count - k)))
    return [struct.pack("<II", *image.shape) + raw for image, raw in zip(images, packed, strict=True)]


def _packed(head: np.ndarray, ones: np.ndarray, tail: np.ndarray, bits: np.ndarray, count: int) -> list[bytes]:
    """The bytes of each of so many images from the codes of its pixels."""
    first = (head > 0) + (head > 1).astype(np.int64)  # bits of the head
    end = np.cumsum(first + ones + bits).reshape(count, -1)
    size = np.diff(end[:, -1], prepend=0)
    into = np.concatenate(([0], np.cumsum(-(-size // 8))))  # each image's first byte
    end = (end + (8 * into[:-1] - (end[:, -1] - size))[:, None]).reshape(-1)
    start = end - bits - ones - first
    flat = np.zeros(8 * int(into[-1]), np.uint8)
    flat[start[head == 1]] = 1
    flat[start[head == 3] + 1] = 1
    runs = np.flatnonzero(ones)
    long = ones[runs].astype(np.int64)
    flat[np.repeat(start[runs] + 2 - (np.cumsum(long) - long), long) + np.arange(int(long.sum()))] = 1
    for j in range(8):
        flat[end[tail >> j & 1 == 1] - 1 - j] = 1
    raw = np.packbits(flat).tobytes()
    return [raw[a:b] for a, b in zip(into[:-1].tolist(), into[1:].tolist(), strict=True)]


def _decoded_side_by_side(coded: list[bytes]) -> list[np.ndarray]:
    """What ``decode_grey`` makes of each; images of one width, the highest first."""
    sizes = [struct.unpack("<II", raw[:8]) for raw in coded]
    heights, width, count = np.array([h for h, _ in sizes]), sizes[0][1], len(coded)
    data = np.frombuffer(b"".join(raw[8:] for raw in coded) + bytes(16), np.uint8)
    words = np.zeros(len(data) - 7, np.uint64)  # the 64 bits from each byte on
    for k in range(8):
        words = words << np.uint64(8) | data[k : len(data) - 7 + k]
    place = 8 * np.concatenate(([0], np.cumsum([len(raw) - 8 for raw in coded])[:-1]))
    words = words.view(np.int64)  # negative where the first bit is set
    window = lambda at: words.take(at >> 3, mode="clip") << (at & 7)
    pixels = np.zeros((height := int(heights[0]), width, count), np.uint8)
    costs, base, above = _Costs(count), np.arange(count) * 256, None
    for y in range(height):
        n = int((heights > y).sum())
        place, row = place[:n], np.zeros((width, n), np.int64)
        for x in range(width):
            near, w = _neighbours(row, above, x), window(place)
            if near is None:
                row[x] = w >> 56 & 255
                place += 8
                continue
            low, high = np.minimum(*near), np.maximum(*near)
            most = high - low
            inside = (most << 8) + (w >> 55 & 255)
            value, step = low + _VALUE.take(inside, mode="clip"), _STEP.take(inside, mode="clip")
            out = np.flatnonzero(w >= 0)
            if len(out):
                at, w, here = base.take(out) + most.take(out), w.take(out), place.take(out)
                own, k = costs.best(at)
                over, ones = w >= 1 << 62, _ONES.take(w >> 46 & 0xFFFF)
                more = np.flatnonzero(ones == 16)
                while len(more):  # a longer run
                    run = _ONES[window(here[more] + 2 + ones[more]) >> 48 & 0xFFFF]
                    ones[more] += run
                    more = more[run == 16]
                    if ones.max() > 255:
                        raise ValueError("a coded image is damaged")
                there = here + 2 + ones
                rest = ones << k | (window(there + 1) >> 1 & (1 << 63) - 1) >> 63 - k
                costs.add(at, own, rest)
                value[out] = np.where(over, high.take(out) + 1 + rest, low.take(out) - 1 - rest)
                step[out] = there + 1 + k - here
            row[x] = value
            place += step
        pixels[y, :, :n] = row
        n = int((heights > y + 1).sum())
        above = row[:, :n]
    back = pixels.transpose(2, 0, 1)
    return [back[k, :h].copy() for k, (h, _) in enumerate(sizes)]


def _side_by_side(sizes: list[tuple[int, int]]) -> Iterator[list[int]]:
    """Images of these heights and widths, dealt by width and height into lots that are coded together; one to be coded alone is a lot."""
    by_width: dict[int, list[int]] = {}
    for k, (_, width) in enumerate(sizes):
        by_width.setdefault(width, []).append(k)
    for width, own in by_width.items():
        own.sort(key=lambda k: -sizes[k][0])
        while own:
            area = sizes[own[0]][0] * width  # the largest of those left
            n = SIDE_BY_SIDE // area if area else 0
            n = n if min(n, len(own)) >= FEW else 1
            yield own[:n]
            del own[:n]


def encode_greys(images: list[np.ndarray]) -> list[bytes]:
    """``encode_grey`` of each image."""
    out: list[bytes] = [b""] * len(images)
    for lot in _side_by_side([i.shape for i in images]):
        own = [images[k] for k in lot]
        for k, raw in zip(lot, _encoded_side_by_side(own) if len(lot) > 1 else [encode_grey(own[0])], strict=True):
            out[k] = raw
    return out


def decode_greys(coded: list[bytes]) -> list[np.ndarray]:
    """``decode_grey`` of each coded image."""
    out: list[np.ndarray] = [np.zeros((0, 0), np.uint8)] * len(coded)
    for lot in _side_by_side([struct.unpack("<II", raw[:8]) for raw in coded]):
        own = [coded[k] for k in lot]
        for k, pixels in zip(lot, _decoded_side_by_side(own) if len(lot) > 1 else [decode_grey(own[0])], strict=True):
            out[k] = pixels
    return out


def _each(rows: list[dict], column: str, bilevel: Callable, greys: Callable) -> list:
    """That column of the rows, bilevel ones given to ``bilevel``, the others at once to ``greys``."""
    grey = iter(greys([r[column] for r in rows if r["most"] != 1]))
    return [bilevel(r[column]) if r["most"] == 1 else next(grey) for r in rows]


def encoded(images: DataFrame) -> DataFrame:
    """file, most, raw: images(file, width, height, most, pixels) coded, bilevel ones where ``most`` is 1."""
    ship(images.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r | {"pixels": np.frombuffer(r["pixels"], np.uint8).reshape(r["height"], r["width"])} for r in batch.to_pylist()]
            raw = pa.array(_each(rows, "pixels", encode_bilevel, encode_greys), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("most"), raw], ["file", "most", "raw"])

    return images.where("pixels is not null").select("file", "width", "height", "most", "pixels").mapInArrow(run, "file string, most int, raw binary")


def decoded(coded: DataFrame) -> DataFrame:
    """file, most, width, height, pixels of what ``encoded`` made."""
    ship(coded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pixels = _each(batch.to_pylist(), "raw", decode_bilevel, decode_greys)
            sizes = [pa.array([p.shape[k] for p in pixels], pa.int32()) for k in (1, 0)]
            raw = pa.array([p.tobytes() for p in pixels], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("most"), *sizes, raw], ["file", "most", "width", "height", "pixels"])

    return coded.select("file", "most", "raw").mapInArrow(run, "file string, most int, width int, height int, pixels binary")


def strips(images: DataFrame, rows: int = 64) -> DataFrame:
    """The images in strips of so many rows, each an image of its own: file#0, file#1, ..."""
    count = F.ceil(F.col("height") / rows).cast("int")

    def strip(k: Column) -> Column:  # cut before rows are made, so that no strip's row carries the whole image
        high = F.least(F.lit(rows), F.col("height") - k * rows)
        pixels = F.substr("pixels", k * rows * F.col("width") + 1, high * F.col("width"))
        return F.struct(F.concat("file", F.lit("#"), k).alias("file"), "width", high.alias("height"), "most", pixels.alias("pixels"))

    each = F.explode(F.transform(F.sequence(F.lit(0), count - 1), strip))
    return images.where("pixels is not null").select(each.alias("strip")).select("strip.*")
