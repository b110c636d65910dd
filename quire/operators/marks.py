"""Marks of scanned text: connected components with features, reading order, matching against a library."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.session import ship

#: Marks whose centroids lie further apart (in both directions together) don't match. Fixed value.
NEAR = 3
#: Averages of marks that would be wider or higher aren't made; the histogram's areas. Fixed values.
MOST_AVERAGED = 100
AREAS = (1, 2, 4, 9, 16, 25, 36, 49, 64, 81, 100)

MARKS = "file string, mark int, xpos int, ypos int, width int, height int, area int, xcen int, ycen int, h_runs int, v_runs int, bitmap binary"


def components(pixels: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(left, top, bitmap) of the set pixels that touch, also at corners, in order of their first pixel.

    Runs of set pixels in rows are what is joined, not single pixels: runs of neighbouring rows that overlap, or touch at a corner, are one.
    """
    height, width = pixels.shape
    edge = np.diff(np.pad(pixels.astype(bool).astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, begin = np.nonzero(edge == 1)
    end = np.nonzero(edge == -1)[1]
    parent = np.arange(len(row))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = k = parent[parent[k]]
        return k

    first = np.searchsorted(row, np.arange(height + 1))
    for y in range(1, height):
        above, k = first[y - 1], first[y]
        while above < first[y] and k < first[y + 1]:
            if end[above] >= begin[k] and end[k] >= begin[above]:
                a, b = root(above), root(k)
                parent[max(a, b)] = min(a, b)
            if end[above] < end[k]:
                above += 1
            else:
                k += 1
    label = np.array([root(k) for k in range(len(row))], np.int64)
    order = np.argsort(label, kind="stable")
    cuts = np.flatnonzero(np.diff(label[order], prepend=-1))
    for own in np.split(order, cuts[1:]) if len(order) else ():
        top, left = row[own].min(), begin[own].min()
        bitmap = np.zeros((row[own].max() - top + 1, end[own].max() - left), np.uint8)
        for k in own:
            bitmap[row[k] - top, begin[k] - left : end[k] - left] = 1
        yield int(left), int(top), bitmap


def features(bitmap: np.ndarray) -> tuple[int, int, int, int, int]:
    """Area, centroid, and runs along rows and columns."""
    ys, xs = np.nonzero(bitmap)
    runs = lambda a: int((np.diff(np.pad(a.astype(np.int8), ((0, 0), (1, 0))), axis=1) == 1).sum())
    return len(xs), int(xs.sum() // len(xs)), int(ys.sum() // len(ys)), runs(bitmap), runs(bitmap.T)


def extracted(images: DataFrame) -> DataFrame:
    """The marks of bilevel images(file, width, height, pixels)."""
    names = [x.split()[0] for x in MARKS.split(", ")]
    kinds = [{"string": pa.string(), "int": pa.int32(), "binary": pa.binary()}[x.split()[1]] for x in MARKS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, width, height, raw in zip(*(batch.column(c).to_pylist() for c in ("file", "width", "height", "pixels")), strict=True):
                rows = []
                for k, (x, y, b) in enumerate(components(np.frombuffer(raw, np.uint8).reshape(height, width))):
                    area, xcen, ycen, h_runs, v_runs = features(b)
                    rows.append((file, k, x, y, b.shape[1], b.shape[0], area, xcen, ycen, h_runs, v_runs, b.tobytes()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    ship(images.sparkSession)
    return images.where("pixels is not null").select("file", "width", "height", "pixels").mapInArrow(run, MARKS)


def in_reading_order(marks: DataFrame, gap: int = 20) -> DataFrame:
    """marks with ``position``: lines part where tops lie over ``gap`` apart; within a line from left to right. A window per image."""
    down = Window.partitionBy("file").orderBy("ypos", "xpos", "mark")
    new = F.coalesce((F.col("ypos") - F.lag("ypos").over(down) > gap).cast("int"), F.lit(0))
    lined = marks.withColumn("_new", new).withColumn("_line", F.sum("_new").over(down))
    across = Window.partitionBy("file").orderBy("_line", "xpos", "ypos", "mark")
    return lined.withColumn("position", F.row_number().over(across)).drop("_new", "_line")


def difference(a: np.ndarray, b: np.ndarray, a_cen: tuple[int, int], b_cen: tuple[int, int]) -> int:
    """Differing pixels with the centroids laid over each other, each counted with its differing neighbours."""
    left, top = max(a_cen[0], b_cen[0]), max(a_cen[1], b_cen[1])
    width = left + max(a.shape[1] - a_cen[0], b.shape[1] - b_cen[0])
    height = top + max(a.shape[0] - a_cen[1], b.shape[0] - b_cen[1])
    both = np.zeros((2, height + 2, width + 2), np.int64)
    for own, (bitmap, cen) in zip(both, ((a, a_cen), (b, b_cen)), strict=True):
        y, x = top - cen[1] + 1, left - cen[0] + 1
        own[y : y + bitmap.shape[0], x : x + bitmap.shape[1]] = bitmap
    off = both[0] ^ both[1]
    near = sum(off[1 + dy : height + 1 + dy, 1 + dx : width + 1 + dx] for dy in (-1, 0, 1) for dx in (-1, 0, 1))
    return int((off[1:-1, 1:-1] * near).sum())


def quadrants(bitmap: np.ndarray) -> list[tuple[int, int]]:
    """The centroids of the four parts that the centroid cuts a bitmap into (upper and lower left, upper and lower right); a part without pixels has its own middle."""
    _, xcen, ycen, _, _ = features(bitmap)
    out = []
    for xs in ((0, xcen + 1), (xcen + 1, bitmap.shape[1])):
        for ys in ((0, ycen + 1), (ycen + 1, bitmap.shape[0])):
            y, x = np.nonzero(bitmap[slice(*ys), slice(*xs)])
            out.append((int(x.sum() // len(x)) + xs[0], int(y.sum() // len(y)) + ys[0]) if len(x) else (sum(xs) // 2, sum(ys) // 2))
    return out


def average(bitmaps: list[np.ndarray], centroids: list[tuple[int, int]]) -> np.ndarray:
    """The bitmaps laid over each other at their centroids; a pixel is set that over half of them have, and over one."""
    right, low = max(c[0] for c in centroids), max(c[1] for c in centroids)
    width = right + max(b.shape[1] - c[0] for b, c in zip(bitmaps, centroids, strict=True))
    height = low + max(b.shape[0] - c[1] for b, c in zip(bitmaps, centroids, strict=True))
    if len(bitmaps) < 2 or width >= MOST_AVERAGED or height >= MOST_AVERAGED:
        return bitmaps[0]
    votes = np.zeros((height, width), np.int64)
    for b, (x, y) in zip(bitmaps, centroids, strict=True):
        votes[low - y : low - y + b.shape[0], right - x : right - x + b.shape[1]] += b
    out = (votes > max(1, len(bitmaps) // 2)).astype(np.uint8)
    ys, xs = np.nonzero(out)
    return out[ys.min() : ys.max() + 1, xs.min() : xs.max() + 1] if len(ys) else bitmaps[0]


def area_histogram(marks: DataFrame) -> DataFrame:
    """upto, n: how many marks have an area of up to 1, 2, 4, 9, ... 100."""
    each = marks.select("area", F.explode(F.array(*map(F.lit, AREAS))).alias("upto"))
    return each.groupBy("upto").agg(F.count_if(F.col("area") <= F.col("upto")).alias("n"))


def library_statistics(marks: DataFrame) -> DataFrame:
    """One row: n, and the means of area, runs, centroid and size, cut to whole numbers."""
    names = ("area", "h_runs", "v_runs", "xcen", "ycen", "width", "height")
    return marks.agg(F.count("*").alias("n"), *(F.floor(F.avg(c)).alias(c) for c in names))


def pruned(library: DataFrame, least: int = 2) -> DataFrame:
    """The library's symbols that occur at least so often; rarer ones cost more in a library than in place."""
    return library.where(F.col("n") >= least)


def overlap_difference(a: np.ndarray, b: np.ndarray, a_cen: tuple[int, int], b_cen: tuple[int, int]) -> int:
    """As ``difference``, but each differing pixel counts once, with no weight for its neighbours."""
    left, top = max(a_cen[0], b_cen[0]), max(a_cen[1], b_cen[1])
    width = left + max(a.shape[1] - a_cen[0], b.shape[1] - b_cen[0])
    height = top + max(a.shape[0] - a_cen[1], b.shape[0] - b_cen[1])
    both = np.zeros((2, height, width), np.int64)
    for own, (bitmap, cen) in zip(both, ((a, a_cen), (b, b_cen)), strict=True):
        own[top - cen[1] : top - cen[1] + bitmap.shape[0], left - cen[0] : left - cen[0] + bitmap.shape[1]] = bitmap
    return int((both[0] ^ both[1]).sum())


def matched(marks: DataFrame, library: DataFrame, most: int = 1000) -> DataFrame:
    """file, mark, symbol, score: each mark's nearest library mark(symbol, width, height, xcen, ycen, bitmap), up to a score of ``most``.

    Centroids that are near each other meet by an equi-join on the cells around them, not by comparing all pairs.
    """
    cells = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x in range(-NEAR, NEAR + 1) for y in range(-NEAR + abs(x), NEAR - abs(x) + 1)))
    there = library.select("symbol", *(F.col(c).alias(f"l_{c}") for c in ("width", "height", "xcen", "ycen", "bitmap")), F.explode(cells).alias("cell"))
    there = there.withColumn("xcen", F.col("l_xcen") + F.col("cell.x")).withColumn("ycen", F.col("l_ycen") + F.col("cell.y")).drop("cell")
    ship(marks.sparkSession)
    pairs = marks.select("file", "mark", "width", "height", "xcen", "ycen", "bitmap").join(there, ["xcen", "ycen"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            shaped = lambda r, p: np.frombuffer(r[f"{p}bitmap"], np.uint8).reshape(r[f"{p}height"], r[f"{p}width"]).astype(np.int64)
            score = [difference(shaped(r, ""), shaped(r, "l_"), (r["xcen"], r["ycen"]), (r["l_xcen"], r["l_ycen"])) for r in rows]
            yield pa.RecordBatch.from_pydict({"file": pa.array([r["file"] for r in rows], pa.string()), "mark": pa.array([r["mark"] for r in rows], pa.int32()), "symbol": pa.array([r["symbol"] for r in rows], pa.int64()), "score": pa.array(score, pa.int64())})

    found = pairs.mapInArrow(run, "file string, mark int, symbol long, score long").where(F.col("score") <= most)
    return found.groupBy("file", "mark").agg(F.min(F.struct("score", "symbol")).alias("best")).select("file", "mark", "best.symbol", "best.score")


def library(marks: DataFrame) -> DataFrame:
    """symbol, n and one bitmap's columns for each different bitmap."""
    same = marks.groupBy("width", "height", "bitmap").agg(F.count("*").alias("n"), F.min("area").alias("area"), F.min("xcen").alias("xcen"), F.min("ycen").alias("ycen"))
    return same.withColumn("symbol", F.xxhash64("width", "height", "bitmap"))
