"""Bilevel and grey images: portable bitmaps and graymaps, read and written."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quire.session import ship

PIXELS = "file string, kind string, width int, height int, most int, pixels binary, error string"
_TOKEN = re.compile(rb"(?:\s|#[^\n]*\n)*([^\s#]+)")


def decoded(raw: bytes) -> tuple[str, int, int, int, np.ndarray]:
    """(kind, width, height, largest value, pixels) of a P1, P2, P4 or P5 file; a set bit is 1."""
    at, head = 0, []
    for k in range(4):
        m = _TOKEN.match(raw, at)
        if not m:
            raise ValueError("no image header")
        head.append(m[1])
        at = m.end()
        if k == 2 and head[0] in (b"P1", b"P4"):
            break
    kind = head[0].decode()
    if kind not in ("P1", "P2", "P4", "P5"):
        raise ValueError(f"{kind} is no bitmap or graymap")
    width, height, most = int(head[1]), int(head[2]), int(head[3]) if len(head) > 3 else 1
    if width < 1 or height < 1:
        raise ValueError("the image has no pixels")
    if kind == "P1":
        bits = re.sub(rb"#[^\n]*\n|\s", b"", raw[at:])[: width * height]
        pixels = np.frombuffer(bits, np.uint8) - 48
    elif kind == "P2":
        pixels = np.array(re.sub(rb"#[^\n]*\n", b" ", raw[at:]).split()[: width * height], np.uint8)
    elif kind == "P4":
        row = -(-width // 8)
        packed = np.frombuffer(raw, np.uint8, row * height, at + 1).reshape(height, row)
        pixels = np.unpackbits(packed, axis=1)[:, :width].ravel()
    else:
        pixels = np.frombuffer(raw, np.uint8, width * height, at + 1)
    if len(pixels) != width * height:
        raise ValueError("the image is cut off")
    return kind, width, height, most, pixels.reshape(height, width)


def encoded(pixels: np.ndarray, most: int = 1) -> bytes:
    """A P4 file of a bilevel image, a P5 file of a grey one."""
    height, width = pixels.shape
    if most == 1:
        return b"P4\n%d %d\n" % (width, height) + np.packbits(pixels.astype(bool), axis=1).tobytes()
    return b"P5\n%d %d\n%d\n" % (width, height, most) + pixels.astype(np.uint8).tobytes()


#: Files that are images, or descriptions of such.
NAMES = r"\.p[tgb]m$"


def parsed(files: DataFrame) -> DataFrame:
    """file, kind, width, height, most, pixels (a byte each), error: the images of files(path, content); a damaged one has only its error."""
    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, raw in zip(batch.column("path"), batch.column("content"), strict=True):
                try:
                    kind, width, height, most, pixels = decoded(raw.as_py() or b"")
                    values = [kind, width, height, most, pixels.tobytes(), None]
                except ValueError as e:
                    values = [None, None, None, None, None, str(e)]
                names = [f.split()[0] for f in PIXELS.split(", ")]
                kinds = {"string": pa.string(), "int": pa.int32(), "binary": pa.binary()}
                yield pa.RecordBatch.from_arrays([pa.array([v], kinds[f.split()[1]]) for v, f in zip([file.as_py(), *values], PIXELS.split(", "), strict=True)], names)

    return files.select("path", "content").mapInArrow(run, PIXELS)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The images below a folder, as ``parsed`` has them."""
    return parsed(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.p[bg]m").load(path))
