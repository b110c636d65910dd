r"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

The rank file's path is a parameter; its bytes are read once on the driver and travel to the executors in a broadcast
(a rank file is a vocabulary, so its size is fixed: about 1 MB, refused above ``MOST_RANK_BYTES``).

Long texts are cut before a space that follows an ASCII letter or digit. No match of the usual pre-splitting patterns
goes from a non-space character over to a space, and none looks back, so a match begins at each such cut: the ids are those of the whole text.

The library's matcher keeps a step of each white-space character of a run in memory and breaks on about a million of them.
Patterns that take white space by ``\s+(?!\S)|\s+`` match all of a run but its last character, or all of it at the text's end, so
runs over ``RUN`` characters are cut out by that rule and encoded as the one match that they are.

Defined results: a null or empty text has no ids; texts may be as long as a Spark string can be; repeated rows are
encoded each on its own; extra columns pass through, and an output name that clashes with one replaces it.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm import arrowtools
from quire.session import ship

MOST_RANK_BYTES = 64 << 20
#: Characters after which a long text may be cut.
PIECE = 1 << 16
#: Bytes of texts or ids that are Python values at once; a longer value is alone.
CHUNK = 1 << 21

#: Runs of white space beyond this aren't left to the library's matcher.
RUN = 1 << 12

_CUT = re.compile(r"(?<=[A-Za-z0-9]) ")
#: What the pattern's \s stands for: Unicode's white space. Fixed value.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_RULE = r"\s+(?!\S)|\s+"
_LONG_RUN = re.compile(f"[{SPACE}]{{{RUN},}}")
_encodings: dict = {}


def read_ranks(path: str) -> bytes:
    """The rank file's bytes."""
    with open(path, "rb") as f:
        raw = f.read(MOST_RANK_BYTES + 1)
    if len(raw) > MOST_RANK_BYTES:
        raise ValueError(f"{path} has over {MOST_RANK_BYTES} bytes")
    return raw


def encoding(raw: bytes, pattern: str):
    """A tiktoken encoding, made once in each process."""
    import tiktoken

    key = (hash(raw), pattern)
    if key not in _encodings:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in raw.splitlines() if line)}
        _encodings[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[key]


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """The text, cut where no match can be cut."""
    start = 0
    while len(text) - start > size:
        cut = _CUT.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode_text(enc, text: str) -> np.ndarray:
    """The ids of a whole text."""
    if len(text) <= RUN:
        return np.array(enc.encode_ordinary(text), "<u4")
    found, start = [], 0
    # only patterns with that rule match runs so; others are left to the library
    for run in _LONG_RUN.finditer(text) if enc._pat_str.endswith(_RULE) else ():
        end = run.end() if run.end() == len(text) else run.end() - 1
        found += [enc.encode_ordinary(x) for x in pieces(text[start : run.start()])]
        found.append(enc._encode_single_piece(text[run.start() : end]))
        start = end
    found += [enc.encode_ordinary(x) for x in pieces(text[start:])]
    return np.concatenate([np.array(x, "<u4") for x in found])


def _append(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*(f for f in df.schema.fields if f.name != name), T.StructField(name, kind)])


def _encoder(ranks, pattern: str, text: str, ids: str, names: list[str]):
    """What ``encode`` runs on the executors; ``ranks`` is a broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks.value, pattern)
        for batch in (part for whole in batches for part in arrowtools.slices(whole, text, CHUNK)):
            made = pa.array([encode_text(enc, t).tobytes() if t else b"" for t in batch.column(text).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([made if n == ids else batch.column(n) for n in names], names)

    return run


def _decoder(ranks, pattern: str, ids: str, decoded: str, names: list[str]):
    """What ``decode`` runs on the executors; ``ranks`` is a broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks.value, pattern)
        for batch in (part for whole in batches for part in arrowtools.slices(whole, ids, CHUNK)):
            made = pa.array([enc.decode_bytes(np.frombuffer(x, "<u4").tolist()) if x else b"" for x in batch.column(ids).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([made if n == decoded else batch.column(n) for n in names], names)

    return run


def encode(df: DataFrame, ranks: bytes, pattern: str, *, text: str = "text", ids: str = "ids", keep_text: bool = True) -> DataFrame:
    """Adds ``ids``: each id as a little-endian unsigned 32-bit integer, one after the other, in one binary value.

    ``id_array`` turns that into an array column.
    """
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(ranks)
    schema = _append(df, ids, T.BinaryType())
    names = [n for n in schema.names if keep_text or n != text]
    return df.mapInArrow(_encoder(shared, pattern, text, ids, names), T.StructType([schema[n] for n in names]))


def decode(df: DataFrame, ranks: bytes, pattern: str, *, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds ``decoded``: the raw bytes that the ids stand for (which need not be whole UTF-8 characters); null ids give no bytes."""
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(ranks)
    schema = _append(df, decoded, T.BinaryType())
    return df.mapInArrow(_decoder(shared, pattern, ids, decoded, schema.names), schema)


def id_array(ids: str = "ids"):
    """The packed ids as array<bigint>, in plain SQL functions."""
    word = F.hex(F.col(ids))
    byte = lambda at: F.substring(word, at, 2)
    at = lambda i: F.conv(F.concat(*(byte(F.lit(8) * i + F.lit(k)) for k in (7, 5, 3, 1))), 16, 10).cast("long")
    n = (F.octet_length(F.col(ids)) / 4).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), at)).otherwise(F.array().cast("array<long>"))


def digests(documents: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document: encoded, then decoded from the ids alone.

    One Python worker does both for a task: with two nodes each task holds two, which stay for whatever runs next.
    """
    ship(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(ranks)
    thin = documents.select("doc_id", "text")
    schema = T.StructType([thin.schema["doc_id"], T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())])
    there, back = _encoder(shared, pattern, "text", "ids", schema.names[:2]), _decoder(shared, pattern, "ids", "decoded", schema.names)
    return thin.mapInArrow(lambda batches: back(there(batches)), schema).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
