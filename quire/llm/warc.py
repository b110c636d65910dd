"""WARC archives: written with an index, read back by coalesced byte ranges.

``write`` stores each record as a gzip member of its own, so a record can be read alone, and returns the index: file,
offset, length, URL and digest per record. Each task writes archives under names that no other attempt uses and tells
of them only through the index, so what a lost or repeated attempt left behind is never read. The index is a table in
the shared folder. ``read`` sorts the selected index rows by file and offset, joins neighbouring ranges and reads each
joined range once.

Archives and index lie in the folder in ``spark.checkpoint.dir``, reached by pyarrow's file systems (local, HDFS, S3, GCS).

Defined results: a null payload is an empty one; a null url gives a record without WARC-Target-URI; a null page_id is
written as such, never refers and is never referred to; rows that repeat a page_id and its payload are each a record
of the same type; rows that repeat a page_id with different payloads are records under one id, and a revisit that refers to
it names the one with its own payload digest; an empty table gives no records. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import arrowtools
from quire.session import scratch, shared_dir, ship, written

#: Payloads below this are never replaced by a revisit.
LEAST_REVISIT_BYTES = 1000
#: An archive is closed when it has grown beyond this.
ARCHIVE_BYTES = 256 << 20
#: Ranges in one file closer than GAP are read together, up to READ at a time.
GAP, READ = 64 << 10, 8 << 20
#: Bytes of payloads that are Python values at once; a longer payload is alone.
CHUNK = 4 << 20

INDEX = "file string, offset long, length long, url string, digest string, page_id long, record_type string, refers_to long, payload_bytes long"
RECORDS = "page_id long, url string, record_type string, refers_to long, digest string, payload binary"

_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def file_system(path: str):
    """pyarrow's file system for a URI or a local path, and the path within it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def plan(pages: DataFrame, least: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload, refers_to: which page's response stands for this one's payload (null: its own).

    The largest page_id is found by a partial aggregate on the payload's digest; only groups with a second page come
    back, in a join whose hot keys Spark splits. Payloads below ``least`` bytes aren't in that join, so no key stands for all of them.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    large = F.octet_length("payload") >= least
    alone = rows.where(~large).withColumn("refers_to", F.lit(None).cast("long"))
    rows = rows.where(large).withColumn("same", F.unhex(F.sha2("payload", 256)))
    keepers = rows.groupBy("same").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1").drop("n")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper")).cast("long")
    return rows.join(keepers, "same", "left").select("page_id", "url", "payload", refers.alias("refers_to")).unionByName(alone)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> tuple[bytes, str, str]:
    """(the record, its type, the payload's SHA-1 in hex)."""
    sha = hashlib.sha1(payload).digest()
    kind = "response" if refers_to is None else "revisit"
    block = _HTTP % len(payload) + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    head += [f"WARC-Payload-Digest: sha1:{base64.b32encode(sha).decode()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", kind, sha.hex()


def _gzip(raw: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def write(planned: DataFrame, *, date: str = "1970-01-01T00:00:00Z", level: int = 4) -> DataFrame:
    """Writes the archives; returns the index, itself written."""
    spark = planned.sparkSession
    ship(spark)
    folder = scratch(spark, "warc")
    columns = [x.split()[0] for x in INDEX.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(folder)
        system.create_dir(root, recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in (part for whole in batches for part in arrowtools.slices(whole, "payload", CHUNK)):
                rows: list[tuple] = []
                for page_id, url, payload, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to")), strict=True):
                    if out is None:
                        name = f"{uuid.uuid4().hex}.warc.gz"
                        out = system.open_output_stream(f"{root}/{name}", compression=None)
                        info = b"software: quire\r\nformat: WARC File Format 1.1\r\n"
                        head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n"
                        at = out.write(_gzip(head.encode() + info + b"\r\n\r\n", level))
                    body = payload.encode()
                    raw, kind, digest = record(page_id, url, body, refers, date)
                    packed = _gzip(raw, level)
                    out.write(packed)
                    rows.append((f"{folder}/{name}", at, len(packed), url, digest, page_id, kind, refers, len(body)))
                    at += len(packed)
                    if at >= ARCHIVE_BYTES:
                        out.close()
                        out = None
                if rows:
                    yield pa.RecordBatch.from_pydict(dict(zip(columns, map(list, zip(*rows, strict=True)), strict=True)), schema=_arrow(INDEX))
        finally:
            if out is not None:
                out.close()

    return written(planned.mapInArrow(run, INDEX), "warc-index")


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))])


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(headers in lower case, the HTTP payload) of one record; the payload is checked against its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}
    block = rest[: int(headers["content-length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    if headers["warc-type"] == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != headers["warc-payload-digest"].removeprefix("sha1:"):
        raise ValueError(f"payload of {headers['warc-record-id']} doesn't match its digest")
    return headers, payload


def _page(uri: str | None) -> int | None:
    digits = (uri or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def coalesced(ranges: list[tuple[str, int, int]]) -> list[list[tuple[str, int, int]]]:
    """Sorted (file, offset, length) in runs to be read at once."""
    runs: list[list[tuple[str, int, int]]] = []
    for x in ranges:
        if runs and (last := runs[-1][-1])[0] == x[0] and 0 <= x[1] - last[1] - last[2] <= GAP and x[1] + x[2] - runs[-1][0][1] <= READ:
            runs[-1].append(x)
        else:
            runs.append([x])
    return runs


def read(index: DataFrame) -> DataFrame:
    """The records that the index rows select, read in the order in which they lie."""
    selected = index.select("file", "offset", "length")
    n = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = [x.split()[0] for x in RECORDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict = {}
        for batch in batches:
            for group in coalesced(list(zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True))):
                name, start = group[0][:2]
                if name not in opened:
                    for f in opened.values():
                        f.close()
                    system, path = file_system(name)
                    opened = {name: system.open_input_file(path)}
                opened[name].seek(start)
                raw = opened[name].read(group[-1][1] + group[-1][2] - start)
                rows = []
                for _, at, length in group:
                    headers, payload = parse(zlib.decompress(raw[at - start : at - start + length], 31))
                    sha = base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:")).hex()
                    refers = _page(headers.get("warc-refers-to"))
                    rows.append((_page(headers["warc-record-id"]), headers.get("warc-target-uri"), headers["warc-type"], refers, sha, payload if refers is None else None))
                yield pa.RecordBatch.from_pydict(dict(zip(columns, map(list, zip(*rows, strict=True)), strict=True)), schema=_arrow(RECORDS))

    return selected.repartitionByRange(n, "file", "offset").sortWithinPartitions("file", "offset").mapInArrow(run, RECORDS)


def round_trip(pages: DataFrame) -> DataFrame:
    """Every page written as a record and read back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Sizes and digests of responses come from the payloads as read; a revisit's from the response it refers to.
    """
    shared_dir(pages.sparkSession)
    back = read(write(plan(pages))).select(
        "page_id",
        "record_type",
        "refers_to",
        F.coalesce(F.sha1("payload"), F.col("digest")).alias("payload_digest"),
        F.octet_length("payload").cast("long").alias("own_bytes"),
    )
    back = written(back, "warc-read")
    responses = back.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest", F.col("own_bytes").alias("there_bytes")).groupBy("refers_to", "payload_digest").agg(F.max("there_bytes").alias("there_bytes"))
    return back.join(responses, ["refers_to", "payload_digest"], "left").select(
        "page_id", F.coalesce("own_bytes", "there_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to"
    )
