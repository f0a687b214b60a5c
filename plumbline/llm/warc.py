"""WARC archives with revisit resolution.

Headers (id, digest, length) are shuffled by payload digest to find each payload's original, pre-aggregated, and the headers of
revisits are stored. Pages then meet the revisits' headers by id and digest, which no two different pages share, so copies of one
payload don't meet in one task; short payloads, always responses, meet nothing. The archives hold originals as ``response`` and
the others as ``revisit`` records without payload. Every record is its own gzip member, made in Arrow batches and written by
Spark's own text writer, ``FILE_BYTES`` or one record a file, so files are committed by task, go to any file system that Spark
knows, and read as plain concatenated gzip. Reading unpacks whole files in Arrow batches, follows Content-Length, and joins
revisits to the payload facts of their originals by record id.

Defined results: a null payload is empty; payloads under ``MIN_BYTES`` are always responses; rows that tie on the smallest id are
all responses; repeated rows share a record id; a null id is larger than any other; null or odd URLs are left out or escaped;
empty tables write an archive without records; a page's other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binary, stored

MIN_BYTES = 100
#: Bytes of members after which an archive file ends, which bounds what a reader holds (one record may be longer).
FILE_BYTES = 8 << 20
#: Parts that headers of one digest go to, and headers of revisits up to which they are broadcast (about 100 bytes each).
SALTS, BROADCAST_REVISITS = 32, 100_000
#: Bytes that a reader unpacks at a time.
STEP_BYTES = 8 << 10
#: A gzip member of nothing, which ends a file.
SEPARATOR = gzip.compress(b"", mtime=0).decode("latin-1")
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_HEADER = "X-Source-Row"


def resolve(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html", least: int = MIN_BYTES) -> DataFrame:
    """(page_id, url, payload, digest, payload_bytes, record_type, refers_to) of each row; revisits have a null payload."""
    body = binary(payload)
    df = pages.select(F.col(f"`{page_id}`").cast("bigint").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), body.alias("payload"), F.sha2(body, 256).alias("digest"), F.octet_length(body).cast("bigint").alias("payload_bytes"))
    long_ = df.where(F.col("payload_bytes") >= least)
    first = long_.groupBy("digest").agg(F.min("page_id").alias("original"), F.max("page_id").alias("last"), F.count("page_id").alias("ids"), F.count(F.lit(1)).alias("n"))
    # Only digests that repeat under several ids have revisits.
    first = first.where("original < last OR (original IS NOT NULL AND ids < n)").select(F.col("digest").alias("f_digest"), "original", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("f_salt"))
    headers = long_.select("page_id", "digest", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int").alias("salt"))
    met = headers.join(first, (F.col("digest") == F.col("f_digest")) & (F.col("salt") == F.col("f_salt"))).where(~F.col("page_id").eqNullSafe(F.col("original")))
    revisits = stored(met.select(F.col("page_id").alias("r_id"), F.col("digest").alias("r_digest"), "original").distinct(), "warc-revisits")
    few = revisits.count() <= BROADCAST_REVISITS
    key = F.when(F.col("payload_bytes") >= least, F.col("digest"))
    df = df.where(F.col("payload_bytes") >= least).join(F.broadcast(revisits) if few else revisits, (key == F.col("r_digest")) & F.col("page_id").eqNullSafe(F.col("r_id")), "left").unionByName(df.where(F.col("payload_bytes") < least), allowMissingColumns=True)
    again = F.col("original").isNotNull()
    return df.select(
        "page_id",
        "url",
        F.when(~again, F.col("payload")).alias("payload"),
        "digest",
        "payload_bytes",
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("original")).alias("refers_to"),
    )


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{page_id}|{digest}'.encode()).digest()[:16], version=4)}>"


def _uri(url: str) -> str:
    """The URL with what can't stand in a header line percent-encoded."""
    return "".join(c if 32 < ord(c) != 127 else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record(page_id: int | None, url: str | None, payload: bytes | None, digest: str, kind: str, refers_to: int | None, date: str = DATE) -> bytes:
    """One WARC record, with the blank lines that end it."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {date}"]
    if url:
        head.append(f"WARC-Target-URI: {_uri(url)}")
    if page_id is not None:
        head.append(f"{ID_HEADER}: {page_id}")
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write(resolved: DataFrame, path: str, date: str = DATE, file_bytes: int = FILE_BYTES) -> None:
    """Write what ``resolve`` returns as gzipped archives under ``path``."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(k) for k in range(batch.num_columns))):
                i, u, p, d, kind, ref = (x.as_py() for x in row)
                held.append(gzip.compress(record(i, u, p, d, kind, ref, date), 6, mtime=0))
                size += len(held[-1])
                if size >= file_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["members"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["members"])

    files = resolved.select("page_id", "url", "payload", "digest", "record_type", "refers_to").mapInArrow(packed, "members binary")
    # One row is one file; the writer's line end is an empty member.
    files.select(F.col("members").cast("string").alias("value")).write.option("lineSep", SEPARATOR).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", 1).text(path)


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record of a file of gzip members."""
    held, view, place = b"", memoryview(data), 0
    while place < len(view):
        unpack = zlib.decompressobj(31)
        parts = []
        while not unpack.eof:  # in small steps: what a member leaves over is copied
            if place >= len(view):
                raise ValueError("an archive ends within a gzip member")
            parts.append(unpack.decompress(view[place : place + STEP_BYTES]))
            place += min(STEP_BYTES, len(view) - place)
        place -= len(unpack.unused_data)
        held += b"".join(parts)
        at = 0
        while (cut := held.find(b"\r\n\r\n", at)) >= 0:
            lines = held[at:cut].decode().split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError(f"not a record: {lines[0][:40]!r}")
            head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            begin, size = cut + 4, int(head["content-length"])
            if len(held) < begin + size + 4:
                break
            yield head, held[begin : begin + size]
            at = begin + size + 4
        held = held[at:]
    if held.strip():
        raise ValueError("an archive ends within a record")


def read(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """(page_id, url, record_id, record_type, refers_to_id, payload_bytes, digest) of each record, and its payload if asked for.

    Length and digest are computed from responses' payloads; a revisit has the digest of its header and no length.
    """

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                out: list[list] = [[] for _ in _READ]
                for head, block in records(data.as_py()):
                    kind = head["warc-type"]
                    body = block.partition(b"\r\n\r\n")[2]
                    own = kind == "response"
                    row = head.get(ID_HEADER.lower())
                    values = [int(row) if row is not None else None, head.get("warc-target-uri"), head["warc-record-id"], kind, head.get("warc-refers-to"), len(body) if own else None, hashlib.sha256(body).hexdigest() if own else head.get("warc-payload-digest", "").removeprefix("sha256:"), body if own and payloads else None]
                    for column, v in zip(out, values):
                        column.append(v)
                    if len(out[0]) == 500:
                        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, _READ.values())], names=list(_READ))
                        out = [[] for _ in _READ]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, _READ.values())], names=list(_READ))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    got = files.mapInArrow(unpacked, "page_id long, url string, record_id string, record_type string, refers_to_id string, payload_bytes long, digest string, payload binary")
    return got if payloads else got.drop("payload")


_READ = {"page_id": pa.int64(), "url": pa.string(), "record_id": pa.string(), "record_type": pa.string(), "refers_to_id": pa.string(), "payload_bytes": pa.int64(), "digest": pa.string(), "payload": pa.binary()}


def with_originals(got: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): revisits joined to their originals by record id."""
    own = got.where("record_type != 'revisit'").select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", F.lit(None).cast("bigint").alias("refers_to"))
    original = got.where("record_type = 'response'").groupBy(F.col("record_id").alias("o_id")).agg(F.min("page_id").alias("o_page"), F.min("payload_bytes").alias("o_bytes"), F.min("digest").alias("o_digest"))
    again = got.where("record_type = 'revisit'").join(original, F.col("refers_to_id") == F.col("o_id"), "left")
    return own.unionByName(again.select("page_id", F.col("o_bytes").alias("payload_bytes"), F.col("o_digest").alias("payload_digest"), "record_type", F.col("o_page").alias("refers_to")))
