"""WARC archives of pages, written and read as a table of record chunks.

Spark cuts each payload into rows of (record, chunk number, bytes); a writing task
streams them into ``.warc.gz`` files, one gzip member per record, and checks the digest
as it goes. Reading streams an archive back into chunk rows that carry the bytes so far
and the digest so far, so a record's last chunk knows both for the whole payload. Neither
side holds a whole record in Python.

Among records with equal payloads of at least ``min_bytes`` bytes the one with the
smallest key is a response and the others are revisits of it. Payloads are matched by
SHA-256 and length; only groups of two or more are joined back to the pages.

Defined results: a null payload is an empty one; a null url is replaced by the record's
own URI; rows that repeat the smallest key of a group are responses too; a row with a
null key revisits its group's response; an empty table gives no archives; other columns
are not carried.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waybill.llm.common import column
from waybill.llm.files import attempt_name, create, read
from waybill.session import stored

MIN_BYTES = 100
CHUNK = 1 << 16
ARCHIVE_BYTES = 1 << 30
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"  # of the capture; a parameter where pages have one


def records(
    pages: DataFrame,
    *,
    key: str = "page_id",
    url: str = "url",
    payload: str = "html",
    min_bytes: int = MIN_BYTES,
) -> DataFrame:
    """(key, url, payload, payload_bytes, payload_digest, record_type, refers_to) per page."""
    body = F.coalesce(column(payload).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(
        column(key).alias("key"), column(url).cast("string").alias("url"), body.alias("payload")
    ).select(
        "*",
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_digest"),
    )
    groups = (
        rows.filter(F.col("payload_bytes") >= min_bytes)
        .groupBy(F.col("payload_digest").alias("__digest"), F.col("payload_bytes").alias("__bytes"))
        .agg(F.min("key").alias("__first"), F.count(F.lit(1)).alias("__rows"))
        .filter("__rows > 1 AND __first IS NOT NULL")
        .drop("__rows")
    )
    groups = stored(groups, "warc-groups")
    same = (F.col("payload_digest") == F.col("__digest")) & (
        F.col("payload_bytes") == F.col("__bytes")
    )
    revisit = F.col("__first").isNotNull() & ~F.col("key").eqNullSafe(F.col("__first"))
    return rows.join(groups, same, "left").select(
        *rows.columns,
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
        F.when(revisit, F.col("__first")).alias("refers_to"),
    )


def chunked(recs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Rows (record fields, chunk number, chunk, whether it is the last). Revisits have one
    empty chunk. The rows of a record follow each other in their partition."""
    n = F.when(
        F.col("record_type") == "response",
        F.greatest(F.ceil(F.col("payload_bytes") / chunk), F.lit(1)),
    ).otherwise(F.lit(1))
    at = F.explode(F.sequence(F.lit(0), n.cast("int") - 1))
    fields = ["key", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    rows = recs.select(*fields, "payload", n.alias("__n"), at.alias("chunk_no"))
    piece = F.substring(F.col("payload"), F.col("chunk_no") * chunk + 1, F.lit(chunk))
    return rows.select(
        *[F.col(c).cast("string") if c in ("key", "refers_to") else F.col(c) for c in fields],
        "chunk_no",
        F.when(F.col("record_type") == "response", piece)
        .otherwise(F.lit(b"").cast("binary"))
        .alias("chunk"),
        (F.col("chunk_no") + 1 == F.col("__n")).alias("last"),
    )


def _uri(key: str | None) -> str:
    return f"<urn:record:{json.dumps(key)}>"


def _clean(url: str) -> str:
    return "".join(c if c > " " else f"%{ord(c):02X}" for c in url)


def _head(row: dict) -> bytes:
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {row['payload_bytes']}\r\n\r\n"
    ).encode()
    revisit = row["record_type"] == "revisit"
    length = len(http) + (0 if revisit else row["payload_bytes"])
    named = _uri(row["key"])
    lines = [
        "WARC/1.1",
        f"WARC-Type: {row['record_type']}",
        f"WARC-Record-ID: {named}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_clean(row['url']) if row['url'] else named[1:-1]}",
        f"WARC-Payload-Digest: sha256:{row['payload_digest']}",
        *([f"WARC-Refers-To: {_uri(row['refers_to'])}", f"WARC-Profile: {PROFILE}"]
          if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {length}",
    ]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + http


def write_archives(
    recs: DataFrame, folder: str, *, chunk: int = CHUNK, archive_bytes: int = ARCHIVE_BYTES
) -> DataFrame:
    """Write the records and return one row per archive: (path, n_records)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, sink, n, size, gz, sha = "", None, 0, 0, None, None

        def closed():
            sink.close()
            return pa.RecordBatch.from_pylist([{"path": path, "n_records": n}], schema=schema)

        for batch in batches:
            for row in batch.to_pylist():
                if row["chunk_no"] == 0:
                    if sink is None:
                        path, n, size = attempt_name(folder, ".warc.gz"), 0, 0
                        sink = create(path)
                    gz, sha = zlib.compressobj(1, zlib.DEFLATED, 31), hashlib.sha256()
                    sink.write(gz.compress(_head(row)))
                sha.update(row["chunk"])
                out = gz.compress(row["chunk"])
                if row["last"]:
                    if row["record_type"] == "response" and sha.hexdigest() != row["payload_digest"]:
                        raise ValueError(f"chunks of record {row['key']} do not give its digest")
                    out += gz.compress(b"\r\n\r\n") + gz.flush()
                    n += 1
                sink.write(out)
                size += len(out)
                if row["last"] and size >= archive_bytes:
                    yield closed()
                    sink = None
        if sink is not None:
            yield closed()

    schema = pa.schema([("path", pa.string()), ("n_records", pa.int64())])
    written = chunked(recs, chunk).mapInArrow(write, "path string, n_records bigint")
    return stored(written, "archives")


CHUNKS = (
    "key string, url string, record_type string, refers_to string, payload_bytes bigint, "
    "payload_digest string, chunk_no int, chunk binary, bytes_so_far bigint, "
    "digest_so_far string, last boolean"
)


def _fields(stream) -> dict[str, str]:
    """Header lines up to the empty one, by lower-case name."""
    out = {}
    for line in iter(stream.readline, b"\r\n"):
        if not line:
            raise ValueError("an archive ends inside a header")
        name, _, value = line.decode().partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def _key(uri: str | None) -> str | None:
    return None if uri is None else json.loads(uri.removeprefix("<urn:record:").removesuffix(">"))


def archive_chunks(stream, chunk: int) -> Iterator[dict]:
    """Chunk rows of one uncompressed archive stream."""
    while version := stream.readline():
        if not version.startswith(b"WARC/"):
            raise ValueError(f"no record begins with {version[:40]!r}")
        head = _fields(stream)
        left = int(head["content-length"])
        status = stream.readline()
        http_at = len(status)
        counted = io.BytesIO()
        for line in iter(stream.readline, b"\r\n"):
            counted.write(line)
        http_at += counted.tell() + 2
        counted.seek(0)
        http = {
            k.strip().lower(): v.strip()
            for k, _, v in (x.decode().partition(":") for x in counted)
        }
        left -= http_at
        revisit = head["warc-type"] == "revisit"
        row = {
            "key": _key(head["warc-record-id"]),
            "url": head["warc-target-uri"],
            "record_type": head["warc-type"],
            "refers_to": _key(head.get("warc-refers-to")),
            "payload_bytes": int(http["content-length"]),
            "payload_digest": head["warc-payload-digest"].removeprefix("sha256:"),
        }
        sha, so_far, no = hashlib.sha256(), 0, 0
        while True:
            data = stream.read(min(chunk, left))
            if len(data) < min(chunk, left):
                raise ValueError("an archive ends inside a payload")
            left -= len(data)
            so_far += len(data)
            sha.update(data)
            yield row | {
                "chunk_no": no,
                "chunk": data,
                "bytes_so_far": row["payload_bytes"] if revisit else so_far,
                "digest_so_far": row["payload_digest"] if revisit else sha.hexdigest(),
                "last": left == 0,
            }
            no += 1
            if left == 0:
                break
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record does not end with two line ends")


def read_archives(archives: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The chunk table of the archives named in column ``path``.

    ``payload_bytes`` and ``payload_digest`` are what the record's head states;
    ``bytes_so_far`` and ``digest_so_far`` are measured (for revisits, which store no
    payload, they repeat the head's).
    """
    paths = archives.select("path")
    spread = paths.repartition(max(1, paths.count()), "path")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with read(path) as raw, io.BufferedReader(gzip.GzipFile(fileobj=raw)) as stream:
                    for row in archive_chunks(stream, chunk):
                        rows.append(row)
                        held += len(row["chunk"])
                        if len(rows) == 1000 or held >= 1 << 23:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    schema = pa.schema([
        ("key", pa.string()), ("url", pa.string()), ("record_type", pa.string()),
        ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
        ("chunk_no", pa.int32()), ("chunk", pa.binary()), ("bytes_so_far", pa.int64()),
        ("digest_so_far", pa.string()), ("last", pa.bool_()),
    ])
    return spread.mapInArrow(scan, CHUNKS)
