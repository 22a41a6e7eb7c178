"""WARC revisit resolution.

``captures`` turns crawled pages into WARC records. ``resolve`` shuffles only headers (ids, addresses, digests;
never payloads) by payload digest: the first record with a payload of each digest is its original response, and
every later response with that digest, and every revisit record, is joined to it. ``archive`` builds the records of
the deduplicated archive, each with a fresh header: responses with their payload, repeats as revisit records that
refer to the original. ``write_warc`` writes them as gzip members, one file per partition.

Order of captures is that of (page_id, url), nulls last. Results for special input:

* a null payload: a record of type revisit can be resolved by the digest it carries; any other becomes a metadata
  record with an empty block, since nothing was captured;
* an empty payload: a payload like any other (its digest is that of no bytes);
* a revisit without original: kept as it is, with ``refers_to`` null;
* equal rows and equal addresses: each is a capture of its own; the first is the response, the others revisits;
* a null url: the header has no WARC-Target-URI; other columns are ignored; an empty table: no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import os
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelens.llm._spark import with_row_id

_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:pagelens:warc")
DATE = "2024-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    """The payload digest as archives write it: SHA-1 in base 32."""
    return "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()


def captures(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", kind_col: str | None = None, digest_col: str | None = None) -> DataFrame:
    """(row, page_id, url, kind, digest, payload), one row per row of ``pages``; kind and digest may be given.

    ``digest`` is the SHA-1 in hexadecimal here, which Spark computes itself; headers have it in base 32.
    """
    src = with_row_id(pages.select(
        F.col(f"`{id_col}`").cast("long").alias("page_id"),
        F.col(f"`{url_col}`").cast("string").alias("url"),
        F.col(f"`{html_col}`").cast("string").alias("payload"),
        (F.col(f"`{kind_col}`") if kind_col else F.lit(None)).cast("string").alias("given_kind"),
        (F.col(f"`{digest_col}`") if digest_col else F.lit(None)).cast("string").alias("given_digest"),
    ), "row")
    given = _hexadecimal("given_digest") if digest_col else F.lit(None).cast("string")
    kind = F.coalesce("given_kind", F.when(F.col("payload").isNull(), "metadata").otherwise("response"))
    return src.select("row", "page_id", "url", kind.alias("kind"), F.coalesce(F.sha1(F.encode("payload", "utf-8")), given).alias("digest"), "payload")


@F.pandas_udf(T.StringType())
def _hexadecimal(digests: pd.Series) -> pd.Series:
    """Digests as archives write them, in hexadecimal; anything else stays as it is."""

    def one(d):
        try:
            return base64.b32decode(d[5:]).hex() if d is not None and d.startswith("sha1:") else d
        except ValueError:
            return d

    return digests.map(one)


def written(key: str | None) -> str | None:
    """A digest as archives write it, from the hexadecimal key."""
    if key is None or len(key) != 40:
        return key
    return "sha1:" + base64.b32encode(bytes.fromhex(key)).decode()


def resolve(records: DataFrame) -> DataFrame:
    """(row, original_row, original_page_id, original_url) of every record that repeats an earlier payload or is a revisit with an original."""
    heads = records.select("row", "page_id", "url", "kind", "digest").filter(F.col("digest").isNotNull() & (F.col("kind") != "metadata"))
    order = F.struct(F.col("page_id").isNull().alias("a"), "page_id", F.col("url").isNull().alias("b"), "url", "row")
    first = heads.filter(F.col("kind") == "response").groupBy("digest").agg(F.min(order).alias("o"))
    joined = heads.join(first, "digest").filter((F.col("kind") == "revisit") | (F.col("row") != F.col("o.row")))
    return joined.select("row", F.col("o.row").alias("original_row"), F.col("o.page_id").alias("original_page_id"), F.col("o.url").alias("original_url"))


def record_id(page_id: int | None, url: str | None, row: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}|{url}|{row}')}>"


def header(kind: str, rid: str, url: str | None, dig: str | None, block: bytes, refers: tuple[str, str | None] | None) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {rid}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if dig is not None:
        lines.append(f"WARC-Payload-Digest: {dig}")
    if kind == "revisit":
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    if refers:
        lines.append(f"WARC-Refers-To: {refers[0]}")
        if refers[1] is not None:
            lines.append("WARC-Refers-To-Target-URI: " + refers[1].replace("\r", "%0D").replace("\n", "%0A"))
        lines.append(f"WARC-Refers-To-Date: {DATE}")
    lines += [f"WARC-Block-Digest: {digest(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n"


def block(payload: bytes | None) -> bytes:
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    return head + b"\r\n" if payload is None else head + b"Content-Length: %d\r\n\r\n" % len(payload) + payload


def archive(records: DataFrame) -> DataFrame:
    """(page_id, warc_type, record_id, refers_to, payload_digest, content_length, record): the records to write."""
    repeats = resolve(records).withColumnRenamed("row", "r")
    # Repeats have numbers only; the payloads stay where they are unless both sides are large.
    joined = records.join(repeats, F.col("row") == F.col("r"), "left").select(*records.columns, "original_row", "original_page_id", "original_url")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = {k: [] for k in ("page_id", "warc_type", "record_id", "refers_to", "payload_digest", "content_length", "record")}
            cols = {n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)}
            for row, page, url, kind, dig, payload, o, op, ou in zip(*(cols[k] for k in ("row", "page_id", "url", "kind", "digest", "payload", "original_row", "original_page_id", "original_url"))):
                kind, dig = "revisit" if o is not None else kind, written(dig)
                rid, ref = record_id(page, url, row), record_id(op, ou, o) if o is not None else None
                body = b"" if kind == "metadata" else block(None if kind == "revisit" or payload is None else payload.encode())
                full = header(kind, rid, url, dig, body, (ref, ou) if ref else None) + body + b"\r\n\r\n"
                for k, v in zip(out, (page, kind, rid, ref, dig, len(body), full)):
                    out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, pa.schema([("page_id", pa.int64()), ("warc_type", pa.string()), ("record_id", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("content_length", pa.int64()), ("record", pa.binary())]))

    return joined.mapInArrow(build, "page_id LONG, warc_type STRING, record_id STRING, refers_to STRING, payload_digest STRING, content_length LONG, record BINARY")


def write_warc(records: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """Write ``record`` of every row to ``folder``, one file of gzip members per partition; (file, records, bytes) per file.

    The folder is one that all executors share. A file gets its name when it is complete, and a task that runs
    again replaces it by the same records.
    """
    info = "\r\n".join(["software: pagelens", "format: WARC File Format 1.1", ""]).encode()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        os.makedirs(folder, exist_ok=True)
        name, tmp = f"{folder}/part-{part:05d}.warc.gz", f"{folder}/.{uuid.uuid4().hex}"
        n = 0
        with open(tmp, "wb") as f:
            rid = record_id(None, name, part)
            head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {rid}\r\nWARC-Date: {DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n"
            f.write(gzip.compress(head.encode() + info + b"\r\n\r\n", level, mtime=0))
            for b in batches:
                for r in b.column(0).to_pylist():
                    f.write(gzip.compress(r, level, mtime=0))
                    n += 1
        os.replace(tmp, name)
        yield pa.RecordBatch.from_pydict({"file": [name], "records": [n], "bytes": [os.path.getsize(name)]})

    return records.select("record").mapInArrow(write, "file STRING, records LONG, bytes LONG")


def op8_warc(spark, sf_dir: str) -> DataFrame:
    return archive(captures(spark.read.parquet(f"{sf_dir}/pages.parquet")))
