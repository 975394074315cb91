"""WARC archives with revisit records in place of repeated payloads.

Headers (id, payload digest, length) are shuffled by digest: the smallest id of
each digest, found by a map-side minimum, is the original, and the others become
revisit records that refer to it. Payloads stay where they are read: while the
list of revisits is small it is broadcast; a longer list is dealt to a table for
each input file in the shared folder, and a task that reads a file looks up that
file's revisits, as many as the file has rows at most. Only rows that come from
no file (made by a join, say) are joined by id and digest instead. Joins have one
row of their small side for each key, so Spark may split a digest that millions
share. Tasks write archives, a gzip member for each record, with record ids,
dates, digests and lengths of their own.

Cases: a null payload is empty; equal empty payloads count as copies too; a null
id is never an original unless nothing else is known of its digest, and then all
such records are responses; rows with the same id and payload are all responses
if the id is the smallest; an empty table writes nothing; a null URL is written
as an empty one, and control characters in a URL are percent-encoded; columns
beyond id, URL and payload are not read.
"""
from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskweave.llm.common import small_batches, table
from maskweave.llm.files import PartFile, file_system, open_input
from maskweave.storage import BROADCAST_BYTES, compacted, delete, few, fresh_path

#: Bytes of archives that a task reads back, when files are small.
READ_BYTES = 8 << 20
DATE = "2025-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the public name space of URLs


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}/{digest}')}>"


def _safe(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: quote(m[0]), url or "")


def write_record(page_id: int | None, url: str | None, payload: bytes | None, digest: str, length: int, refers_to: int | None) -> bytes:
    """A record as a gzip member. ``payload``: None for a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http if payload is None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if payload is not None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_safe(url)}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{digest32(block)}"]
    if page_id is not None:
        head.append(f"X-Row-ID: {page_id}")
    if payload is None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Row-ID: {refers_to}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def members(stream) -> Iterator[bytes]:
    """The gzip members of a stream, one in memory at a time."""
    unpack, parts, more = zlib.decompressobj(31), [], stream.read(1 << 16)
    while more:
        parts.append(unpack.decompress(more))
        more = unpack.unused_data if unpack.eof else b""
        if unpack.eof:
            yield b"".join(parts)
            unpack, parts = zlib.decompressobj(31), []
        more = more or stream.read(1 << 16)
    if parts:
        raise ValueError("the archive ends within a record")


def read_record(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload; lengths and digests are verified."""
    head, rest = member.split(b"\r\n\r\n", 1)
    warc = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.decode().split("\r\n")[1:])
    block = rest[: int(warc["Content-Length"])]
    if rest[len(block):] != b"\r\n\r\n" or warc["WARC-Block-Digest"] != f"sha1:{digest32(block)}":
        raise ValueError(f"record {warc['WARC-Record-ID']} is damaged")
    status, payload = block.split(b"\r\n\r\n", 1)
    http = dict(x.split(": ", 1) for x in status.decode().split("\r\n")[1:])
    if warc["WARC-Type"] == "response" and (warc["WARC-Payload-Digest"] != f"sha1:{digest32(payload)}" or len(payload) != int(http["Content-Length"])):
        raise ValueError(f"the payload of {warc['WARC-Record-ID']} is damaged")
    return warc, http, payload


def revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, sha, file, original) of the rows that repeat the payload of another."""
    heads = pages.select("page_id", "sha", "file").where(F.col("n_bytes") >= min_bytes)
    firsts = heads.groupBy("sha").agg(F.min("page_id").alias("original"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return heads.join(firsts, "sha").where("page_id <> original").select("page_id", "sha", "file", "original").distinct()


def _key(uri: str) -> str:
    return hashlib.sha1(uri.encode()).hexdigest()


def side_tables(again: DataFrame, folder: str) -> None:
    """The revisits of each input file as a table of its own below ``folder``."""
    dealt = again.withColumn("key", F.sha1(F.col("file").cast("binary"))).repartition("key")
    dealt.select("key", "page_id", "sha", "original").write.partitionBy("key").parquet(folder)


def _originals(folder: str, uri: str) -> dict[tuple[int, str], int]:
    """(page_id, sha) to original of an input file's revisits."""
    where, path = file_system(f"{folder}/key={_key(uri)}")
    if where.get_file_info(path).type == fs.FileType.NotFound:
        return {}
    rows = ds.dataset(path, filesystem=where, format="parquet").to_table(columns=["page_id", "sha", "original"])
    return {(i, sha): first for i, sha, first in zip(*(c.to_pylist() for c in rows.columns))}


def resolved(rows: DataFrame, again: DataFrame) -> tuple[DataFrame, str | None]:
    """Rows (page_id, url, payload, sha, n_bytes, original, file) to write, and the folder of the side
    tables that have the originals if the rows don't. Payloads of revisits are null in the first case."""
    known = again.select("page_id", "sha", "original").distinct()
    if again.count() * (56 + 32) // 4 <= BROADCAST_BYTES or not again.where("file = ''").isEmpty():
        both = rows.join(few(known, 56), ["page_id", "sha"], "left")
        return both.select("page_id", "url", F.when(F.col("original").isNull(), F.col("payload")).alias("payload"), "sha", "n_bytes", "original", F.lit("").alias("file")), None
    side = fresh_path(rows.sparkSession, "revisits-by-file")
    side_tables(again, side)
    return rows.select("page_id", "url", "payload", "sha", "n_bytes", F.lit(None).cast("long").alias("original"), "file"), side


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write a record for each row under ``folder``. A row (uri, n_records, n_bytes) for each archive."""
    html = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), html.alias("payload"), F.input_file_name().alias("file")).withColumns({"sha": F.sha1("payload"), "n_bytes": F.octet_length("payload")})
    rows, side = resolved(rows, compacted(revisits(rows, min_bytes), "revisits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n, at, known = None, 0, None, {}
        for batch in batches:
            for i, u, p, sha, size, first, file in zip(*(c.to_pylist() for c in batch.columns)):
                if side is not None:
                    if file != at:
                        at, known = file, _originals(side, file)
                    first = known.get((i, sha))
                    p = p if first is None else None
                out = out or PartFile(folder, ".warc.gz")
                out.write(write_record(i, u, p, base64.b32encode(bytes.fromhex(sha)).decode(), size, first))
                n += 1
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"uri": [out.uri], "n_records": [n], "n_bytes": [out.size]})

    with small_batches(pages.sparkSession):
        written = compacted(rows.mapInArrow(run, "uri string, n_records long, n_bytes long"), "archives")
    if side is not None:
        delete(pages.sparkSession, [side])
    return written


def read_archives(archives: DataFrame) -> DataFrame:
    """A row for each record of the archives, from the archives alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("uri").to_pylist():
                rows = []
                with open_input(uri) as stream:
                    for member in members(stream):
                        warc, http, _ = read_record(member)
                        number = lambda k: int(warc[k]) if k in warc else None  # noqa: B023, E731
                        rows.append({"page_id": number("X-Row-ID"), "payload_bytes": int(http["Content-Length"]), "payload_digest": warc["WARC-Payload-Digest"].removeprefix("sha1:"), "record_type": warc["WARC-Type"], "refers_to": number("X-Refers-To-Row-ID"), "record_id": warc["WARC-Record-ID"], "target_uri": warc["WARC-Target-URI"]})
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("record_id", pa.string()), ("target_uri", pa.string())])
    n_bytes, n_files = archives.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)), F.count(F.lit(1))).first()
    n = max(1, min(n_files, -(-n_bytes // READ_BYTES)))
    return archives.select("uri").repartition(n).mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, target_uri string")


def op3_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = write_archives(table(spark, sf_dir, "pages"), fresh_path(spark, "warc"))
    return read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = {
    "op3_warc_revisits": """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, upper(sha1(coalesce(html, ''))) AS sha FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY sha) AS first FROM p
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(sha, 1 + (i // 4) * 5, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
""",
}
QUERIES = {"op3_warc_revisits": op3_warc_revisits}
