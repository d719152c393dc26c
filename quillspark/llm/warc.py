"""WARC archives: written with an index, read back by coalesced byte ranges of the records selected.

Each task writes one archive of gzip members, a record each, into the shared folder and returns its
index rows (file, offset, length, url, digest). The index is a Parquet table; archives of failed
attempts are in no index row. Reading sorts the selected index rows by file and offset, merges
neighbours into ranges, reads each range once and parses its records.

Nulls and edge cases: null html is an empty payload; null urls are written as about:blank and stay
null in the index; among records with equal payloads of at least MIN_BYTES the largest page_id is the
response (rows that repeat that page_id and payload all are; a null page_id is below every other
and is the response only where all are null); no pages give no files and no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.llm.common import table
from quillspark.operators.cuts import cut, new_path, work_dir

MIN_BYTES = 1000
#: Neighbouring records less than GAP bytes apart are read together, RANGE bytes at once at most.
GAP, RANGE = 64 << 10, 8 << 20
#: An archive file is closed beyond this size.
FILE_BYTES = 256 << 20
INDEX = "file string, offset long, length long, page_id long, url string, payload_digest string, record_type string"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
DATE = b"2000-01-01T00:00:00Z"


def _store(path: str):
    """(file system, path in it) of a folder all executors reach."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _urn(page_id: int | None) -> bytes:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page:{page_id}')}>".encode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One record: HTTP head and payload, the head alone in a revisit."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head + payload if kind == "response" else head
    target = re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m[0][0], (url or "about:blank").encode())
    lines = [
        b"WARC/1.1", b"WARC-Type: " + kind.encode(), b"WARC-Record-ID: " + _urn(page_id), b"WARC-Date: " + DATE, b"WARC-Target-URI: " + target,
        b"WARC-Payload-Digest: sha1:" + digest.encode(), b"X-Page-ID: " + str(page_id).encode(), b"Content-Type: application/http;msgtype=response",
    ]
    if kind == "revisit":
        lines += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", b"WARC-Refers-To: " + _urn(refers_to), b"X-Refers-To-Page: " + str(refers_to).encode()]
    return b"\r\n".join([*lines, b"Content-Length: %d" % len(block), b"", b""]) + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """The fields of one record; a response's payload is checked against its digest."""
    top, _, rest = raw.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip().decode() for k, _, v in (line.partition(b":") for line in top.split(b"\r\n")[1:])}
    block = rest[: int(fields[b"content-length"])]
    head, _, payload = block.partition(b"\r\n\r\n")
    n = int(re.search(rb"(?i)content-length:\s*(\d+)", head)[1])
    kind, digest = fields[b"warc-type"], fields[b"warc-payload-digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != n or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"record of page {fields[b'x-page-id']} doesn't hold what it was written with")
    number = lambda x: None if x in (None, "None") else int(x)
    return {"page_id": number(fields[b"x-page-id"]), "payload_bytes": n, "payload_digest": digest, "record_type": kind, "refers_to": number(fields.get(b"x-refers-to-page"))}


def typed(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """pages with payload_digest, record_type and refers_to; payloads that occur once never leave their task."""
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(html).alias("payload_digest"), F.octet_length(html).alias("n"))
    large = rows.where(F.col("n") >= min_bytes).groupBy("payload_digest").agg(F.max("page_id").alias("top"), F.count("*").alias("copies"))
    rows = rows.join(large.where("copies > 1").drop("copies").withColumn("again", F.lit(True)), "payload_digest", "left")
    revisit = F.col("again").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top"))
    return rows.select("page_id", "url", "html", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("top")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write all pages as archives below folder; gives the index, itself a table in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        out, name, at = None, "", 0
        for b in batches:
            rows = []
            for r in b.to_pylist():
                if out is None or at > FILE_BYTES:
                    if out is not None:
                        out.close()
                    store.create_dir(root, recursive=True)
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0  # a new name for each attempt
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                z = zlib.compressobj(6, wbits=31)
                made = record(r["page_id"], r["url"], (r["html"] or "").encode(), r["payload_digest"], r["record_type"], r["refers_to"])
                member = z.compress(made) + z.flush()
                out.write(member)
                rows.append({"file": name, "offset": at, "length": len(member), "page_id": r["page_id"], "url": r["url"], "payload_digest": r["payload_digest"], "record_type": r["record_type"]})
                at += len(member)
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=INDEX_ARROW)
        if out is not None:
            out.close()

    return cut(pages.mapInArrow(run, INDEX), "warc-index")


INDEX_ARROW = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_digest", pa.string()), ("record_type", pa.string())])
RECORD_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def ranges(rows: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, list[int]]]:
    """(file, offset, length, which rows) for rows (file, offset, length) sorted by file and offset."""
    now: list[int] = []
    for i, (file, offset, length) in enumerate(rows):
        if now:
            first, last = rows[now[0]], rows[now[-1]]
            if first[0] != file or offset - last[1] - last[2] > GAP or offset + length - first[1] > RANGE:
                yield first[0], first[1], last[1] + last[2] - first[1], now
                now = []
        now.append(i)
    if now:
        first, last = rows[now[0]], rows[now[-1]]
        yield first[0], first[1], last[1] + last[2] - first[1], now


def read_records(selected: DataFrame, folder: str) -> DataFrame:
    """The records of index rows: page_id, url, payload_bytes, payload_digest, record_type, refers_to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        for b in batches:
            rows = b.to_pylist()
            out = []
            for file, offset, length, which in ranges([(r["file"], r["offset"], r["length"]) for r in rows]):
                with store.open_input_file(f"{root}/{file}") as f:
                    raw = f.read_at(length, offset)
                for i in which:
                    a = rows[i]["offset"] - offset
                    out.append(parse(zlib.decompress(raw[a : a + rows[i]["length"]], 31)) | {"url": rows[i]["url"]})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=RECORD_ARROW)

    order = selected.select("file", "offset", "length", "url").repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    return order.mapInArrow(run, RECORD)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "warc")
    if "://" not in folder and not work_dir(spark).startswith("/"):
        raise ValueError("spark.checkpoint.dir must be an absolute path or a URI")
    index = write_archives(typed(table(spark, sf_dir, "pages")), folder)
    return read_records(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS payload_digest, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages),
t AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
FROM t
"""
