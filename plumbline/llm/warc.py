"""WARC archives: index first, then coalesced reads of the selected records."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from plumbline.functions.columns import col_
from plumbline.llm.common import Scratch, marked_by, read_table, text_bytes
from plumbline.llm.files import Appender, read_ranges
from plumbline.sources.shared import scratch_path

# Smaller payloads are always written in full.
REVISIT_BYTES = 100
FILE_BYTES = 1 << 28
READ_GAP = 1 << 16
READ_MOST = 1 << 23
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_INDEX = "page_id long, path string, offset long, length long, url string, payload_digest string, record_type string"
_BACK = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _record(row: dict, date: str) -> bytes:
    """One record: a response with its payload, or a revisit without."""
    payload, first = row["payload"], row["first_id"]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % row["payload_bytes"]
    # A header line holds no control characters or spaces of a URL.
    url = quote(row["url"] or "", safe="%/:?#[]@!$&'()*+,;=~")
    kind = "response" if first is None else "revisit"
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if row['page_id'] is None else row['page_id']}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha256:{row['digest']}",
        "Content-Type: application/http;msgtype=response",
    ]
    if first is None:
        block = http + payload
    else:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{first}>"]
        block = http
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _write(folder: str, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"part-{TaskContext.get().partitionId():06d}.warc"
        out, rows = None, []

        def closed():
            path = out.close()
            columns = list(zip(*rows))
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()))]
            arrays.insert(1, pa.array([path] * len(rows)))
            return pa.RecordBatch.from_arrays(arrays, [part.split()[0] for part in _INDEX.split(", ")])

        for batch in batches:
            for k in range(batch.num_rows):
                row = {field: batch.column(field)[k].as_py() for field in batch.schema.names}
                if out is None:
                    out, rows = Appender(folder, name), []
                    info = b"software: plumbline\r\nformat: WARC File Format 1.1\r\n"
                    out.write(
                        f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:file:{out.path.rsplit('/')[-1]}>\r\nWARC-Date: {date}\r\n"
                        f"Content-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n".encode() + info + b"\r\n\r\n"
                    )
                record = _record(row, date)
                kind = "response" if row["first_id"] is None else "revisit"
                rows.append((row["page_id"], out.write(record), len(record), row["url"], row["digest"], kind))
                if out.size >= FILE_BYTES:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return run


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write one record per row under `folder`; the index of the records.

    Of payloads equal by SHA-256, of REVISIT_BYTES at least, the row with the
    smallest id is the response and the others revisit it; rows that repeat
    that id are responses too. A null payload is empty; a null id never is
    what others refer to, unless no row of the group has one: then all are
    responses. Other columns are ignored; no rows write no files.
    """
    source = pages.select(
        col_(id_col).cast("long").alias("page_id"), col_(url_col).cast("string").alias("url"), text_bytes(col_(payload_col)).alias("payload")
    )
    rows = source.withColumn("digest", F.sha2("payload", 256)).withColumn("payload_bytes", F.length("payload").cast("long"))
    scratch = Scratch(pages.sparkSession, "warc")
    groups = rows.where(F.col("payload_bytes") >= REVISIT_BYTES).groupBy("digest")
    groups = groups.agg(F.min("page_id").alias("response_id"), F.count(F.lit(1)).alias("n"))
    repeated = scratch.stage(groups.where("n > 1").select("digest", "response_id"), "repeated")
    # Only payloads that may occur twice are shuffled to their group's fact.
    flagged = marked_by(rows, F.col("digest"), repeated.select("digest"), "maybe_repeated")
    first = F.when(~F.col("page_id").eqNullSafe(F.col("response_id")), F.col("response_id"))
    again = flagged.where("maybe_repeated").join(repeated, "digest", "left").withColumn("first_id", first)
    once = flagged.where("NOT maybe_repeated").withColumn("first_id", F.lit(None).cast("long"))
    fields = ["page_id", "url", "payload", "digest", "payload_bytes", "first_id"]
    date = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    index = once.select(*fields).union(again.select(*fields)).mapInArrow(_write(folder, date), _INDEX)
    # Written once: a task that runs again leaves a file that no index row names.
    index = scratch.stage(index, "index")
    scratch.drop("repeated")
    return index


def _parsed(raw: bytes) -> dict:
    """The headers and the payload of one record."""
    head, _, block = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = block[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    length = next(int(line.split(b":")[1]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:"))
    return fields | {"payload": payload, "payload_bytes": length}


def _read(folder: str):
    def ids(text: str) -> int | None:
        number = text.removeprefix("<urn:page:").removesuffix(">")
        return int(number) if number else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch.column("path").to_pylist()
            ranges = list(zip(batch.column("offset").to_pylist(), batch.column("length").to_pylist()))
            out, start = [], 0
            while start < len(paths):
                stop = start
                while stop < len(paths) and paths[stop] == paths[start]:
                    stop += 1
                for raw in read_ranges(folder, paths[start], ranges[start:stop], READ_GAP, READ_MOST):
                    record = _parsed(raw)
                    revisit = record["WARC-Type"] == "revisit"
                    digest = record["WARC-Payload-Digest"].removeprefix("sha256:")
                    if not revisit and hashlib.sha256(record["payload"]).hexdigest() != digest:
                        raise ValueError(f"damaged record {record['WARC-Record-ID']} in {paths[start]}")
                    out.append(
                        (
                            ids(record["WARC-Record-ID"]), record["payload_bytes"] if revisit else len(record["payload"]), digest,
                            record["WARC-Type"], ids(record["WARC-Refers-To"]) if revisit else None,
                        )
                    )
                start = stop
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            names = [part.split()[0] for part in _BACK.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    return run


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """The records that `index` (any selection of its rows) names, checked and parsed.

    Rows are sorted by file and offset, so that each file is read forwards in
    few large reads; a payload that does not match its digest is an error.
    """
    ordered = index.select("path", "offset", "length").repartitionByRange("path", "offset").sortWithinPartitions("path", "offset")
    return ordered.mapInArrow(_read(folder), _BACK)


def op9_warc(spark, sf_dir):
    folder = scratch_path(spark, "archives")
    return read_archives(write_archives(read_table(spark, sf_dir, "pages"), folder), folder)


OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
h AS (SELECT page_id, octet_length(encode(body)) AS payload_bytes, sha256(body) AS payload_digest FROM p),
g AS (SELECT payload_digest, min(page_id) AS first_id FROM h WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT h.page_id, h.payload_bytes, h.payload_digest,
       CASE WHEN g.first_id IS NULL OR g.first_id = h.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN g.first_id <> h.page_id THEN g.first_id END AS refers_to
FROM h LEFT JOIN g ON h.payload_digest = g.payload_digest
"""
