"""WARC archives, index first: write records and an index of them, then read only by index.

Tasks write compressed records to rolling files in the shared folder and return one index
row per record: file, offset, length, URL and digest. Reading starts from index rows; the
byte ranges of the chosen records are sorted by place and read in coalesced spans.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, scratch, sized, table

#: Bytes after which a writing task begins another file.
ROLL_BYTES = 256 << 20
#: A read spans at most so many bytes, and skips at most so many that nobody asked for.
SPAN_BYTES = 1 << 20
#: Bytes of records that a reading task gets.
TASK_BYTES = 128 << 20
#: Bytes in memory of a row of the first pages: digest, id and address.
FIRST_ROW = 400
GAP_BYTES = 64 << 10
#: Payloads below this are never deduplicated.
LEAST_PAYLOAD = 100

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "file string, offset bigint, length bigint, url string, payload_digest string, record_type string, page_id bigint"
RECORD = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"


def _clean(value: str) -> str:
    """A header value: control characters are percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def _record_id(page_id: int | None, url: str | None, digest: str, nth: int) -> str:
    """The record's id: the same on a rerun, another for every row of the table."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{url}:{digest}:{nth}')}>"


def _record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, record_id: str, refers_to: tuple[int, str | None, str] | None) -> bytes:
    """One WARC record as its own gzip member; a revisit refers to another page's record."""
    revisit = refers_to is not None
    head = [
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Payload-Length: {size}",
        "Content-Type: application/http;msgtype=response",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
        if _clean(url) != url:  # the standard header can't hold it as it is
            head.append(f"WARC-Page-URL: {json.dumps(url)}")
    if page_id is not None:
        head.append(f"WARC-Page-ID: {page_id}")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {refers_to[2]}", f"WARC-Refers-To-Date: {DATE}", f"WARC-Refers-To-Page: {refers_to[0]}"]
        if refers_to[1] is not None:
            head.append(f"WARC-Refers-To-Target-URI: {_clean(refers_to[1])}")
        block = http + b"\r\n"
    else:
        block = http + b"Content-Length: %d\r\n\r\n" % len(payload) + payload
    head.append(f"Content-Length: {len(block)}")
    z = zlib.compressobj(3, wbits=31)
    return z.compress(("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n") + z.flush()


def _parsed(raw: bytes) -> dict:
    """The fields of a record, its digest checked where it carries a payload."""
    data = zlib.decompress(raw, wbits=31)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    digest, size = fields["WARC-Payload-Digest"].removeprefix("sha256:"), int(fields["WARC-Payload-Length"])
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("a payload differs from its digest")
    number = lambda k: int(fields[k]) if k in fields else None
    return {"page_id": number("WARC-Page-ID"), "url": json.loads(fields["WARC-Page-URL"]) if "WARC-Page-URL" in fields else fields.get("WARC-Target-URI"), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": number("WARC-Refers-To-Page"), "payload": payload if kind == "response" else None}


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
    return pa.schema([(n, kinds[t]) for n, t in (c.strip().split(" ") for c in ddl.split(","))])


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        out = name = None
        try:
            for batch in batches:
                rows = []
                for page_id, url, html, size, digest, nth, first, first_url in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    revisit = first is not None
                    if out is None or out.tell() >= ROLL_BYTES:
                        if out is not None:
                            out.close()
                        store.create_dir(base, recursive=True)
                        name = f"{uuid.uuid4().hex}.warc.gz"
                        out = store.open_output_stream(f"{base}/{name}", compression=None)
                    refers_to = (first, first_url, _record_id(first, first_url, digest, 0)) if revisit else None
                    data = _record(page_id, url, (html or "").encode(), size, digest, _record_id(page_id, url, digest, nth), refers_to)
                    rows.append({"file": f"{folder}/{name}", "offset": out.tell(), "length": len(data), "url": url, "payload_digest": digest, "record_type": "revisit" if revisit else "response", "page_id": page_id})
                    out.write(data)
                yield _batch(rows, _schema(INDEX))
        finally:
            if out is not None:
                out.close()

    return run


def write_warc(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Archive every row; returns the stored index, one row per record.

    Of rows with equal payloads of at least ``LEAST_PAYLOAD`` bytes the one with the smallest
    id is a response and the others revisit it; rows that share the smallest id are all
    responses. A null id counts as larger than any other; if all ids of a group are null,
    all are responses. A null payload is empty; an empty table writes an empty index; other
    columns are ignored. A rerun task writes files of its own names, and only the index of
    the successful attempt counts. Digests are compared on narrow rows; the payloads of
    revisits go no further than their length.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256)).withColumn("size", F.octet_length("html"))
    with Scratch(spark) as scratch_:
        least = F.min(F.struct("page_id", "url"))
        groups = rows.where((F.col("size") >= LEAST_PAYLOAD) & F.col("page_id").isNotNull()).groupBy("digest").agg(least.alias("first"), F.count("*").alias("c"))
        nameless = rows.where((F.col("size") >= LEAST_PAYLOAD) & F.col("page_id").isNull()).select("digest", F.lit(True).alias("nameless")).distinct()
        several = groups.join(nameless, "digest", "left").where("c > 1 OR nameless")
        firsts = scratch_.stored(several.select("digest", F.col("first.page_id").alias("first"), F.col("first.url").alias("first_url")), "firsts")
        odd = rows.groupBy("page_id").agg(F.count("*").alias("c")).where("c > 1").limit(1).count()
        nth = F.row_number().over(Window.partitionBy("page_id", "url", "digest").orderBy("size")) - 1 if odd else F.lit(0)
        joined = rows.withColumn("nth", nth).join(sized(firsts, row=FIRST_ROW), "digest", "left")
        revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
        keep = lambda c: F.when(revisit, F.col(c)).alias(c)
        records = joined.select("page_id", "url", F.when(~revisit, F.col("html")).alias("html"), "size", "digest", "nth", keep("first"), keep("first_url"))
        return scratch_.result(records.mapInArrow(_writer(scratch(spark, "warc")), INDEX), "warc-index")


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    stores: dict[str, tuple] = {}

    def fetch(file: str, span: list[tuple[int, int]]) -> pa.RecordBatch:
        folder = file.rpartition("/")[0]
        if folder not in stores:
            stores[folder] = fs.FileSystem.from_uri(folder)
        store, base = stores[folder]
        with store.open_input_file(f"{base}/{file.rpartition('/')[2]}") as f:
            data = f.read_at(span[-1][0] + span[-1][1] - span[0][0], span[0][0])
        return _batch([_parsed(data[a - span[0][0] : a - span[0][0] + n]) for a, n in span], _schema(RECORD))

    file, span = "", []
    for batch in batches:
        for f, a, n in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
            if span and (f != file or a > span[-1][0] + span[-1][1] + GAP_BYTES or a + n - span[0][0] > SPAN_BYTES):
                yield fetch(file, span)
                span = []
            file = f
            if not span or (a, n) != span[-1]:
                span.append((a, n))
    if span:
        yield fetch(file, span)


def read_warc(index: DataFrame) -> DataFrame:
    """The records that ``index`` rows (any selection of them) point to, digests checked.

    Rows are dealt out by file and stretch of file to as many tasks as the bytes that they
    point to need, so one large file is read by many tasks. An empty index gives no records.
    """
    spark = index.sparkSession
    total = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // TASK_BYTES))
    near = F.floor(F.col("offset") / SPAN_BYTES)
    ranges = index.select("file", "offset", "length").repartition(int(tasks), "file", near).sortWithinPartitions("file", "offset")
    return ranges.mapInArrow(_reader, RECORD)


def op8_warc(spark, sf_dir: str) -> DataFrame:
    return read_warc(write_warc(table(spark, sf_dir, "pages"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = f"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= {LEAST_PAYLOAD} GROUP BY 1 HAVING count(*) > 1
)
SELECT page_id, payload_bytes, p.payload_digest,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
