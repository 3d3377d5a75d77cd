"""WARC archives: captures written as transactions of records, read again and assembled.

A capture is a request, a response (or a revisit of an equal payload's response) and a metadata record; request and
metadata name the response in WARC-Concurrent-To. Reading takes records in any order from any files and joins
them through those identifiers into one nested row for each capture.
"""

from __future__ import annotations

import gzip
import hashlib
import io

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftframe.llm.shared import read, saved, table_path
from driftframe.sources.session import small_batches

#: Equal payloads of so many bytes or more are stored once; a file has about so many bytes before compression.
LEAST_REVISIT, FILE_BYTES = 100, 32 << 20
#: Records leave the reader in batches of at most so many, or about so many bytes of payload.
OUT_RECORDS, OUT_BYTES = 2000, 16 << 20
#: Archive files that go to Python at once, and about how many compressed bytes of them.
FILES, READ_BYTES = 8, 16 << 20
DATE = "2000-01-01T00:00:00Z"
_END, _PROFILE = "\r\n\r\n", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record_id(kind: str, page_id: Column, url: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws("|", F.lit(kind), F.coalesce(page_id.cast("string"), F.lit("-")), F.coalesce(url, F.lit("-")), digest))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _record(kind: Column | str, record_id: Column, content_type: str, block: Column, **headers: Column) -> Column:
    """One record without its closing line ends; headers that are null are left out."""
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.lit(kind) if isinstance(kind, str) else kind), F.concat(F.lit("WARC-Record-ID: "), record_id), F.lit(f"WARC-Date: {DATE}")]
    lines += [F.concat(F.lit(name.replace("_", "-") + ": "), value) for name, value in headers.items()]
    lines += [F.lit(f"Content-Type: {content_type}"), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(_END), block)


def write_warc(pages: DataFrame, path: str, least_revisit: int = LEAST_REVISIT, file_bytes: int = FILE_BYTES) -> None:
    """Writes gzip-compressed WARC files to the folder path, three records for each row of pages (page_id, url, html, ...).

    The payload is the html in UTF-8, null as empty. Of equal payloads of least_revisit bytes or more, the rows with the
    smallest page_id hold it; others are revisits. Null page_ids come last. Line ends in a url are percent-encoded; a null
    url has no header. Rows equal in all three columns make equal records. A revisit also names the page_id it refers to.
    A file ends after as many records as have file_bytes bytes on average. Other columns are not looked at.
    """
    url = F.regexp_replace(F.regexp_replace(F.col("url").cast("string"), "\r", "%0D"), "\n", "%0A")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumns({"size": F.octet_length("payload").cast("long"), "digest": F.sha2("payload", 256)})
    sizes = saved(rows.select("page_id", "url", "size", "digest"), "sizes")
    shape = sizes.agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).first()
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", F.col("url").isNotNull().alias("has"), "url"))
    copies = sizes.where(F.col("size") >= least_revisit).groupBy("digest").agg(first.alias("first"), F.count("*").alias("n")).where("n > 1")
    copies = saved(copies.select("digest", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url")), "copies")
    # both sides are plain scans, so that a digest of very many rows can be split between tasks
    rows = rows.join(copies.withColumn("copied", F.lit(True)), "digest", "left")
    revisit = F.col("copied").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    kind = F.when(revisit, "revisit").otherwise("response")
    own = _record_id("response", F.col("page_id"), F.col("url"), F.col("digest"))
    host = F.regexp_extract(F.coalesce("url", F.lit("")), r"://([^/?#]*)", 1)
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(_END), F.when(revisit, "").otherwise(F.col("payload")))
    refers = F.when(revisit, _record_id("response", F.col("first_id"), F.col("first_url"), F.col("digest")))
    response = _record(
        kind, own, "application/http; msgtype=response", http,
        WARC_Target_URI=F.col("url"), WARC_Payload_Digest=F.concat(F.lit("sha256:"), F.col("digest")), WARC_Profile=F.when(revisit, _PROFILE), WARC_Refers_To=refers,
        WARC_Refers_To_Page=F.when(revisit, F.col("first_id").cast("string")),
    )
    ask = F.concat(F.lit("GET "), F.coalesce("url", F.lit("/")), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(_END))
    request = _record("request", _record_id("request", F.col("page_id"), F.col("url"), F.col("digest")), "application/http; msgtype=request", ask, WARC_Target_URI=F.col("url"), WARC_Concurrent_To=own)
    fields = F.concat(F.lit("pageId: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("\r\n"))
    metadata = _record("metadata", _record_id("metadata", F.col("page_id"), F.col("url"), F.col("digest")), "application/warc-fields", fields, WARC_Target_URI=F.col("url"), WARC_Concurrent_To=own)
    # the text writer ends every row with the separator, which is what ends a WARC record
    records = rows.select(F.explode(F.array(request, response, metadata)).alias("value"))
    per_file = max(3, 3 * int(file_bytes // (1500 + (shape["bytes"] or 0) / max(shape["n"], 1))))  # headers of a page's three records take about 1500 bytes
    records.write.option("lineSep", _END).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def parse_records(stream):
    """(headers, block) of each record of an uncompressed archive, read from a file object one after the other; header names in lower case."""
    while line := stream.readline():
        if not line.strip():
            continue  # the line ends after a record
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at {line[:40]!r}")
        headers = {}
        while (line := stream.readline()).strip():
            name, _, value = line.partition(b":")
            headers[name.strip().lower().decode()] = value.strip().decode("utf-8", "replace")
        size = int(headers["content-length"])
        block = stream.read(size)
        if len(block) < size:
            raise ValueError(f"record {headers.get('warc-record-id')} is cut: {len(block)} of {size} bytes")
        yield headers, block


_RECORD = pa.schema([(n, pa.string()) for n in ("record_id", "record_type", "concurrent_to", "refers_to", "refers_to_page", "url", "fields")] + [("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])


def _row(name: str, h: dict, block: bytes, payload: bool) -> tuple:
    kind, size, digest, body, fields = h["warc-type"], None, None, None, None
    if kind in ("response", "revisit"):
        head, _, body = block.partition(b"\r\n\r\n")
        stated = h.get("warc-payload-digest", "").removeprefix("sha256:")
        if kind == "revisit":
            digest, size = stated, next((int(x.partition(b":")[2]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
        else:
            size, digest = len(body), hashlib.sha256(body).hexdigest()
            if stated and stated != digest:
                raise ValueError(f"payload of {h['warc-record-id']} in {name} does not match its digest")
    elif kind == "metadata":
        fields = block.decode("utf-8", "replace")
    return h["warc-record-id"], kind, h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-refers-to-page"), h.get("warc-target-uri"), fields, size, digest, body if payload and kind == "response" else None


def read_records(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """One row for each record: record_id, record_type, concurrent_to, refers_to, refers_to_page, url, fields, payload_bytes, payload_digest, payload.

    payload_bytes and payload_digest are those of the whole payload: counted from the bytes themselves for a response, as its
    headers state them for a revisit. fields is the text of metadata. A response whose bytes do not give its digest fails. Files may be
    compressed, as one gzip member or several, and are decompressed record by record.
    """

    def run(batches):
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                raw, out, held = io.BytesIO(content), [], 0
                for h, block in parse_records(gzip.GzipFile(fileobj=raw) if content[:2] == b"\x1f\x8b" else raw):
                    out.append(_row(name, h, block, payload))
                    held += len(out[-1][-1] or b"")
                    if len(out) >= OUT_RECORDS or held >= OUT_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _RECORD.types)], schema=_RECORD)
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _RECORD.types)], schema=_RECORD)

    files = small_batches(spark.read.format("binaryFile").load(path).select("path", "content"), FILES, READ_BYTES)
    return files.mapInArrow(run, "record_id string, record_type string, concurrent_to string, refers_to string, refers_to_page string, url string, fields string, payload_bytes long, payload_digest string, payload binary")


def assembled(records: DataFrame, resolve: bool = True) -> DataFrame:
    """One row for each capture: capture_id, response, request, metadata (structs) and, with resolve, referred: the metadata of the response revisited.

    Requests and metadata without a response or revisit are left out; a capture without them has nulls there. Records
    written more than once give the capture as often.
    """
    records = records.withColumn("capture_id", F.coalesce("concurrent_to", "record_id"))
    answer = F.col("record_type").isin("response", "revisit")
    response = F.struct("record_type", "url", "payload_bytes", "payload_digest", "refers_to", "refers_to_page", "payload")
    joined = records.groupBy("capture_id").agg(
        F.count_if(answer).alias("n"), F.first(F.when(answer, response), ignorenulls=True).alias("response"),
        F.first(F.when(F.col("record_type") == "request", F.struct("record_id", "url")), ignorenulls=True).alias("request"),
        F.first(F.when(F.col("record_type") == "metadata", F.struct("record_id", "fields")), ignorenulls=True).alias("metadata"),
    )
    captures = joined.where("n > 0")
    if resolve:
        # joined from a table, so that a response of very many revisits can be split between tasks
        captures = saved(captures, "captures")
        originals = captures.where("response.record_type = 'response'").select(F.col("capture_id").alias("original"), F.col("metadata").alias("referred"))
        captures = captures.join(originals, F.col("response.refers_to") == F.col("original"), "left")
    copies = captures.withColumn("copy", F.explode(F.sequence(F.lit(1), "n")))
    return copies.select("capture_id", "response", "request", "metadata", *(["referred"] if resolve else []))


def page_id_of(metadata: str) -> Column:
    return F.expr(f"try_cast(nullif(regexp_extract({metadata}.fields, 'pageId: ([^\\r\\n]*)', 1), '') as long)")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives, read again and assembled."""
    path = table_path(spark, "warc")
    write_warc(read(spark, sf_dir, "pages"), path)
    found, response = assembled(read_records(spark, path, payload=False), resolve=False), F.col("response")
    return found.select(
        page_id_of("metadata").alias("page_id"), response["payload_bytes"].alias("payload_bytes"), response["payload_digest"].alias("payload_digest"),
        response["record_type"].alias("record_type"), response["refers_to_page"].cast("long").alias("refers_to"), response["url"].alias("url"),
    )


OP8_SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages
), d AS (SELECT page_id, url, strlen(html) AS n, sha256(html) AS digest FROM p
), f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS least FROM d)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 100 AND page_id IS DISTINCT FROM least THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id IS DISTINCT FROM least THEN least END AS refers_to, replace(replace(url, chr(13), '%0D'), chr(10), '%0A') AS url
FROM f
"""
