"""WARC archives: transactions written as linked records, read back and joined again (operator 8).

Every page is one capture: a request record, a response or revisit record and a metadata record. The request and the metadata
record name the response's record in WARC-Concurrent-To; the reader joins the three by that identifier and emits one nested row
per capture. Each record is a gzip member of its own.

Of captures whose payloads are equal and at least MIN_PAYLOAD bytes long, those with the largest page_id are written in full;
the others are revisits, which carry the HTTP header (with Content-Length), the payload's digest and the page they refer to, but
no payload. Duplicates are found from (page_id, digest) alone, with a map-side combined maximum; pages join the few revisits by
both, so a payload that a third of all pages share makes no hot key for the page bodies.

Cases: null html is an empty payload; null urls are written as about:blank and read back as null; a null page_id is always a response;
repeated rows are captures of their own, rows of one page_id with different payloads are told apart by digest, and rows that share the largest page_id are all responses. An empty table gives no
file. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, read_file, read_table, work_folder, write_file

MIN_PAYLOAD = 1000
FILE_BYTES = 32 << 20
#: a member is inflated in pieces, so that what follows it isn't copied
PIECE = 1 << 15
DATE = "2024-01-01T00:00:00Z"

RECORD_SCHEMA = "record_id string, kind string, concurrent_to string, page_id long, url string, payload_bytes long, payload_digest string, refers_to long"
_HEADER = re.compile(rb"([!-9;-~]+):[ \t]*([^\r\n]*)\r\n")


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One WARC/1.1 record as a gzip member."""
    lines = [f"WARC-Type: {kind}", f"WARC-Date: {DATE}", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    c = zlib.compressobj(1, zlib.DEFLATED, 31)
    return c.compress(b"WARC/1.1\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + c.flush()


def _one_line(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def capture(page_id, url, payload: bytes, refers_to) -> bytes:
    """The records of one page."""
    own = f"<urn:uuid:{uuid.uuid4()}>"
    target = [("WARC-Target-URI", _one_line(url) if url is not None else "about:blank")]
    page = [] if page_id is None else [("X-Page-Id", str(page_id))]
    digest = hashlib.sha1(payload).hexdigest()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = [("WARC-Record-ID", own), *target, *page, ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if refers_to is None:
        main = record("response", head, http + payload)
    else:
        main = record("revisit", [*head, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page", str(refers_to))], http)
    side = lambda: [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Concurrent-To", own), *target, *page]
    ask = record("request", [*side(), ("Content-Type", "application/http; msgtype=request")], b"GET / HTTP/1.1\r\nUser-Agent: archive\r\n\r\n")
    meta = record("metadata", [*side(), ("Content-Type", "application/warc-fields")], b"fetchTimeMs: 0\r\n")
    return ask + main + meta


def parse(raw: bytes):
    """Yields (headers, block) of every record of a file of gzip members."""
    view = memoryview(raw)
    at = 0
    while at < len(raw):
        d = zlib.decompressobj(31)
        parts = []
        while not d.eof:
            if at >= len(raw):
                raise ValueError("truncated record")
            parts.append(d.decompress(view[at : at + PIECE]))
            at += min(PIECE, len(raw) - at)
        at -= len(d.unused_data)
        text = b"".join(parts)
        end = text.index(b"\r\n\r\n")
        if not text.startswith(b"WARC/"):
            raise ValueError("no WARC record")
        headers = {k.decode().lower(): v.decode() for k, v in _HEADER.findall(text[text.index(b"\n") + 1 : end + 2])}
        n = int(headers["content-length"])
        block = text[end + 4 : end + 4 + n]
        if len(block) != n:
            raise ValueError("short record")
        yield headers, block


def find_revisits(pages: DataFrame) -> DataFrame:
    """page_id, digest, refers_to of the payloads that another page with a larger page_id holds too."""
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    small = pages.where(F.col("page_id").isNotNull() & (F.octet_length(body) >= MIN_PAYLOAD)).select("page_id", F.sha1(body).alias("digest"))
    small = cut(small, "op8-digests")
    keep = small.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least")).where("least < refers_to")
    return small.join(keep.select("digest", "refers_to"), "digest").where("page_id < refers_to").select("page_id", "digest", "refers_to").distinct()


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes all pages (page_id, url, html); returns the manifest (file, captures)."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    revisits = cut(find_revisits(pages), "op8-revisits")

    joined = pages.withColumn("digest", F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary"))).join(revisits, ["page_id", "digest"], "left")

    def run(batches):
        out, have, captures = [], 0, 0
        names, counts = [], []

        def flush():
            nonlocal out, have, captures
            if out:
                names.append(write_file(folder, "capture.warc.gz", b"".join(out)))
                counts.append(captures)
            out, have, captures = [], 0, 0

        for b in batches:
            for page_id, url, html, refers_to in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to"))):
                out.append(capture(page_id, url, (html or "").encode(), refers_to))
                have += len(out[-1])
                captures += 1
                if have >= FILE_BYTES:
                    flush()
        flush()
        yield pa.RecordBatch.from_pydict({"file": pa.array(names, pa.string()), "captures": pa.array(counts, pa.int64())})

    return cut(joined.select("page_id", "url", "html", "refers_to").mapInArrow(run, "file string, captures long"), "op8-manifest")


def read_records(manifest: DataFrame, files: int, with_payload: bool = False) -> DataFrame:
    """One row per record of the listed files; payload length and digest are of the payload as read, or as a revisit states."""

    def run(batches):
        for b in batches:
            for name in b.column("file").to_pylist():
                rows = []
                for h, block in parse(read_file(name)):
                    kind = h["warc-type"]
                    url = h.get("warc-target-uri")
                    size = digest = payload = None
                    if kind in ("response", "revisit"):
                        split = block.index(b"\r\n\r\n")
                        http = {k.decode().lower(): v.decode() for k, v in _HEADER.findall(block[block.index(b"\n") + 1 : split + 2])}
                        stated = h["warc-payload-digest"].removeprefix("sha1:")
                        if kind == "response":
                            payload = block[split + 4 :]
                            size, digest = len(payload), hashlib.sha1(payload).hexdigest()
                            if digest != stated:
                                raise ValueError(f"{name}: a payload doesn't match its digest")
                        else:
                            size, digest = int(http["content-length"]), stated
                    page, refers = h.get("x-page-id"), h.get("x-refers-to-page")
                    rows.append((h["warc-record-id"], kind, h.get("warc-concurrent-to"), page and int(page), None if url == "about:blank" else url, size, digest, refers and int(refers), payload if with_payload else None))
                    if len(rows) >= 2000:
                        yield _batch(rows, with_payload)
                        rows = []
                yield _batch(rows, with_payload)

    return manifest.select("file").repartition(max(1, min(files, 10_000)), "file").mapInArrow(run, RECORD_SCHEMA + ", payload binary" * with_payload)


def _batch(rows: list[tuple], with_payload: bool) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    names = ["record_id", "kind", "concurrent_to", "page_id", "url", "payload_bytes", "payload_digest", "refers_to", "payload"]
    n = len(names) - (not with_payload)
    cols = list(zip(*rows)) if rows else [()] * 9
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols[:n], kinds[:n])], names[:n])


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: capture_id, request, response (or revisit) and metadata as structs; null where a record is missing."""
    whole = F.struct(*records.columns)
    one = lambda *kinds: F.min(F.when(F.col("kind").isin(*kinds), whole))
    return records.groupBy(F.coalesce("concurrent_to", "record_id").alias("capture_id")).agg(one("request").alias("request"), one("response", "revisit").alias("response"), one("metadata").alias("metadata"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_archives(read_table(spark, sf_dir, "pages", "page_id", "url", "html"), work_folder(spark, "op8-archives"))
    r = F.col("response")
    captures = assemble(read_records(manifest, manifest.count())).where(F.col("request").isNotNull() & F.col("metadata").isNotNull())
    return captures.select(*(r[c].alias(c) for c in ("page_id", "payload_bytes", "payload_digest")), r["kind"].alias("record_type"), r["refers_to"].alias("refers_to"))


OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS payload_digest FROM p),
k AS (SELECT payload_digest AS digest, max(page_id) AS keep FROM d WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT d.page_id, CAST(d.payload_bytes AS BIGINT) AS payload_bytes, d.payload_digest,
  CASE WHEN d.page_id < k.keep THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN d.page_id < k.keep THEN k.keep END AS refers_to
FROM d LEFT JOIN k ON d.payload_bytes >= 1000 AND d.payload_digest = k.digest
"""
