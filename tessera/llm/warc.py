"""WARC archives: write request, response (or revisit) and metadata records, read them back, assemble transactions.

Writing. Each page becomes three WARC/1.1 records that name one another by WARC-Concurrent-To. Pages with equal payloads
share a SHA-1 digest; the one with the largest id is the response and the others are revisits that refer to it and carry
no payload. Digests are decided on (id, digest) rows alone: a payload that a third of all pages share costs narrow rows,
combined map-side. The narrow rows of the revisits are the build side of a hash join, so pages move once and are not sorted.

Files. A task builds one record at a time and gathers records to chunks of about ``chunk_bytes``; Spark's text writer
writes the chunks, ``file_chunks`` to a file, in whatever store the folder is in. By default each record is a gzip member
of its own, as readers with an index need. The writer ends each row with a separator, which must be part of the file: a
gzip member ends with the high byte of its length, zero below 16 MB, so that byte is the separator (a longer record is
followed by an empty member, which ends alike). Plain files use the record separator, two CRLF.

Reading. Files (bounded in bytes) are read as streams, record by record. Records are joined to their transaction by
following concurrent-to identifiers, and a revisit takes payload length from the response that it refers to. Both joins
move headers only, not payloads, unless ``with_payload`` is asked for.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, small

END = "\r\n\r\n"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a string's UTF-8 bytes: 20 bits, so 5 hex digits, make 4 base32 digits."""
    h = F.sha1(payload.cast("binary"))
    chunks = [F.lpad(F.conv(F.substring(h, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*chunks), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def roles(pages: DataFrame, id_col: str, digest: Column, least_bytes: int, size: Column) -> DataFrame:
    """(id, digest, size, refers_to): refers_to is null for responses. Payloads below ``least_bytes`` are all responses."""
    d = pages.select(F.col(id_col).alias("id"), digest.alias("digest"), size.alias("size"))
    last = d.groupBy("digest").agg(F.max("id").alias("last"))
    refers = F.when((F.col("size") >= least_bytes) & (F.coalesce("id", F.lit(-(1 << 63))) < F.col("last")), F.col("last"))
    return d.join(last, "digest").select("id", "digest", "size", refers.alias("refers_to"))


def _uuid(kind: str, page: int | None, copy: int) -> str:
    h = hashlib.md5(f"{kind}:{page}:{copy}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def _record(kind: str, rid: str, fields: dict[str, str | None], block: bytes) -> bytes:
    """A record with its end mark. Null fields are left out."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {rid}", "WARC-Date: 1970-01-01T00:00:00Z"]
    lines += [f"{k}: {v}" for k, v in fields.items() if v is not None] + [f"Content-Length: {len(block)}"]
    return b"".join(("\r\n".join(lines).encode(), END.encode(), block, END.encode()))


def _records(page: int | None, url: str | None, html: bytes, digest: str, refers_to: int | None, copy: int) -> Iterator[bytes]:
    """The request, the response or revisit and the metadata of one page."""
    req, res, meta = (_uuid(k, page, copy) for k in ("request", "response", "metadata"))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}{END}".encode()
    yield _record("request", req, {"WARC-Target-URI": url, "WARC-Concurrent-To": res, "Content-Type": "application/http; msgtype=request"}, f"GET {'/' if url is None else url} HTTP/1.1{END}".encode())
    common = {"WARC-Target-URI": url, "WARC-Payload-Digest": "sha1:" + digest, "WARC-Concurrent-To": req, "Content-Type": "application/http; msgtype=response", "X-Page-ID": None if page is None else str(page)}
    if refers_to is None:
        yield _record("response", res, common, http + html)
    else:
        yield _record("revisit", res, common | {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"page:{refers_to}"}, http)
    yield _record("metadata", meta, {"WARC-Target-URI": url, "WARC-Concurrent-To": res, "Content-Type": "application/warc-fields"}, f"page-id: {'' if page is None else page}\r\n".encode())


def _member(record: bytes) -> bytes:
    """A gzip member whose last byte is zero."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = z.compress(record) + z.flush()
    return out if out[-1] == 0 else out + _member(b"")


def _chunks(chunk_bytes: int, zipped: bool):
    """Rows of records, each without the separator that the writer adds."""
    end = 1 if zipped else len(END)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0
        out = lambda: pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-end]], pa.binary())], ["value"])
        for b in small(batches):
            for k in range(b.num_rows):
                page, url, html, refers_to, copy = (b.column(i)[k].as_py() for i in range(5))
                raw = html.encode("utf-8", "surrogatepass")
                digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
                for r in _records(page, url, raw, digest, refers_to, copy):
                    held.append(_member(r) if zipped else r)
                    size += len(held[-1])
                    if size >= chunk_bytes:
                        yield out()
                        held, size = [], 0
        if held:
            yield out()

    return run


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, chunk_bytes: int = 1 << 20, file_chunks: int = 32, compression: str | None = "gzip") -> None:
    """Write ``pages`` to WARC files under ``path``: ``file_chunks`` chunks of ``chunk_bytes`` or one longer record each.

    Null payloads are empty ones; a null url leaves the field out; line breaks in a url are percent-encoded. Of rows
    with equal payloads those with the largest id are responses (more than one if that row is repeated). A row with a
    null id is a revisit if its payload has a row with an id, else a response. ``compression="gzip"`` writes a member a
    record; None writes plain files.
    """
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    url = F.replace(F.replace(F.col(url_col).cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    p = pages.select(F.col(id_col).cast("long").alias("id"), url.alias("url"), html.alias("html"))
    role = roles(p, "id", base32_sha1(F.col("html")), least_bytes, F.octet_length("html").cast("long"))
    # One row for each (id, digest) of a revisit, so that repeated rows meet it once each.
    again = role.where("refers_to is not null").select(F.col("id").alias("rid"), F.col("digest").alias("rdigest"), "refers_to").distinct()
    p = p.withColumn("digest", base32_sha1(F.col("html")))
    p = p.join(again.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("rid")) & (F.col("digest") == F.col("rdigest")), "left")
    # The copy number tells repeated rows' records apart; it is fixed once written.
    p = p.select("id", "url", "html", "refers_to", F.monotonically_increasing_id().alias("copy"))
    rows = p.mapInArrow(_chunks(chunk_bytes, compression == "gzip"), "value binary").select(F.col("value").cast("string"))
    rows.write.option("lineSep", "\0" if compression == "gzip" else END).option("maxRecordsPerFile", file_chunks).option("compression", "none").text(path)


_RECORD = "type string, record_id string, concurrent_to string, url string, page_id long, digest string, refers_to string, block_bytes long, payload_bytes long, payload_sha1 string, fields string, payload string"


def open_warc(data: bytes) -> BinaryIO:
    """A stream over the records of a plain file, or of one in gzip members."""
    raw = io.BytesIO(data)
    return gzip.GzipFile(fileobj=raw) if data[:2] == b"\x1f\x8b" else raw


def parse_warc(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields with lower-case names, block) of each record."""
    while line := stream.readline():
        if line == b"\r\n":
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {line[:40]!r}")
        fields = {}
        while head := stream.readline().removesuffix(b"\r\n"):
            k, _, v = head.decode("utf-8", "surrogateescape").partition(":")
            fields[k.strip().lower()] = v.strip()
        size = int(fields["content-length"])
        block = stream.read(size)
        if len(block) < size:
            raise ValueError("a record is cut off")
        yield fields, block


def read_records(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row per WARC record of the files under ``path``, files dealt out over the tasks."""
    kinds = [pa.int64() if x.endswith(" long") else pa.string() for x in _RECORD.split(", ")]
    names = [x.split()[0] for x in _RECORD.split(", ")]

    def row(f: dict[str, str], block: bytes) -> tuple:
        http = f.get("content-type", "").startswith("application/http") and f["warc-type"] == "response"
        payload = block.partition(b"\r\n\r\n")[2] if http else b""
        page = f.get("x-page-id")
        own = base64.b32encode(hashlib.sha1(payload).digest()).decode() if http else None
        return (f["warc-type"], f["warc-record-id"], f.get("warc-concurrent-to"), f.get("warc-target-uri"), int(page) if page else None, f.get("warc-payload-digest", "").removeprefix("sha1:") or None, f.get("warc-refers-to"), len(block), len(payload) if http else None, own, block.decode("utf-8", "surrogateescape").strip() if f["warc-type"] == "metadata" else None, payload.decode("utf-8", "replace") if with_payload and http else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        for b in small(batches, 1):
            rows, size = [], 0
            for f, block in parse_warc(open_warc(b.column(0)[0].as_py())):
                rows.append(row(f, block))
                size += len(block) if with_payload else 500
                if size > 4 << 20:
                    yield pack(rows)
                    rows, size = [], 0
            if rows:
                yield pack(rows)

    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "part-*").load(path)
    return files.where("length > 0").select("content").mapInArrow(run, _RECORD)


def transactions(records: DataFrame) -> DataFrame:
    """One nested row per capture: request, response or revisit, and metadata, joined by concurrent-to identifiers.

    Every record votes for the identifier of its capture: a response or revisit for its own, the others for the one they
    are concurrent to. A capture that lacks a record has null there; a response whose request names it is found through
    the request. Payload figures of a revisit come from the response with the same page in refers_to.
    """
    is_main = F.col("type").isin("response", "revisit")
    capture = F.when(is_main, F.col("record_id")).otherwise(F.col("concurrent_to"))
    main = F.struct("record_id", "type", "url", "page_id", "digest", "refers_to", "payload_bytes", "payload_sha1", "payload")
    side = F.struct("record_id", "url", "block_bytes", "fields")
    t = records.withColumn("capture", capture).groupBy("capture").agg(
        F.max(F.when(is_main, main)).alias("response"),
        F.max(F.when(F.col("type") == "request", side)).alias("request"),
        F.max(F.when(F.col("type") == "metadata", side)).alias("metadata"),
    )
    # A revisit names its page and digest; one narrow row for each pair resolves it.
    known = t.where("response.type = 'response'").groupBy(F.concat(F.lit("page:"), F.col("response.page_id").cast("string")).alias("k"), F.col("response.digest").alias("kd")).agg(F.max("response.payload_bytes").alias("first_bytes"), F.max("response.payload_sha1").alias("first_sha1"))
    t = t.join(known, (F.col("response.refers_to") == F.col("k")) & (F.col("response.digest") == F.col("kd")), "left")
    return t.select(
        "capture", "request", "response", "metadata",
        F.coalesce("response.payload_bytes", "first_bytes").alias("payload_bytes"),
        F.coalesce("response.payload_sha1", "first_sha1").alias("payload_digest"),
    )


def op7_warc_round_trip(spark, sf_dir: str) -> DataFrame:
    """Every page written to WARC files in the shared folder and read back."""
    path = new_path(spark, "warc")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    write_warc(pages, path)
    t = transactions(read_records(spark, path))
    return t.select(
        F.col("response.page_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("response.type").alias("record_type"),
        F.substring(F.col("response.refers_to"), 6, 30).cast("long").alias("refers_to"),
    )


QUERIES = {"op7_warc_round_trip": op7_warc_round_trip}
#: Digests from SHA-1 in hex: five hex digits make four base32 digits.
ORACLE_SQL = {
    "op7_warc_round_trip": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
d AS (
  SELECT page_id, octet_length(encode(h)) AS n, list_aggregate(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(x, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) + 1 AS BIGINT), 1)), 'string_agg', '') AS digest
  FROM p
), m AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS last FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to
FROM m
"""
}
