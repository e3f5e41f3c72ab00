"""WARC archives that are written and read by an index.

Every task writes one archive: a file of gzip members, one a record, so that each
record can be read alone. While it writes, it gives an index row a record: archive,
offset, length, URL and payload digest. The index is itself a written table, so
only whole archives of tasks that succeeded are in it, and readers never scan:
they sort the index rows that they want by archive and offset, and read runs of
neighbouring records by one request each.

A page whose payload of at least SMALLEST bytes equals that of a page with a
smaller id is written as a revisit, without its payload.

Cases: a null html is an empty payload. Payloads under SMALLEST bytes are always
responses, equal or not. Pages without an id are responses where no other page has
their payload, else revisits of the smallest id; a group without any id is all
responses. Rows that repeat the smallest id of a group are all responses. A null
url is an empty one. An empty table gives an empty index.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import join_unique
from millrace.session import new_path, ship, staged

SMALLEST = 100
#: One read request fetches at most so many bytes (or one record), over gaps of at most so many.
READ_BYTES, GAP = 4 << 20, 64 << 10
#: Index rows are dealt out to readers by stretches of an archive of so many bytes.
STRETCH = 1 << 20
LEVEL = 6
#: Payloads that occur more than once are sent to all tasks if there are at most so many; else pages meet them in a shuffle.
BROADCAST_ROWS = 200_000
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "page_id long, url string, archive string, offset long, length long, payload_digest string, record_type string"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


#: Schemes of stores that Spark and Arrow name differently.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "gs": "gs", "abfss": "abfss"}


def _uri(root: str) -> str:
    """A path as Spark has it, as a URI for Arrow; both read their credentials from the environment of the cluster."""
    scheme, mark, rest = root.partition("://")
    if not mark:
        scheme, rest = ("file", root.removeprefix("file:")) if not root.startswith("hdfs:/") else ("hdfs", root.removeprefix("hdfs:"))
    return f"{_SCHEMES.get(scheme, scheme)}://{rest}"


def _filesystem(root: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a path and the path in it: local, S3, GCS or Azure by Arrow's own clients, HDFS and others by libhdfs."""
    return pa.fs.FileSystem.from_uri(_uri(root))


def _urn(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page:{page_id}') if page_id is not None else uuid.uuid4()}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record: a response, or a revisit of the page `refers_to`."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_urn(page_id)}",
        f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url or ""),
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join([*lines, "", ""]).encode() + block + b"\r\n\r\n"


def _headers(head: bytes) -> dict[str, str]:
    pairs = (line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return {k.lower(): v for k, v in (p if len(p) == 2 else (p[0].rstrip(":"), "") for p in pairs)}


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    warc = _headers(head)
    http, _, payload = rest[: int(warc["content-length"])].partition(b"\r\n\r\n")
    return warc, _headers(http), payload


def compress(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def decided(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest, and refers_to where the page is to be a revisit."""
    data = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    own = pages.select("page_id", "url", "html", F.sha2(data, 256).alias("digest"), F.octet_length(data).alias("bytes"))
    own = own.withColumn("shared", F.when(F.col("bytes") >= SMALLEST, F.col("digest")))
    groups = own.where(F.col("shared").isNotNull()).groupBy("shared").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    repeated = staged(groups.where(F.col("n") > 1), "repeated")
    if repeated.count() <= BROADCAST_ROWS:  # pages stay where they are
        met = own.join(F.broadcast(repeated.drop("n")), "shared", "left")
    else:
        met = join_unique(own, repeated, "shared", "n", pages.count())
    refers = F.when(~F.coalesce(F.col("page_id") == F.col("first"), F.lit(False)), F.col("first"))
    return met.select("page_id", "url", "html", "digest", refers.alias("refers_to"))


def write(pages: DataFrame, root: str | None = None) -> DataFrame:
    """Writes a record for every page (page_id, url, html) and returns the index, itself a written table."""
    spark = pages.sparkSession
    ship(spark)
    root = root or new_path(spark, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at = None, 0
        try:
            for b in batches:
                rows = []
                for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if out is None:
                        files, folder = _filesystem(root)
                        files.create_dir(folder, recursive=True)
                        name = f"{uuid.uuid4().hex}.warc.gz"  # an attempt's own
                        out = files.open_output_stream(f"{folder}/{name}", compression=None)
                    data = compress(record(page_id, url, (html or "").encode(), digest, refers_to))
                    out.write(data)
                    rows.append((page_id, url, name, at, len(data), digest, "response" if refers_to is None else "revisit"))
                    at += len(data)
                columns = list(zip(*rows, strict=True)) or [()] * len(schema)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
        finally:
            if out is not None:
                out.close()

    schema = pa.schema([
        ("page_id", pa.int64()), ("url", pa.string()), ("archive", pa.string()), ("offset", pa.int64()),
        ("length", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
    ])
    index = decided(pages).select(F.col("page_id").cast("long"), "url", "html", "digest", F.col("refers_to").cast("long")).mapInArrow(run, INDEX)
    return staged(index, "warc-index").withColumn("root", F.lit(root))


def read(index: DataFrame) -> DataFrame:
    """Reads the records of some index rows; each payload is checked against its digest."""
    ship(index.sparkSession)
    wanted = index.select("root", "archive", "offset", "length", "payload_digest")
    stretch = F.floor(F.col("offset") / STRETCH)
    ordered = wanted.repartition("archive", stretch).sortWithinPartitions("root", "archive", "offset")
    schema = pa.schema([
        ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
        ("record_type", pa.string()), ("refers_to", pa.int64()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        handle, opened = None, None
        waiting: list[tuple[str, str, int, int, str]] = []

        def fetch() -> pa.RecordBatch:
            nonlocal handle, opened
            root, archive, start, _, _ = waiting[0]
            if opened != (root, archive):
                if handle is not None:
                    handle.close()
                files, folder = _filesystem(root)
                handle, opened = files.open_input_file(f"{folder}/{archive}"), (root, archive)
            data = memoryview(handle.read_at(waiting[-1][2] + waiting[-1][3] - start, start))
            rows = []
            for _, _, offset, length, digest in waiting:
                warc, http, payload = parse(zlib.decompress(data[offset - start : offset - start + length], 31))
                kind, said = warc["warc-type"], warc["warc-payload-digest"].removeprefix("sha256:")
                if said != digest or kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"{archive} at {offset}: the payload does not have the digest of the index")
                size = len(payload) if kind == "response" else int(http["content-length"])
                page, refers = warc.get("x-page-id"), warc.get("x-refers-to-page-id")
                rows.append((page and int(page), size, said, kind, refers and int(refers)))
            waiting.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if waiting:
                    end = waiting[-1][2] + waiting[-1][3]
                    if row[:2] != waiting[0][:2] or row[2] > end + GAP or row[2] + row[3] - waiting[0][2] > READ_BYTES:
                        yield fetch()
                waiting.append(row)
        if waiting:
            yield fetch()
        if handle is not None:
            handle.close()

    return ordered.mapInArrow(run, READ)
