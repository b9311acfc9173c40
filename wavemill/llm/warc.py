"""WARC archives: one gzip member per record, written and read in sequence.

Archives are byte streams kept as a table of segments (archive, segment, data): a segment holds whole
gzip members, and the segments of an archive, joined in order, are a .warc.gz file. Any store that
Spark writes to can hold them, segments are read in parallel, and memory is bounded by a segment.
``read_archives`` also takes whole .warc.gz files through Spark's binaryFile source.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

SEGMENT_BYTES, MIN_REVISIT, STEP = 4 << 20, 1000, 1 << 16
RECORD = "record_type string, record_id string, target_uri string, refers_to string, payload_bytes long, payload_digest string, digest_ok boolean, payload binary"


def _named(page_id) -> str:
    return f"urn:page:{page_id}"


def write_record(kind: str, record_id: str, uri: str, payload: bytes, digest: str, refers_to: str | None = None, level: int = 6) -> bytes:
    """One record as a gzip member. A revisit keeps the HTTP head, whose Content-Length tells its payload's size, but no payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if kind == "revisit" else head + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {uri}",
        "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}",
    ]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{refers_to}>"]
    lines.append(f"Content-Length: {len(block)}")
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def members(data: bytes):
    """The plain bytes of each gzip member in turn, inflated in steps of bounded size."""
    view, at = memoryview(data), 0
    while at < len(view):
        z, out = zlib.decompressobj(31), []
        while not z.eof:
            step = view[at : at + STEP]
            if not len(step):
                raise ValueError("the archive ends within a record")
            out.append(z.decompress(step))
            at += len(step) - len(z.unused_data)
        yield b"".join(out)


def parse_record(plain: bytes) -> dict:
    """Frames one record by its Content-Length and verifies both digests."""
    head, sep, rest = plain.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not sep or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    field = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = int(field["content-length"])
    if len(rest) < size or rest[size:].strip(b"\r\n"):
        raise ValueError("the record's length doesn't match its Content-Length")
    block = rest[:size]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next((int(v) for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")[1:]) if k.strip().lower() == b"content-length"), len(payload))
    kind, digest = field["warc-type"], field.get("warc-payload-digest", "").partition(":")[2]
    ok = field.get("warc-block-digest", "").partition(":")[2] in ("", hashlib.sha1(block).hexdigest())
    if kind == "response":
        ok = ok and len(payload) == length and digest == hashlib.sha1(payload).hexdigest()
    return {
        "record_type": kind, "record_id": field["warc-record-id"].strip("<>"), "target_uri": field.get("warc-target-uri"), "refers_to": field["warc-refers-to"].strip("<>") if "warc-refers-to" in field else None,
        "payload_bytes": length, "payload_digest": digest, "digest_ok": ok, "payload": payload if kind == "response" else None,
    }


def with_revisits(pages: DataFrame, page_id: str, payload: str, minimum: int) -> DataFrame:
    """Adds _first: the page whose response a page revisits, or null. Payloads meet only as digests; a common one is reduced to its largest id before any join."""
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    named = pages.withColumns({"_digest": F.sha1(body), "_n": F.length(body)})
    light = named.select(F.col(page_id).alias("_id"), "_digest", "_n").where(F.col("_n") >= minimum)
    most = light.groupBy("_digest", "_n").agg(F.max("_id").alias("_first"), F.min("_id").alias("_low")).where("_low < _first").drop("_low")
    again = light.join(most, ["_digest", "_n"]).where("_id < _first").groupBy("_id", "_digest", "_n").agg(F.max("_first").alias("_first"))
    # By payload too: a repeated id may have several.
    return named.withColumn("_id", F.col(page_id)).join(again, ["_id", "_digest", "_n"], "left").drop("_id", "_digest", "_n")


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", payload: str = "html", *, minimum: int = MIN_REVISIT, segment_bytes: int = SEGMENT_BYTES, level: int = 6) -> None:
    """Writes a record per row of pages to a table of segments at ``path``.

    A null payload is empty; a null url is an empty target. Among equal payloads of ``minimum`` bytes or
    more the largest id is the response and others revisit it. Repeated rows are written each (a
    repeated id's records share a record id). Rows without an id are responses. Other columns are ignored.
    """

    def run(batches):
        held, size, archive, n = [], 0, uuid.uuid4().hex, 0
        schema = pa.schema([("archive", pa.string()), ("segment", pa.int64()), ("data", pa.binary())])
        for batch in batches:
            for key, uri, body, first in zip(*(batch.column(i) for i in range(4)), strict=True):
                body = body.as_py() or b""
                one = write_record("response" if first.as_py() is None else "revisit", _named(key.as_py()), (uri.as_py() or "").replace("\r", "%0D").replace("\n", "%0A"), body, hashlib.sha1(body).hexdigest(), None if first.as_py() is None else _named(first.as_py()), level)
                held.append(one)
                size += len(one)
                if size >= segment_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([archive]), pa.array([n]), pa.array([b"".join(held)], pa.binary())], schema=schema)
                    held, size, n = [], 0, n + 1
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([archive]), pa.array([n]), pa.array([b"".join(held)], pa.binary())], schema=schema)

    rows = with_revisits(pages.select(F.col(page_id), F.col(url), F.col(payload)), page_id, payload, minimum)
    rows = rows.select(F.col(page_id).cast("string"), url, F.col(payload).cast("binary"), F.col("_first").cast("string"))
    rows.mapInArrow(run, "archive string, segment long, data binary").write.option("compression", "none").parquet(path)


def read_archives(segments: DataFrame, data: str = "data", keep_payload: bool = True) -> DataFrame:
    """A row per record (see RECORD) of segments or whole files; a broken record raises."""
    spec = RECORD if keep_payload else RECORD.replace(", payload binary", "")
    names = [x.split()[0] for x in spec.split(", ")]
    kinds = {"payload_bytes": pa.int64(), "digest_ok": pa.bool_(), "payload": pa.binary()}
    schema = pa.schema([(n, kinds.get(n, pa.string())) for n in names])

    def run(batches):
        for batch in batches:
            for cell in batch.column(0):
                rows, size = [], 0
                for plain in members(cell.as_py() or b""):
                    one = parse_record(plain)
                    rows.append({n: one[n] for n in names})
                    size += len(plain)
                    if size >= SEGMENT_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return segments.select(data).mapInArrow(run, spec)


def read_files(spark: SparkSession, path: str, keep_payload: bool = True) -> DataFrame:
    """Records of .warc.gz files."""
    return read_archives(spark.read.format("binaryFile").load(path), "content", keep_payload)
