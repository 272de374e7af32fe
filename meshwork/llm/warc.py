"""WARC archives: writing pages as records with segments, reading them back with segment reassembly.

A payload longer than `segment_bytes` is spread over a first record and continuation records that name it as their
origin. The reader groups segments by origin, orders them by number, verifies the total length and decodes chunked
transfer framing. Archives lie in the folder that all executors share; a write task gives its files fresh names and
only files in the written manifest count, so a repeated task leaves nothing behind that is read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.llm.common import map_batches, materialize, shared_dir

DATE = "2024-01-01T00:00:00Z"
#: Hot digests up to which every executor is told them all: rows of some 50 bytes.
TOLD_ROWS = 500_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One gzip member that holds one record."""
    head = "".join(f"{k}: {re.sub(r'[\x00-\x1f]', lambda m: f'%{ord(m[0]):02X}', v)}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n") + z.flush()


def chunked(payload: bytes, size: int) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(p := payload[i : i + size]), p) for i in range(0, len(payload), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """Decodes chunked framing; extensions and trailers are skipped. ValueError where it is broken off."""
    parts, at = [], 0
    while True:
        eol = body.find(b"\r\n", at)
        if eol < 0:
            raise ValueError("chunk size line is missing")
        n = int(body[at:eol].split(b";")[0].strip(), 16)
        if n == 0:
            return b"".join(parts)
        if body[eol + 2 + n : eol + 4 + n] != b"\r\n":
            raise ValueError("chunk is broken off")
        parts.append(body[eol + 2 : eol + 2 + n])
        at = eol + 4 + n


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Fields (lower-case names) and block of one record."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not found or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(fields["content-length"])
    if len(rest) < n:
        raise ValueError("block is shorter than its Content-Length")
    return fields, rest[:n]


def http_payload(block: bytes) -> tuple[dict[str, str], bytes]:
    """HTTP header fields (lower-case names) and the decoded payload of a whole response block."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        raise ValueError("no HTTP header")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:])}
    return fields, unchunked(body) if fields.get("transfer-encoding", "").lower() == "chunked" else body


def members(stream, size: int = 1 << 20):
    """The decompressed gzip members of a stream, one at a time."""
    z, parts = zlib.decompressobj(31), []
    while data := stream.read(size):
        while data:
            parts.append(z.decompress(data))
            data = z.unused_data
            if z.eof:
                yield b"".join(parts)
                z, parts = zlib.decompressobj(31), []
    if any(parts):
        raise ValueError("archive is broken off")


def _name(page_id) -> str:
    """An id as part of a URI: percent-encoded behind a sign that tells it from none."""
    return "n" if page_id is None else f"v{quote(str(page_id), safe='')}"


def _page_records(page_id, url, html, digest, n_bytes, first, segment_bytes, chunk_bytes):
    """The records of a page: a response in one or more segments, or a revisit of page `first`."""
    uri = f"urn:x-page:{_name(page_id)}:{digest}"
    own = f"<{uri}#{uuid.uuid4().hex}>"
    common = [("WARC-Date", DATE), *([("WARC-Target-URI", url)] if url is not None else [])]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if first is not None:
        yield record([("WARC-Type", "revisit"), ("WARC-Record-ID", own), *common, ("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:x-page:{_name(first)}:{digest}>"), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")], http + b"Content-Length: %d\r\n\r\n" % n_bytes)
        return
    payload = (html or "").encode()
    if len(payload) > chunk_bytes:
        block = http + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload, chunk_bytes)
    else:
        block = http + b"Content-Length: %d\r\n\r\n" % len(payload) + payload
    fields = [("WARC-Type", "response"), ("WARC-Record-ID", own), *common, ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if len(block) <= segment_bytes:
        yield record(fields, block)
        return
    yield record([*fields, ("WARC-Segment-Number", "1")], block[:segment_bytes])
    for k, at in enumerate(range(segment_bytes, len(block), segment_bytes), 2):
        part = block[at : at + segment_bytes]
        last = [("WARC-Segment-Total-Length", str(len(block)))] if at + segment_bytes >= len(block) else []
        yield record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{uri}#{uuid.uuid4().hex}>"), *common, ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", str(k)), *last], part)


def _digested(pages: DataFrame) -> DataFrame:
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    return pages.withColumn("n", F.length(payload)).withColumn("hex", F.sha1(payload))


def write_archives(pages: DataFrame, path: str, segment_bytes: int = 32 << 10, chunk_bytes: int = 8 << 10, file_bytes: int = 32 << 20, min_revisit_bytes: int = 0, copies: int = 100_000) -> DataFrame:
    """Writes a record per row of pages(page_id, url, html) under path; returns the manifest (path, n_records).

    Payload: the html in UTF-8, null as empty. Of rows with equal payloads of at least min_revisit_bytes, those with
    the smallest page_id are responses and others revisit it. A null page_id comes after all others; where a group
    has no other, all its rows are responses. A null url leaves the target out. Only rows of responses carry their
    html through a shuffle, by page_id, so groups of copies make no large partition.
    """
    rows = _digested(pages)
    found = materialize(rows.where(F.col("n") >= min_revisit_bytes).groupBy("hex").agg(F.min("page_id").alias("first"), F.ceil(F.count(F.lit(1)) / copies).cast("int").alias("salts")), "warc-digests")
    first = found.select("hex", "first")
    # the copies of one payload meet its first row in several tasks: a digest of more than `copies` rows has salts
    hot = found.where("salts > 1").select("hex", "salts")
    some = rows.select("page_id", "url", "n", "hex")
    if not hot.isEmpty():
        told = F.broadcast(hot) if hot.count() <= TOLD_ROWS else hot
        some = some.join(told, "hex", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("page_id", "url"), F.col("salts")), F.lit(0)).cast("int")).drop("salts")
        told = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
        revisits = some.join(told, ["hex", "salt"]).drop("salt")
    else:
        revisits = some.join(first, "hex")
    revisits = revisits.where((F.col("n") >= min_revisit_bytes) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")))
    told = first.where(F.col("first").isNotNull()).select(F.col("first").alias("page_id"), "hex")
    responses = rows.join(told, ["page_id", "hex"], "left_semi")
    nameless = rows.where((F.col("n") >= min_revisit_bytes) & F.col("page_id").isNull()).join(told.select("hex"), "hex", "left_anti")
    orphans = rows.where(F.col("n") < min_revisit_bytes).unionByName(nameless.select(rows.columns))
    kind = pages.schema["page_id"].dataType.simpleString()
    plan = lambda df, f: df.select("page_id", "url", "n", "hex", (F.col("html") if "html" in df.columns else F.lit(None).cast("string")).alias("html"), f.cast(kind).alias("first"))
    union = plan(responses, F.lit(None)).unionByName(plan(revisits, F.col("first"))).unionByName(plan(orphans, F.lit(None)))

    def write(batches):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(path)
        store.create_dir(base, recursive=True)
        out, written, n, done = None, 0, 0, []
        for batch in batches:
            for row in batch.to_pylist():
                digest = base64.b32encode(bytes.fromhex(row["hex"])).decode()
                for rec in _page_records(row["page_id"], row["url"], row["html"], digest, row["n"], row["first"], segment_bytes, chunk_bytes):
                    if out is None:
                        name = f"pages-{uuid.uuid4().hex}.warc.gz"
                        out = store.open_output_stream(f"{base}/{name}", compression=None)
                    out.write(rec)
                    written, n = written + len(rec), n + 1
                    if written >= file_bytes:  # a record's segments may go on in the next file
                        out.close()
                        done.append((name, n))
                        out, written, n = None, 0, 0
        if out is not None:
            out.close()
            done.append((name, n))
        yield pa.RecordBatch.from_arrays([pa.array([f"{path}/{x}" for x, _ in done], pa.string()), pa.array([x for _, x in done], pa.int64())], names=["path", "n_records"])

    return materialize(map_batches(union, write, "path string, n_records long"), "warc-manifest")


RECORD = "page_id string, record_id string, type string, refers_to string, payload_bytes long, payload_digest string, segment long, total long, block binary, error string"


def _page_of(uri: str | None) -> str | None:
    m = re.match(r"<urn:x-page:v([^:]*):", uri or "")
    return unquote(m[1]) if m else None


def _read_file(store, path):
    with store.open_input_stream(path, compression=None) as stream:
        for raw in members(stream):
            fields, block = parse(raw)
            row = {"page_id": _page_of(fields.get("warc-record-id")), "record_id": fields.get("warc-record-id"), "type": fields["warc-type"], "refers_to": _page_of(fields.get("warc-refers-to")), "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:") or None}
            if "warc-segment-number" in fields:
                total = fields.get("warc-segment-total-length")
                yield row | {"record_id": fields.get("warc-segment-origin-id", row["record_id"]), "segment": int(fields["warc-segment-number"]), "total": total and int(total), "block": block}
            elif row["type"] == "revisit":
                http, _ = http_payload(block)
                yield row | {"payload_bytes": int(http["content-length"])}
            elif row["type"] == "response":
                yield row | _judged(block, row["payload_digest"])


def _judged(block: bytes, digest: str | None) -> dict:
    try:
        _, payload = http_payload(block)
    except ValueError as e:
        return {"payload_bytes": None, "error": str(e)}
    found = digest_of(payload)
    return {"payload_bytes": len(payload), "payload_digest": found, "error": None if digest in (None, found) else "payload digest differs"}


def reassemble(parts: list[dict]) -> dict:
    """One record from its segments; what is wrong is told in `error`."""
    parts = sorted(parts, key=lambda p: p["segment"])
    row = {k: parts[0][k] for k in ("page_id", "record_id", "type", "refers_to", "payload_digest")}
    block = b"".join(p["block"] for p in parts)
    if [p["segment"] for p in parts] != list(range(1, len(parts) + 1)) or parts[0]["type"] == "continuation":
        return row | {"error": "a segment is missing or repeated"}
    if parts[-1]["total"] != len(block):
        return row | {"error": "total length differs"}
    return row | _judged(block, row["payload_digest"])


def read_archives(manifest: DataFrame) -> DataFrame:
    """Records of the manifest's archives: page_id, type, refers_to, payload_bytes, payload_digest, error (null if sound).

    Only blocks of segmented records are shuffled, by their origin; a group holds one record's segments.
    """
    schema = pa.schema([("page_id", pa.string()), ("record_id", pa.string()), ("type", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("segment", pa.int64()), ("total", pa.int64()), ("block", pa.binary()), ("error", pa.string())])

    def read(batches):
        from pyarrow import fs

        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, at = fs.FileSystem.from_uri(path)
                rows = []
                for row in _read_file(store, at):
                    rows.append(row)
                    if len(rows) == 500:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    def join(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pylist([reassemble(g) for g in batch.column(0).to_pylist()], schema)

    n = max(1, min(manifest.count(), 10_000))
    parsed = materialize(map_batches(manifest.select("path").repartition(n), read, RECORD), "warc-records")
    parts = parsed.where("segment IS NOT NULL").groupBy("record_id").agg(F.collect_list(F.struct("page_id", "record_id", "type", "refers_to", "payload_digest", "segment", "total", "block")).alias("parts"))
    whole = parsed.where("segment IS NULL").unionByName(map_batches(parts.select("parts"), join, RECORD))
    return whole.select("page_id", "type", "refers_to", "payload_bytes", "payload_digest", "error")


def archive_round_trip(pages: DataFrame, **options) -> DataFrame:
    """Writes pages to fresh archives in the shared folder, reads them back, one row for each row of pages.

    page_id, payload_bytes, payload_digest, record_type, refers_to, error. An empty table gives no archives and no
    rows; repeated rows are records of their own; columns besides page_id, url and html are not read.
    """
    kind = pages.schema["page_id"].dataType.simpleString()
    manifest = write_archives(pages.select("page_id", "url", "html"), shared_dir(pages.sparkSession, "warc"), **options)
    found = read_archives(manifest)
    return found.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.col("refers_to").cast(kind).alias("refers_to"), "error")


#: DuckDB: what the archives must give back.
ROUND_TRIP_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS hex FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first FROM d)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, (1 + 5 * (i // 4))::BIGINT, 5))::BIGINT >> (15 - 5 * (i % 4))::BIGINT) & 31)::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to,
  NULL::VARCHAR AS error
FROM f
"""
