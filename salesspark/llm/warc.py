"""Operator 8: WARC archives, written in segments and read back by reassembly.

Writing: a page becomes a ``response`` record whose block is an HTTP response with a chunked body. Of pages with equal payloads
(of ``min_bytes`` or more) the one with the smallest ``page_id`` is the response, the others are ``revisit`` records that refer to it.
A block above ``segment_bytes`` is cut: the first record has segment number 1, the rest follow as ``continuation`` records
that name the first by WARC-Segment-Origin-ID, the last one with the block's total length. Each record is a gzip member.

Reading: the members of each file are parsed as a stream. Continuation records are grouped by the identifier of their origin,
ordered by segment number and joined to the first record; the number of segments must be gapless and the length must be the stated
total. Then the chunked framing is decoded, and the payload's digest must be the stated one. Anything else raises an error.

Defined results: a null html is an empty payload. Rows without ``page_id`` are always responses. Rows that repeat the ``page_id`` of the response are
responses as well. Other columns don't matter; an empty table gives no archives and no records.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesspark.llm.common import settled
from salesspark.llm.files import TaskFiles, read_whole

SEGMENT_BYTES, CHUNK_BYTES, FILE_BYTES = 32 << 10, 8 << 10, 16 << 20
SPACE = uuid.UUID("8f1c7b9e-52c2-4f7e-9a43-0d6a5d1c2b11")

RECORD_SCHEMA = ("record_id string, kind string, page_id long, origin string, segment int, total long, refers_to string, "
                 "digest string, uri string, block binary")


def record_id(page_id: int | None, digest: str, url: str | None = "") -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{page_id}|{digest}|{url}')}>"


def chunked(payload: bytes) -> bytes:
    parts = []
    for at in range(0, len(payload), CHUNK_BYTES):
        part = payload[at:at + CHUNK_BYTES]
        parts += [f"{len(part):x}\r\n".encode(), part, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body, chunk extensions and trailers allowed."""
    parts, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(parts)
        parts.append(body[at:at + size])
        if len(parts[-1]) < size or body[at + size:at + size + 2] != b"\r\n":
            raise ValueError("a chunk is shorter than it says")
        at += size + 2


def payload_of(block: bytes) -> bytes:
    """The decoded body of an HTTP response."""
    head, _, body = block.partition(b"\r\n\r\n")
    fields = [x.lower().replace(b" ", b"") for x in head.split(b"\r\n")]
    return dechunked(body) if b"transfer-encoding:chunked" in fields else body


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    whole = b"WARC/1.1\r\n" + head.encode() + f"Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress(whole) + pack.flush()


def page_records(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None,
                 segment_bytes: int = SEGMENT_BYTES) -> list[bytes]:
    """The gzip members of one page; ``refers_to`` is the record identifier of the response, or None for a response."""
    own = record_id(page_id, digest, url)
    target = (url or "urn:page:none").replace("\r", "%0D").replace("\n", "%0A").replace(" ", "%20")
    common = [("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", target), ("Content-Type", "application/http;msgtype=response"),
              ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Page-ID", page_id)]
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if refers_to is not None:
        return [_record([("WARC-Type", "revisit"), ("WARC-Record-ID", own), ("WARC-Refers-To", refers_to),
                         ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), *common], head)]
    block = head + chunked(payload)
    if len(block) <= segment_bytes:
        return [_record([("WARC-Type", "response"), ("WARC-Record-ID", own), *common], block)]
    cuts = range(0, len(block), segment_bytes)
    out = [_record([("WARC-Type", "response"), ("WARC-Record-ID", own), ("WARC-Segment-Number", 1), *common], block[:segment_bytes])]
    for n, at in enumerate(cuts[1:], 2):
        out.append(_record([("WARC-Type", "continuation"),
                            ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(SPACE, f'{own}|{n}')}>"), ("WARC-Segment-Origin-ID", own),
                            ("WARC-Segment-Number", n), ("WARC-Segment-Total-Length", len(block) if n == len(cuts) else None),
                            ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", target)], block[at:at + segment_bytes]))
    return out


def records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record of a file of gzip members, or of plain records."""
    place = 0
    while place < len(content):
        if content[place:place + 2] == b"\x1f\x8b":
            unpack, parts = zlib.decompressobj(31), []
            while not unpack.eof:
                if place >= len(content):
                    raise ValueError("a gzip member is cut off")
                parts.append(unpack.decompress(content[place:place + 16_384]))
                place += 16_384
            place = min(place, len(content)) - len(unpack.unused_data)
            whole = b"".join(parts)
        else:
            whole, place = content[place:], len(content)
        at = 0
        while at < len(whole):
            end = whole.index(b"\r\n\r\n", at)
            first, *lines = whole[at:end].decode("utf-8").split("\r\n")
            if not first.startswith("WARC/"):
                raise ValueError("no WARC record")
            fields = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines)}
            size = int(fields["content-length"])
            block = whole[end + 4:end + 4 + size]
            if len(block) < size:
                raise ValueError("a record is cut off")
            yield fields, block
            at = end + 4 + size
            while whole[at:at + 2] == b"\r\n":
                at += 2


def write_archives(pages: DataFrame, uri: str, min_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES, id_col: str = "page_id",
                   url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write every row of ``pages`` below ``uri``; the table of files (uri, n_records)."""
    payload = F.coalesce(F.col(html_col), F.lit(""))
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("html"))
    keys = settled(own.select("page_id", "url", F.sha2("html", 256).alias("same"), F.octet_length("html").alias("size")))
    response = (keys.filter((F.col("size") >= min_bytes) & F.col("page_id").isNotNull()).groupBy("same")
                .agg(F.min(F.struct("page_id", "url")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
                .select("same", F.col("first.page_id").alias("r_page"), F.col("first.url").alias("r_url")))
    marked = own.withColumn("same", F.sha2("html", 256)).join(response, "same", "left") \
        .withColumn("again", F.col("r_page").isNotNull() & F.col("page_id").isNotNull() & (F.col("page_id") != F.col("r_page")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, members, size, n = TaskFiles(uri, ".warc.gz"), [], 0, 0
        for b in batches:
            for at in range(0, b.num_rows, 256):
                for r in b.slice(at, 256).to_pylist():
                    html = r["html"] or b""
                    digest = base64.b32encode(hashlib.sha1(html).digest()).decode()
                    refers_to = record_id(r["r_page"], digest, r["r_url"]) if r["again"] else None
                    made = page_records(r["page_id"], r["url"], html, digest, refers_to, segment_bytes)
                    members += made
                    size, n = size + sum(map(len, made)), n + len(made)
                    if size >= FILE_BYTES:
                        yield pa.RecordBatch.from_pydict({"uri": [files.write(b"".join(members))], "n_records": [n]})
                        members, size, n = [], 0, 0
        if members:
            yield pa.RecordBatch.from_pydict({"uri": [files.write(b"".join(members))], "n_records": [n]})

    return settled(marked.select("page_id", "url", F.col("html").cast("binary").alias("html"), "r_page", "r_url", "again")
                   .mapInArrow(run, "uri string, n_records long"))


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split(" ")[0] for x in RECORD_SCHEMA.split(", ")]
    whole = lambda v: None if v is None else int(v)
    schema = pa.schema([("record_id", pa.string()), ("kind", pa.string()), ("page_id", pa.int64()), ("origin", pa.string()),
                        ("segment", pa.int32()), ("total", pa.int64()), ("refers_to", pa.string()), ("digest", pa.string()),
                        ("uri", pa.string()), ("block", pa.binary())])
    for b in batches:
        for uri in b.column("uri").to_pylist():
            rows = []
            for f, block in records(read_whole(uri)):
                if f["warc-type"] not in ("response", "revisit", "continuation"):
                    continue
                rows.append((f["warc-record-id"], f["warc-type"], whole(f.get("warc-page-id")), f.get("warc-segment-origin-id"),
                             whole(f.get("warc-segment-number")), whole(f.get("warc-segment-total-length")), f.get("warc-refers-to"),
                             (f.get("warc-payload-digest") or "").removeprefix("sha1:"), f.get("warc-target-uri"), block))
                if len(rows) >= 256:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=schema)


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            payloads = [payload_of(x) for x in part.column("block").to_pylist()]
            for said, p in zip(part.column("digest").to_pylist(), payloads, strict=True):
                if said and said != base64.b32encode(hashlib.sha1(p).digest()).decode():
                    raise ValueError("a payload does not have the digest that its record states")
            digests = [base64.b32encode(hashlib.sha1(p).digest()).decode() for p in payloads]
            yield pa.RecordBatch.from_arrays(
                [part.column("record_id"), part.column("page_id"), part.column("uri"), pa.array(payloads, pa.binary()),
                 pa.array(digests, pa.string())], names=["record_id", "page_id", "uri", "payload", "digest"])


def read_archives(spark: SparkSession, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Responses (record_id, page_id, uri, payload, digest) and revisits (record_id, page_id, uri, digest, refers_to)."""
    listed = settled(files.select("uri"))
    found = listed.repartition(max(1, listed.count()), "uri").mapInArrow(_parsed, RECORD_SCHEMA)
    plain = found.filter("kind = 'response' AND segment IS NULL").select("record_id", "page_id", "uri", "digest", "block")
    rest = settled(found.filter("kind <> 'response' OR segment IS NOT NULL"))  # segments and revisits, read three times below
    pieces = (rest.filter("kind = 'continuation'").groupBy("origin", "segment")
              .agg(F.first("block").alias("block"), F.max("total").alias("total"))
              .groupBy("origin").agg(F.expr("listagg(block) WITHIN GROUP (ORDER BY segment)").alias("rest"),
                                     F.count(F.lit(1)).alias("n"), F.min("segment").alias("low"), F.max("segment").alias("high"),
                                     F.max("total").alias("total")))
    opening = rest.filter("kind = 'response'").select("record_id", "page_id", "uri", "digest", "block")
    joined = opening.join(pieces, opening["record_id"] == pieces["origin"], "left") \
        .withColumn("whole", F.concat("block", "rest"))
    sound = (F.col("low") == 2) & (F.col("high") == F.col("n") + 1) & (F.octet_length("whole") == F.col("total"))
    checked = F.when(F.coalesce(sound, F.lit(False)), F.col("whole")).otherwise(
        F.raise_error(F.concat(F.lit("segments are missing or too short: "), F.col("record_id"))).cast("binary"))
    blocks = plain.unionByName(
        joined.select("record_id", "page_id", "uri", "digest", checked.alias("block")))
    responses = blocks.mapInArrow(_opened, "record_id string, page_id long, uri string, payload binary, digest string")
    revisits = rest.filter("kind = 'revisit'").select("record_id", "page_id", "uri", "digest", "refers_to")
    return responses, revisits
