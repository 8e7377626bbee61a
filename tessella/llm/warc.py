"""WARC archives with segmented records and chunked HTTP bodies (operator 3).

Writing: each page is an HTTP response with a chunked body, cut into segments of ``SEGMENT`` bytes; a payload seen
before becomes a revisit of the record with the smallest page id. Each record is a gzip member of its own, so that
archives can be read from any record on. Spark's text sink writes the members (the last byte of one is the high byte of
its length, zero below 16 MiB, and serves as line separator), so commits, retries and any store that Spark writes to just work.

Reading: archives are read as binary files of bounded size and walked by Content-Length. Unsegmented records are
decoded where they are; segments are dealt by origin id, sorted by segment number, checked for gaps and for the total
length, joined, and then freed of their chunked framing.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.tables import table
from tessella.plans.storage import anchored, new_path, row_id, stage

SEGMENT = 16_384
CHUNK = 8_192
RECORDS_PER_FILE = 2_000
DEDUP_BYTES = 100
VERSION = b"WARC/1.1\r\n"
DATE = "2024-01-01T00:00:00Z"  # archives of equal tables are equal
_BATCH = 4 << 20
_PIECE = 1 << 14


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = []
    for at in range(0, len(payload), size):
        piece = payload[at : at + size]
        parts += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """Payload of a chunked body; chunk extensions and trailers are skipped. ValueError if the framing is broken."""
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk size without an end")
        digits = body[at:end].split(b";")[0].strip(b" \t")
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,15}", digits):
            raise ValueError("chunk size isn't a hexadecimal number")
        size, at = int(digits, 16), end + 2
        if not size:
            if body[at : at + 2] != b"\r\n" and not body.endswith(b"\r\n\r\n"):
                raise ValueError("no end of the last chunk")
            return b"".join(parts)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk shorter or longer than its size")
        parts.append(body[at : at + size])
        at += size + 2


def http_payload(block: bytes) -> bytes:
    """Payload of an HTTP response message, freed of chunked transfer coding."""
    head, sep, body = block.partition(b"\r\n\r\n")
    if not sep:
        raise ValueError("no end of the HTTP headers")
    return unchunked(body) if re.search(rb"(?im)^transfer-encoding:\s*chunked\s*$", head) else body


def _urn(ident: str) -> str:
    return f"<urn:uuid:{ident[:8]}-{ident[8:12]}-{ident[12:16]}-{ident[16:20]}-{ident[20:]}>"


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"".join([VERSION, head.encode(), b"\r\n", block, b"\r\n\r\n"])


def records_of(ident: str, page_id, url: str | None, payload: bytes, digest: str, first: str | None, first_page, segment: int = SEGMENT) -> Iterator[bytes]:
    """The records of one page: a response in one or more segments, or a revisit."""
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "urn:none")
    about = [("WARC-Target-URI", target), ("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    own = [] if page_id is None else [("X-Page-ID", str(page_id))]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if first is not None:
        more = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _urn(first)), ("X-Refers-To-Page-ID", str(first_page))]
        yield _record([("WARC-Type", "revisit"), ("WARC-Record-ID", _urn(ident)), *about, *own, *more], http.replace(b"Transfer-Encoding: chunked\r\n", b""))
        return
    block = http + chunked(payload)
    if len(block) <= segment:
        yield _record([("WARC-Type", "response"), ("WARC-Record-ID", _urn(ident)), *about, *own], block)
        return
    parts = [block[at : at + segment] for at in range(0, len(block), segment)]
    yield _record([("WARC-Type", "response"), ("WARC-Record-ID", _urn(ident)), *about, *own, ("WARC-Segment-Number", "1")], parts[0])
    for k, part in enumerate(parts[1:], 2):
        name = f"{ident[:24]}{(int(ident[24:], 16) + k) % 16**8:08x}"
        end = [("WARC-Segment-Total-Length", str(len(block)))] if k == len(parts) else []
        yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", _urn(name)), *about[:2], ("WARC-Segment-Origin-ID", _urn(ident)), ("WARC-Segment-Number", str(k)), *end], part)


def member(record: bytes) -> bytes:
    """A gzip member without its last byte, which is zero."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return (packer.compress(record) + packer.flush())[:-1]


def _write(batches: Iterator[pa.RecordBatch], segment: int) -> Iterator[pa.RecordBatch]:
    if segment >= 1 << 23:
        raise ValueError("segments are less than 8 MiB")
    held, size = [], 0
    for batch in batches:
        for row in zip(*(batch[c] for c in ("ident", "page_id", "url", "payload", "digest", "first", "first_page")), strict=True):
            for record in records_of(*(x.as_py() for x in row), segment):
                held.append(member(record))
                size += len(held[-1])
            if size >= _BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["record"])
                held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["record"])


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", segment: int = SEGMENT, dedup_bytes: int = DEDUP_BYTES) -> None:
    """Write one WARC record (or its segments) per row of ``pages`` below ``path``, a gzip member each.

    Repeated rows are records of their own, a null page id is left out of its record, very long payloads are segmented,
    an empty table gives empty archives, names of other columns don't matter.

    A null html is an empty payload, a null url is ``urn:none``. Of equal payloads of ``dedup_bytes`` at least, that with
    the smallest page id is the response (nulls last, then the first row by position), others revisit it. Only the ids of
    revisits are joined to the pages.
    """
    ident = F.md5(F.concat_ws(":", F.col("rid.file"), F.col("rid.row")))
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    pages = anchored(pages)
    all_rows = pages.select(row_id(pages).alias("rid"), F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    narrow = stage(all_rows.where(F.octet_length("payload") >= dedup_bytes).select("rid", "page_id", F.unhex(F.sha2("payload", 256)).alias("sha")), "payloads")
    first = F.min(F.struct(F.col("page_id").isNull().alias("unknown"), "page_id", "rid")).alias("first")
    groups = narrow.groupBy("sha").agg(first, F.count("*").alias("n")).where("n > 1").select("sha", "first")
    again = narrow.join(groups, "sha").where(F.col("rid") != F.col("first.rid"))
    again = stage(again.select("rid", F.struct(ident.alias("x")).alias("y"), F.col("first.rid").alias("frid"), F.col("first.page_id").alias("first_page")).drop("y"), "revisits")
    again = again.select("rid", F.md5(F.concat_ws(":", F.col("frid.file"), F.col("frid.row"))).alias("first"), "first_page")
    rows = all_rows.join(again, "rid", "left").select(ident.alias("ident"), "page_id", "url", "payload", F.sha2("payload", 256).alias("digest"), "first", "first_page")
    records = rows.mapInArrow(lambda it: _write(it, segment), "record binary")
    (records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path))


def plain(data: bytes) -> Iterator[bytes]:
    """The content of an archive: as it is, or that of its gzip members one by one. ValueError or zlib.error at a fault."""
    at = 0
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    while at < len(data) and (data[at] or data[at:].strip(b"\0")):  # zeros behind the last member are padding
        unpacker, parts = zlib.decompressobj(31), []
        while not unpacker.eof:
            piece = data[at : at + _PIECE]
            if not piece:
                raise ValueError("a gzip member is cut off")
            parts.append(unpacker.decompress(piece))
            at += len(piece) - len(unpacker.unused_data)
        yield b"".join(parts)


def walk(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields by lower-case name, block) of each record of an archive, plain or in gzip members; members may hold many
    records, and records may go over members. ValueError or zlib.error at a fault, after the records before it."""
    held = b""
    for part in plain(data):
        held, at = held + part, 0
        while (end := held.find(b"\r\n\r\n", at)) >= 0:
            if held[at : at + 5] != b"WARC/":
                raise ValueError("no record where one should start")
            lines = held[at:end].decode("utf-8", "replace").split("\r\n")[1:]
            fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
            if not re.fullmatch("[0-9]{1,18}", fields.get("content-length", "")):
                raise ValueError("a record without a length")
            start, size = end + 4, int(fields["content-length"])
            if len(held) < start + size + 4:
                break
            if held[start + size : start + size + 4] != b"\r\n\r\n":
                raise ValueError("a record is longer or shorter than its length")
            yield fields, held[start : start + size]
            at = start + size + 4
        held = held[at:]
    if held:
        raise ValueError("the last record is cut off" if held[:5] == b"WARC/" else "no record where one should start")


_RAW = "origin string, segment int, total bigint, type string, page_id string, refers_to string, digest string, http boolean, block binary, error string"


def _number(text: str | None) -> int | None:
    return int(text) if text and re.fullmatch("[0-9]{1,9}", text) else None


def _read(batches: Iterator[pa.RecordBatch], parts: bool) -> Iterator[pa.RecordBatch]:
    """The segments of archives (``parts``), or their whole records and what is wrong with them."""
    names = [x.split()[0] for x in _RAW.split(", ")]
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.binary(), pa.string()]
    made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
    for batch in batches:
        for path, content in zip(batch["path"].to_pylist(), batch["content"], strict=True):
            rows, size = [], 0
            try:
                for f, block in walk(content.as_py()):
                    # what is no HTTP message is a payload as it is; continuations go by the kind of their first segment
                    http = f.get("content-type", "").lower().startswith("application/http")
                    origin, segment, kind, digest = f.get("warc-segment-origin-id"), _number(f.get("warc-segment-number")), f.get("warc-type"), f.get("warc-payload-digest")
                    error = None
                    if kind == "continuation" and not (origin and segment and segment > 1):
                        segment, block, error = None, None, "a continuation without its number or origin"
                    if (segment is not None) != parts:
                        continue
                    if segment is None and not error:  # a whole record
                        block, error = assemble([(None, None, block)], http, digest, kind != "revisit")
                    rows.append((origin or f.get("warc-record-id"), segment, _number(f.get("warc-segment-total-length")), kind, f.get("x-page-id"), f.get("x-refers-to-page-id"), digest, http, block, error))
                    size += len(block or b"")
                    if size >= _BATCH:
                        yield made(rows)
                        rows, size = [], 0
            except (ValueError, zlib.error) as e:
                if not parts:
                    rows.append((None, None, None, None, None, None, None, None, None, f"{path}: {e}"))
            if rows:
                yield made(rows)


def assemble(segments: list[tuple], http: bool = True, digest: str | None = None, payload_is_whole: bool = True) -> tuple[bytes | None, str | None]:
    """(payload, error) of one record's segments (number, total, block), in any order; repeated segments count once.

    A ``digest`` of kind sha256 (hexadecimal) or sha1 (base 32) is compared with the payload, unless the record has none of it (a revisit).
    """
    by_number = {n or 1: (total, block) for n, total, block in segments}
    if sorted(by_number) != list(range(1, len(by_number) + 1)):
        return None, "segments missing"
    block = b"".join(by_number[n][1] for n in sorted(by_number))
    total = by_number[len(by_number)][0]
    if len(by_number) > 1 or segments[0][0]:
        if total is None:
            return None, "no total length"
        if total != len(block):
            return None, f"total length is {total}, segments have {len(block)}"
    try:
        payload = http_payload(block) if http else block
    except ValueError as e:
        return None, str(e)
    kind, _, value = (digest or "").partition(":")
    if payload_is_whole and (
        (kind == "sha256" and hashlib.sha256(payload).hexdigest() != value) or (kind == "sha1" and base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode() != value)
    ):
        return None, "the payload differs from its digest"
    return payload, None


def _join_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by origin and segment number: one row per origin."""
    names = ["origin", "type", "page_id", "refers_to", "digest", "payload", "error"]
    kinds = [pa.string()] * 5 + [pa.binary(), pa.string()]
    held, of, out, size = [], None, [], 0

    def close() -> None:
        head = min(held, key=lambda r: r["segment"])
        payload, error = assemble([(r["segment"], r["total"], r["block"]) for r in held], head["http"], head["digest"], head["type"] != "revisit")
        out.append((of, head["type"], head["page_id"], head["refers_to"], head["digest"], payload, error))

    for batch in batches:
        for i in range(len(batch)):
            row = {c: batch[c][i].as_py() for c in batch.schema.names}
            if held and row["origin"] != of:
                close()
                size += len(out[-1][5] or b"")
                held = []
                if size >= _BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
                    out, size = [], 0
            of = row["origin"]
            held.append(row)
    if held:
        close()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """``origin, type, page_id, refers_to, digest, payload, error``: one row per record of the archives below ``path``,
    whatever their names; segments joined.

    A record with missing segments, a wrong total length, broken framing or a payload that differs from its SHA-256 has a
    null payload and says so in ``error``. A fault of the archive itself (cut off, no record) ends it with a row of nulls and
    the ``error``. A revisit's payload is empty; refers_to is the page id it names. Records other than HTTP messages
    have their block as payload. Empty archives give no rows.
    """
    archives = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    # two scans, each of which gives out its own records only: whole records are decoded in place, segments are shuffled
    whole, parts = (archives.mapInArrow(lambda it, k=k: _read(it, k), _RAW) for k in (False, True))
    out = "origin string, type string, page_id string, refers_to string, digest string, payload binary, error string"
    whole = whole.select("origin", "type", "page_id", "refers_to", "digest", F.col("block").alias("payload"), "error")
    parts = parts.repartition("origin").sortWithinPartitions("origin", "segment")
    return whole.unionByName(parts.mapInArrow(_join_segments, out)).withColumn("digest", F.regexp_replace("digest", "^sha256:", ""))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back: digest and length of its payload. Fails if a record has an error."""
    path = new_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    found = read_archives(spark, path)
    found = found.withColumn("type", F.when(F.col("error").isNotNull(), F.raise_error(F.col("error"))).otherwise(F.col("type")))
    records = found.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.octet_length("payload").cast("bigint").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"),
        F.col("type").alias("record_type"), F.col("refers_to").cast("bigint").alias("refers_to"), "origin", "digest",
    )
    records = stage(records, "records")
    again = records.where("record_type = 'revisit'").select("page_id", "record_type", "refers_to", "digest")
    firsts = records.where("record_type = 'response'").select(F.col("payload_digest").alias("digest"), "payload_bytes", "payload_digest", F.col("page_id").alias("p"))
    found = again.join(firsts, (again["digest"] == firsts["digest"]) & again["refers_to"].eqNullSafe(firsts["p"]))
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return records.where("record_type = 'response'").select(*cols).unionByName(found.select(*cols))


OP3_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to FROM f
"""
