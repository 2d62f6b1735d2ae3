"""WARC archives: write HTTP responses, read records back, and put segmented records together.

Writing builds one record per row in Arrow batches: a chunked HTTP response, cut into a first
record and continuation records when its block is long, or a ``revisit`` record without payload
when an equal payload has its response elsewhere. Spark's text writer puts the records into
archive files, so any file system that Spark writes to will do; it gets about CELL_BYTES of
records at a time and starts a new file after FILE_CELLS of those, so files are cut by bytes. Which digests have copies is
counted first: as long as they are few their rows are broadcast and no payload is shuffled.

Reading inflates a file a step at a time, parses records by their Content-Length and hands them on
in groups of a few MB, so that only the packed file stands in memory whole. It groups continuation
records by the identifier of their origin record, orders them by segment number, verifies that the
numbers are gapless and that the bytes add up to WARC-Segment-Total-Length, and decodes chunked
transfer framing. A record with missing segments, a wrong total or broken chunk framing is returned
with ``valid`` false and a null payload, and so is what can't be read of a damaged file, or a file
or record too long for a cell (without an identifier); none of these stops the job.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framesift.llm.common import arrow_map, stored

#: Bytes of a record's block before it is cut into segments, of an HTTP chunk, of records that are written at a time, and how many of those a file takes.
SEGMENT_BYTES, CHUNK_BYTES, CELL_BYTES, FILE_CELLS = 1 << 16, 1 << 13, 1 << 20, 64
#: Bytes that are inflated at a time, and of records that are handed on at a time.
STEP_BYTES, GROUP_BYTES = 1 << 18, 1 << 22
#: Bytes that a cell of a table can hold.
MAX_BYTES = (1 << 31) - 1024
#: Parts that rows of one digest are dealt over when verdicts are joined to them.
SALTS = 32
#: Digests with copies up to which they are broadcast instead (about 100 bytes each).
BROADCAST_DIGESTS = 200_000

_END = b"\r\n\r\n"
_RECORD = "error string, record_id string, record_type string, segment int, origin_id string, total_length bigint, refers_to string, target_uri string, payload_digest string, block binary"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing of a payload."""
    parts = (payload[i : i + size] for i in range(0, len(payload), size))
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes | None:
    """The payload in chunked framing; None if the framing is broken. Extensions and trailers are ignored."""
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            return None
        try:
            size = int(body[at:end].split(b";")[0].strip(), 16)
        except ValueError:
            return None
        at = end + 2
        if size <= 0:
            return b"".join(parts) if size == 0 else None
        if body[at + size : at + size + 2] != b"\r\n":
            return None
        parts.append(body[at : at + size])
        at += size + 2


def http_payload(block: bytes) -> bytes | None:
    """The payload of an HTTP response, its transfer framing undone; None if it is broken."""
    head, mark, body = block.partition(_END)
    if not mark:
        return None
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    if fields.get(b"transfer-encoding", b"").lower() == b"chunked":
        return unchunked(body)
    size = fields.get(b"content-length")
    return body if size is None or number(size.decode("latin-1")) == len(body) else None


def number(text: str | None) -> int | None:
    """A whole number written in ASCII digits; None for anything else, or one that no 64-bit column holds."""
    return int(text) if text and len(text) <= 18 and text.isascii() and text.isdigit() else None


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """A WARC record without the two line ends that close it."""
    lines = [f"{k}: {' '.join(str(v).split())}" for k, v in [*fields, ("Content-Length", len(block))] if v is not None]
    return ("WARC/1.1\r\n" + "\r\n".join(lines)).encode() + _END + block


def inflated(content: memoryview, step: int = STEP_BYTES) -> Iterator[bytes | str]:
    """The plain bytes of a gzip file of any number of members, or of a plain file, in pieces; where it is damaged, what is wrong, and no more."""
    at = 0
    while content[at : at + 2] == b"\x1f\x8b":
        stream = zlib.decompressobj(31)
        while at < len(content) and not stream.eof:
            left = content[at : at + step]
            at += len(left)
            while True:
                try:
                    got = stream.decompress(left, step)
                except zlib.error as e:
                    yield f"damaged gzip member: {e}"
                    return
                if got:
                    yield got
                left = stream.unconsumed_tail
                if stream.eof or not (got or left):
                    break
        if not stream.eof:
            yield "gzip member cut off"
            return
        at -= len(stream.unused_data)
    for start in range(at, len(content), step):
        yield bytes(content[start : start + step])


def records(pieces: Iterable[bytes | str]) -> Iterator[tuple[dict[str, str], bytes] | str]:
    """Header fields and block of each record in an archive's pieces; where no record can be read, what is wrong, and no more."""
    source, held, at, fault = iter(pieces), bytearray(), 0, None

    def fill() -> bool:
        nonlocal fault
        piece = next(source, None) if fault is None else None
        if isinstance(piece, str):
            fault, piece = piece, None
        held.extend(piece or b"")
        return piece is not None

    while held or fill():
        seen = 0
        while (end := held.find(_END, seen)) < 0 and held[:5] == b"WARC/"[: len(held)]:
            seen = max(0, len(held) - len(_END) + 1)
            if not fill():
                break
        if end < 0 or held[:5] != b"WARC/":
            yield fault or f"no record at byte {at}"
            return
        lines = held[:end].decode("utf-8", "replace").split("\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        start, size = end + len(_END), number(fields.get("content-length"))
        if size is None or size > MAX_BYTES:
            yield fault or f"no length, or one beyond any cell, in the record at byte {at}"
            return
        stop = start + size
        while len(held) < stop + len(_END) and fill():
            pass
        if len(held) < stop:
            yield fault or f"a length beyond the file in the record at byte {at}"
            return
        block = bytes(held[start:stop])
        stop += len(_END) if held[stop : stop + len(_END)] == _END else 0
        del held[:stop]
        at += stop
        yield fields, block
    if fault:
        yield fault


def write_archives(df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit_bytes: int = 1000, broadcast_digests: int = BROADCAST_DIGESTS, cell_bytes: int = CELL_BYTES) -> None:
    """Write one WARC record (with continuation records where it is long) per row to gzip files under ``path``.

    Up to ``broadcast_digests`` digests with copies are broadcast; more of them meet their rows in a salted shuffle.

    Of rows with equal payloads of at least ``min_revisit_bytes`` the one with the largest id is
    the response and the others revisit it; a null payload is empty, a null id never revisits, and
    of rows repeated with the same id the first written is no different from the rest: all with
    the largest id are responses. Other columns are ignored, whatever their names.
    """
    key = F.col(f"`{id_col}`")
    payload = F.coalesce(F.encode(F.col(f"`{payload_col}`"), "UTF-8") if isinstance(df.schema[payload_col].dataType, T.StringType) else F.col(f"`{payload_col}`"), F.lit(b""))
    url = F.col(f"`{url_col}`").cast("string") if url_col in df.columns else F.lit(None).cast("string")
    digest = F.sha1(payload)
    groups = df.where(key.isNotNull()).select(key.cast("bigint").alias("_id"), digest.alias("_digest"), F.length(payload).alias("_n")).where(F.col("_n") >= min_revisit_bytes)
    groups = groups.groupBy("_digest").agg(F.max("_id").alias("_first"), F.count("*").alias("_copies")).where("_copies > 1")
    groups = stored(groups.select("_digest", "_first"))
    rows = df.select(key.cast("bigint").alias("_id"), url.alias("_url"), payload.alias("_payload"), digest.alias("_digest"))
    if groups.count() <= broadcast_digests:
        rows = rows.join(F.broadcast(groups), "_digest", "left")
    else:
        salts = groups.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
        rows = rows.withColumn("_salt", F.pmod(F.xxhash64("_id", "_url"), F.lit(SALTS)).cast("int"))
        rows = rows.join(salts, ["_digest", "_salt"], "left")

    def make():
        def build(page: int | None, url: str | None, payload: bytes, digest: str, first: int | None) -> list[bytes]:
            name = lambda i: f"<urn:page:{i}:{digest}>"
            base = [("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Target-URI", url or None), ("WARC-Payload-Digest", f"sha1:{digest}")]
            own = name("" if page is None else page)
            if first is not None and page is not None and first != page:
                block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: %d\r\n\r\n" % len(payload)
                profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
                return [record([("WARC-Type", "revisit"), ("WARC-Record-ID", own), ("WARC-Profile", profile), ("WARC-Refers-To", name(first)), *base], block)]
            block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
            cuts = [block[i : i + SEGMENT_BYTES] for i in range(0, len(block), SEGMENT_BYTES)]
            if len(cuts) == 1:
                return [record([("WARC-Type", "response"), ("WARC-Record-ID", own), *base], block)]
            out = [record([("WARC-Type", "response"), ("WARC-Record-ID", own), ("WARC-Segment-Number", 1), *base], cuts[0])]
            for n, cut in enumerate(cuts[1:], 2):
                total = len(block) if n == len(cuts) else None
                out.append(record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"{own[:-1]}.{n}>"), ("WARC-Segment-Number", n), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Total-Length", total), *base[:2]], cut))
            return out

        def work(batch: pa.RecordBatch):
            columns = [batch.column(c) for c in ("id", "url", "payload", "digest", "first")]
            held, size = [], 0
            for i in range(batch.num_rows):
                for made in build(*(c[i].as_py() for c in columns)):
                    held.append(made)
                    size += len(made)
                    if size >= cell_bytes:
                        yield {"content": [_END.join(held)]}
                        held, size = [], 0
            if held:
                yield {"content": [_END.join(held)]}

        return work

    built = arrow_map(rows, {"id": "_id", "url": "_url", "payload": "_payload", "digest": "_digest", "first": "_first"}, "content binary", make)
    # the text writer passes bytes through as they are and ends each cell, like each record in it, with the two line ends of the format
    text = built.select(F.col("content").cast("string").alias("value"))
    text.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", FILE_CELLS).mode("overwrite").text(path)


def read_records(spark: SparkSession, path: str, max_file_bytes: int = MAX_BYTES) -> DataFrame:
    """Every record of the archives under ``path``, gzip (any number of members) or plain, before reassembly.

    What a damaged file holds before the damage is returned, and one more row of it with ``error``
    set and all else null; the other files aren't touched by that. A file of more than
    ``max_file_bytes`` as it is stored (at most what a cell holds) is such a row alone and isn't read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    fits = F.col("length") <= min(max_file_bytes, MAX_BYTES)
    names = [x.split()[0] for x in _RECORD.split(", ")]

    def make():
        def row(found: tuple[dict[str, str], bytes] | str) -> tuple:
            if isinstance(found, str):
                return (found, *[None] * 9)
            get = found[0].get
            return (None, get("warc-record-id"), get("warc-type"), number(get("warc-segment-number")), get("warc-segment-origin-id"), number(get("warc-segment-total-length")), get("warc-refers-to"), get("warc-target-uri"), get("warc-payload-digest"), found[1])

        def work(batch: pa.RecordBatch):
            for content in batch.column("content"):
                rows, size = [], 0
                for found in records(inflated(memoryview(content.as_buffer() or b"").cast("B"))):
                    rows.append(row(found))
                    size += len(rows[-1][-1] or b"")
                    if size >= GROUP_BYTES:
                        yield dict(zip(names, zip(*rows)))
                        rows, size = [], 0
                if rows:
                    yield dict(zip(names, zip(*rows)))

        return work

    read = arrow_map(files.where(fits).select("content"), {"content": "content"}, _RECORD, make)
    blank = [F.lit(None).cast(read.schema[n].dataType).alias(n) for n in names[1:]]
    long = files.where(~fits).select(F.format_string("a file of %d bytes", "length").alias("error"), *blank)
    return read.unionByName(long)


def reassemble(found: DataFrame) -> DataFrame:
    """Whole records: those without segment numbers as they are, the others put together by origin identifier.

    ``complete`` is false where a segment is missing, where segments of one number differ, where
    the first isn't there, or where the bytes don't add up to the total length. A record written
    several times with one identifier comes back as many times; its copies are counted before
    anything is gathered. Only segmented records are shuffled. Rows with an ``error`` stay, not complete.
    """
    whole = ["record_id", "record_type", "refers_to", "target_uri", "payload_digest", "block"]
    if "error" not in found.columns:
        found = found.withColumn("error", F.lit(None).cast("string"))
    single = found.where("segment is null").select(*whole, F.col("error").isNull().alias("complete"))
    parts = found.where("segment is not null").withColumn("origin", F.coalesce("origin_id", "record_id"))
    same = parts.groupBy("origin", "segment").agg(
        *(F.max(c).alias(c) for c in [*whole[1:], "total_length"]),
        (F.min(F.sha1("block")) == F.max(F.sha1("block"))).alias("alike"),
        F.count("*").alias("copies"),
    )
    first = F.col("segment") == 1
    grouped = same.groupBy("origin").agg(
        *(F.max(F.when(first, F.col(c))).alias(c) for c in whole[1:-1]),
        F.max("total_length").alias("total"),
        F.bool_and("alike").alias("alike"),
        F.min("copies").alias("copies"),
        F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("parts"),
    )
    gapless = F.transform("parts", lambda p: p["segment"]) == F.sequence(F.lit(1), F.size("parts"))
    block = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["block"]))
    grouped = grouped.select(F.col("origin").alias("record_id"), *whole[1:-1], block.alias("block"), (gapless & F.col("alike")).alias("good"), "total", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    complete = F.coalesce(F.col("good") & (F.length("block") == F.col("total")) & F.col("record_type").isNotNull(), F.lit(False))
    return single.unionByName(grouped.select(*whole, complete.alias("complete")))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per whole record under ``path``: its fields, ``payload`` (null for revisits), its length and ``valid``."""
    schema = "record_id string, record_type string, refers_to string, target_uri string, stated_digest string, payload binary, stated_bytes bigint, valid boolean"

    def make():
        def work(batch: pa.RecordBatch):
            payload, stated, valid = [], [], []
            for kind, block, complete in zip(*(batch.column(c).to_pylist() for c in ("record_type", "block", "complete"))):
                block = block or b""
                if kind == "revisit":
                    head = block.lower().partition(b"content-length:")[2].split(b"\r\n")[0].strip()
                    payload.append(None)
                    stated.append(number(head.decode("latin-1")))
                    valid.append(bool(complete))
                else:
                    got = http_payload(block) if complete else None
                    payload.append(got)
                    stated.append(None if got is None else len(got))
                    valid.append(got is not None)
            yield {c: batch.column(c) for c in ("record_id", "record_type", "refers_to", "target_uri", "stated_digest")} | {"payload": payload, "stated_bytes": stated, "valid": valid}

        return work

    whole = reassemble(read_records(spark, path))
    columns = {c: c for c in ("record_id", "record_type", "refers_to", "target_uri", "block", "complete")}
    return arrow_map(whole, columns | {"stated_digest": "payload_digest"}, schema, make)
