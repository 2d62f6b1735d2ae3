"""TIFF images as media columns: walk image directories, decode strips and tiles, one row per page.

Reads little- and big-endian classic TIFF with 8-bit samples (grey, RGB and other chunky or planar
layouts), compression none, LZW, deflate or PackBits, and predictor none or horizontal differencing.
A page that is broken or of another kind gives a row with ``error`` set and null pixels; a column
value that is no TIFF at all (null, empty, other bytes) gives one such row with page 0.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from framesift.llm.common import arrow_map

#: Compression schemes and predictors, by their numbers in the format (fixed values).
NONE, LZW, DEFLATE, PACKBITS = 1, 5, 8, 32773
OLD_DEFLATE = 32946
PLAIN, DIFFERENCE = 1, 2

#: Tags of the format that are read or written (fixed values).
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR, PREDICTOR = 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_BYTES = 322, 323, 324, 325

_KINDS = {1: ("B", 1), 3: ("H", 2), 4: ("I", 4)}
#: Samples that a page may have: a binary cell of a table holds no more, so more is taken for a broken file.
MAX_BYTES = (1 << 31) - 1


class BadTiff(ValueError):
    """The bytes are no TIFF page that this reader decodes."""


@dataclass
class Page:
    width: int
    height: int
    samples: int
    compression: int
    predictor: int
    parts: int
    pixels: bytes


# ---------------------------------------------------------------- compression


def packbits_encode(data: bytes) -> bytes:
    """PackBits: runs of two and more equal bytes as a count and a byte, the rest as literals of up to 128."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return b""
    starts = np.concatenate(([0], np.flatnonzero(np.diff(raw)) + 1))
    lengths = np.diff(np.append(starts, len(raw)))
    out, literal = bytearray(), 0  # literal: bytes before the run that aren't written yet

    def flush(end: int) -> None:
        nonlocal literal
        while literal:
            n = min(literal, 128)
            out.append(n - 1)
            out.extend(data[end - literal : end - literal + n])
            literal -= n

    for at, n in zip(starts.tolist(), lengths.tolist()):
        if n < 3:
            literal += n
            continue
        flush(at)
        left = n
        while left > 1:
            step = min(left, 128)
            out += bytes(((257 - step) & 0xFF, data[at]))
            left -= step
        literal = left
    flush(len(data))
    return bytes(out)


def packbits_decode(data: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and len(out) < size:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        elif n > 128:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    """TIFF's LZW: most significant bit first, clear code 256, end code 257, widths 9 to 12 that change one code early."""
    acc, bits, out = 256, 9, bytearray()
    table: dict[bytes, int] = {bytes((i,)): i for i in range(256)}
    width, following, word = 9, 258, b""
    for value in data:
        longer = word + bytes((value,))
        if longer in table:
            word = longer
            continue
        acc = acc << width | table[word]
        bits += width
        table[longer] = following
        following += 1
        if following == 4094:
            acc = acc << 12 | 256
            bits += 12
            table = {bytes((i,)): i for i in range(256)}
            width, following = 9, 258
        elif following in (512, 1024, 2048):
            width += 1
        word = bytes((value,))
        if bits > 4096:
            keep = bits & 7
            out += (acc >> keep).to_bytes((bits - keep) // 8, "big")
            acc &= (1 << keep) - 1
            bits = keep
    if word:
        acc = acc << width | table[word]
        bits += width
        following += 1
        width += following in (512, 1024, 2048)
    acc = acc << width | 257
    bits += width
    pad = -bits % 8
    return bytes(out) + (acc << pad).to_bytes((bits + pad) // 8, "big")


def lzw_decode(data: bytes, size: int) -> bytes:
    acc, bits, width = 0, 0, 9
    table: list[bytes] = []
    out, n, last = [], 0, None
    for value in data:
        acc = acc << 8 | value
        bits += 8
        if bits < width:
            continue
        bits -= width
        code = acc >> bits
        acc &= (1 << bits) - 1
        if code == 256:
            table = [bytes((i,)) for i in range(256)] + [b"", b""]
            width, last = 9, None
            continue
        if code == 257 or n >= size:
            break
        if last is None:
            if code > 255 or not table:
                raise BadTiff("LZW data start without a clear code")
            word = table[code]
        else:
            if code < len(table):
                word = table[code]
            elif code == len(table):
                word = last + last[:1]
            else:
                raise BadTiff("LZW code that the table doesn't have")
            table.append(last + word[:1])
            if len(table) in (511, 1023, 2047):
                width += 1
        out.append(word)
        n += len(word)
        last = word
    return b"".join(out)


def compress(data: bytes, scheme: int) -> bytes:
    if scheme == NONE:
        return data
    if scheme == LZW:
        return lzw_encode(data)
    if scheme == PACKBITS:
        return packbits_encode(data)
    if scheme in (DEFLATE, OLD_DEFLATE):
        return zlib.compress(data, 1)
    raise BadTiff(f"compression {scheme}")


def decompress(data: bytes, scheme: int, size: int) -> bytes:
    """Exactly ``size`` bytes, or BadTiff."""
    if scheme == NONE:
        out = data
    elif scheme == LZW:
        out = lzw_decode(data, size)
    elif scheme == PACKBITS:
        out = packbits_decode(data, size)
    elif scheme in (DEFLATE, OLD_DEFLATE):
        try:
            out = zlib.decompressobj().decompress(data, size)
        except zlib.error as e:
            raise BadTiff(f"deflate: {e}") from None
    else:
        raise BadTiff(f"compression {scheme}")
    if len(out) < size:
        raise BadTiff("a strip or tile is shorter than its rows")
    return out[:size]


# ---------------------------------------------------------------- pages


def _difference(block: np.ndarray) -> np.ndarray:
    """Horizontal differencing of rows x columns x samples, modulo 256."""
    out = block.copy()
    out[:, 1:] -= block[:, :-1]
    return out


def encode(pages: list[np.ndarray], scheme: int = DEFLATE, predictor: int = DIFFERENCE, rows: int = 256, tile: int = 0, order: str = "<") -> bytes:
    """A TIFF file of 8-bit pages (rows x columns, or rows x columns x samples), in strips of ``rows`` or square tiles."""
    out = bytearray((b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 0))
    link = 4
    for page in pages:
        page = page[:, :, None] if page.ndim == 2 else page
        height, width, samples = page.shape
        if tile:
            down, across = -(-height // tile), -(-width // tile)
            full = np.zeros((down * tile, across * tile, samples), np.uint8)
            full[:height, :width] = page
            blocks = [full[i * tile : (i + 1) * tile, j * tile : (j + 1) * tile] for i in range(down) for j in range(across)]
        else:
            blocks = [page[i : i + rows] for i in range(0, height, rows)]
        offsets, sizes = [], []
        for block in blocks:
            data = compress((_difference(block) if predictor == DIFFERENCE else block).tobytes(), scheme)
            offsets.append(len(out))
            sizes.append(len(data))
            out += data
        fields: list[tuple[int, int, list[int]]] = [
            (WIDTH, 4, [width]), (LENGTH, 4, [height]), (BITS, 3, [8] * samples), (COMPRESSION, 3, [scheme]),
            (PHOTOMETRIC, 3, [2 if samples == 3 else 1]), (SAMPLES, 3, [samples]), (PLANAR, 3, [1]), (PREDICTOR, 3, [predictor]),
        ]
        if tile:
            fields += [(TILE_WIDTH, 4, [tile]), (TILE_LENGTH, 4, [tile]), (TILE_OFFSETS, 4, offsets), (TILE_BYTES, 4, sizes)]
        else:
            fields += [(STRIP_OFFSETS, 4, offsets), (ROWS_PER_STRIP, 4, [rows]), (STRIP_BYTES, 4, sizes)]
        entries = b""
        for tag, kind, values in sorted(fields):
            code, width_ = _KINDS[kind]
            raw = struct.pack(f"{order}{len(values)}{code}", *values)
            if len(raw) > 4:
                out += b"\0" * (len(out) % 2)
                entries += struct.pack(order + "HHII", tag, kind, len(values), len(out))
                out += raw
            else:
                entries += struct.pack(order + "HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
        out += b"\0" * (len(out) % 2)
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(fields)) + entries
        link = len(out)
        out += struct.pack(order + "I", 0)
    return bytes(out)


def _directories(data: bytes) -> Iterator[tuple[str, dict[int, list[int]]]]:
    """Byte order and integer fields of each image directory, along their links; a loop of links ends the walk."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(data[:4])
    if order is None or len(data) < 8:
        raise BadTiff("no TIFF header")
    (at,) = struct.unpack_from(order + "I", data, 4)
    seen = set()
    while at and at not in seen:
        seen.add(at)
        try:
            (n,) = struct.unpack_from(order + "H", data, at)
            fields = {}
            for i in range(n):
                tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
                if kind in _KINDS:
                    code, size = _KINDS[kind]
                    place = at + 10 + 12 * i
                    if size * count > 4:
                        (place,) = struct.unpack_from(order + "I", data, place)
                    if place + size * count > len(data):
                        raise BadTiff("a field lies outside the file")
                    fields[tag] = list(struct.unpack_from(f"{order}{count}{code}", data, place))
            following = at + 2 + 12 * n
            (at,) = struct.unpack_from(order + "I", data, following)
        except struct.error:
            raise BadTiff("a directory lies outside the file") from None
        yield order, fields


def _decode(data: bytes, fields: dict[int, list[int]]) -> Page:
    one = lambda tag, default=None: (fields.get(tag) or [default])[0]
    width, height, samples = one(WIDTH, 0), one(LENGTH, 0), one(SAMPLES, 1)
    scheme, predictor, planes = one(COMPRESSION, NONE), one(PREDICTOR, PLAIN), one(PLANAR, 1)
    if not (0 < width and 0 < height and 0 < samples <= 16 and width * height * samples <= MAX_BYTES):
        raise BadTiff("width, length or samples out of range")
    if any(b != 8 for b in fields.get(BITS, [1])):
        raise BadTiff("samples that aren't 8 bits")
    if predictor not in (PLAIN, DIFFERENCE):
        raise BadTiff(f"predictor {predictor}")
    depth = 1 if planes == 2 else samples
    tiled = TILE_OFFSETS in fields
    wide = one(TILE_WIDTH, 0) if tiled else width
    tall = one(TILE_LENGTH, 0) if tiled else min(one(ROWS_PER_STRIP, height), height)
    if wide < 1 or tall < 1 or wide * tall * depth > MAX_BYTES:
        raise BadTiff("strips or tiles without a size")
    down, across = -(-height // tall), -(-width // wide)
    offsets = fields.get(TILE_OFFSETS if tiled else STRIP_OFFSETS, [])
    sizes = fields.get(TILE_BYTES if tiled else STRIP_BYTES, [])
    count = down * across * (samples if planes == 2 else 1)
    if len(offsets) < count or len(sizes) < count:
        raise BadTiff("strips or tiles are missing")
    image = np.zeros((height, width, samples), np.uint8)
    for k in range(count):
        plane, place = divmod(k, down * across)
        i, j = divmod(place, across)
        rows = tall if tiled else min(tall, height - i * tall)
        block = np.frombuffer(decompress(data[offsets[k] : offsets[k] + sizes[k]], scheme, rows * wide * depth), np.uint8).reshape(rows, wide, depth)
        if predictor == DIFFERENCE:
            block = np.cumsum(block, axis=1, dtype=np.uint8)
        top, left = i * tall, j * wide
        part = block[: height - top, : width - left]
        if planes == 2:
            image[top : top + tall, left : left + wide, plane] = part[:, :, 0]
        else:
            image[top : top + tall, left : left + wide] = part
    return Page(width, height, samples, scheme, predictor, count, image.tobytes())


def read(data: bytes | None) -> Iterator[Page | BadTiff]:
    """The pages of a file in order; a page that can't be decoded gives its error, a broken walk ends with one."""
    try:
        for _, fields in _directories(data or b""):
            try:
                yield _decode(data, fields)
            except BadTiff as e:
                yield e
    except BadTiff as e:
        yield e


def feature(page: Page) -> str:
    """Size, mean, spread and mean vertical step of a page's samples, as text."""
    raw = np.frombuffer(page.pixels, np.uint8).reshape(page.height, -1)
    # sums of small integers are exact, so the text doesn't depend on the order of summing
    n, total, squares = raw.size, int(raw.sum(dtype=np.int64)), int((raw.astype(np.uint32) ** 2).sum(dtype=np.int64))
    steps = int(np.abs(np.diff(raw.astype(np.int16), axis=0)).sum(dtype=np.int64))
    spread = max(0.0, squares / n - (total / n) ** 2) ** 0.5
    return f"{page.width}x{page.height}x{page.samples} mean={total / n:.4f} sd={spread:.4f} step={steps / n:.4f}"


def pages(df: DataFrame, content_col: str = "content", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per page of each TIFF in a binary column.

    Returns the columns ``keep``, media_bytes, media_sha256 (of the file), page (from 0), width,
    height, samples, compression, predictor, parts (strips or tiles), pixels, feature and error. A
    value without pages gives page 0 with an error. Other columns are ignored; repeated rows give
    repeated pages; names in ``keep`` must not be among the returned ones.
    """
    names = ["width", "height", "samples", "compression", "predictor", "parts"]
    kept = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    schema = f"{kept}, media_bytes bigint, media_sha256 string, page int, " + ", ".join(f"{n} int" for n in names) + ", pixels binary, feature string, error string"

    def make():
        def work(batch: pa.RecordBatch):
            contents = batch.column("_content")
            rows, size, at = [], 0, []
            for k in range(batch.num_rows):
                content = contents[k].as_py()
                digest = hashlib.sha256(content or b"").hexdigest()
                for n, page in enumerate(list(read(content)) or [BadTiff("no pages")]):
                    good = page if isinstance(page, Page) else None
                    rows.append((len(content or b""), digest, n, *(good and getattr(good, a) for a in names), good and good.pixels, good and feature(good), None if good else str(page)))
                    at.append(k)
                    size += len(good.pixels) if good else 0
                # a few MB at a time, so that the pages of a batch don't stand beside one another
                if rows and (size > 1 << 23 or k == batch.num_rows - 1):
                    columns = ["media_bytes", "media_sha256", "page", *names, "pixels", "feature", "error"]
                    yield {c: batch.column(f"_keep{i}").take(pa.array(at)) for i, c in enumerate(keep)} | dict(zip(columns, zip(*rows)))
                    rows, size, at = [], 0, []

        return work

    return arrow_map(df, {f"_keep{i}": c for i, c in enumerate(keep)} | {"_content": content_col}, schema, make)


def store_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_bytes: int = 192) -> DataFrame:
    """Each text's UTF-8 bytes, padded with spaces to whole rows, as a one-page grey TIFF: id_col, n_bytes, content.

    The payload's crc32 deals the files over the schemes, whatever their size: an eighth uses
    PackBits, an eighth LZW, the others deflate, with the predictor in two thirds of the files and
    tiles in a quarter. Equal texts thus give equal files.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def make():
        def store(raw: bytes) -> bytes:
            payload = raw + b" " * (-len(raw) % row_bytes or (0 if raw else row_bytes))
            mark = zlib.crc32(payload)
            scheme = {0: PACKBITS, 1: LZW}.get(mark % 8, DEFLATE)
            image = np.frombuffer(payload, np.uint8).reshape(-1, row_bytes)
            return encode([image], scheme, DIFFERENCE if mark // 8 % 3 else PLAIN, tile=64 if mark // 24 % 4 == 0 else 0)

        def work(batch: pa.RecordBatch):
            # a few MB at a time, so that the files of a batch don't stand beside one another
            raws = [t.encode() for t in (x or "" for x in batch.column("text").to_pylist())]
            start = 0
            while start < len(raws):
                stop, size = start, 0
                while stop < len(raws) and size < 1 << 23:
                    size += len(raws[stop])
                    stop += 1
                yield {id_col: batch.column("key").slice(start, stop - start), "n_bytes": list(map(len, raws[start:stop])), "content": list(map(store, raws[start:stop]))}
                start = stop

        return work

    return arrow_map(df, {"key": id_col, "text": text_col}, f"`{id_col}` {kind}, n_bytes bigint, content binary", make)
