"""Packets of movies in the ISO base media format (ISO/IEC 14496-12): written from rows, read back by a data source.

A movie keeps a track's packets in chunks, and in run-length tables their durations, composition
offsets, sizes, numbers in a chunk, places of chunks and key frames. The reader expands the tables
and reads only the bytes of packets that are asked for. Nothing is decoded; movies in fragments are
read as having no packets in their tables.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from framesift.sources import files

#: Microseconds, the unit of written movies.
SCALE = 1_000_000
SCHEMA = "path string, n bigint, gop bigint, key boolean, pts_us bigint, dur_us bigint, offset bigint, size bigint, data binary, error string"
ARROW = pa.schema([
    ("path", pa.string()), ("n", pa.int64()), ("gop", pa.int64()), ("key", pa.bool_()), ("pts_us", pa.int64()), ("dur_us", pa.int64()),
    ("offset", pa.int64()), ("size", pa.int64()), ("data", pa.binary()), ("error", pa.string()),
])


def box(kind: str, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind.encode()) + body


def full(kind: str, version: int, *parts: bytes) -> bytes:
    return box(kind, bytes((version, 0, 0, 0)), *parts)


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and values of the runs of equal values."""
    values = np.asarray(values)
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, int)
    return np.diff(np.r_[starts, len(values)]), values[starts]


def table(*columns: np.ndarray, kind: str = ">u4") -> bytes:
    """The number of rows, then the rows."""
    return struct.pack(">I", len(columns[0])) + np.stack(columns, axis=1).astype(kind).tobytes()


def movie(start: int, durations: list[int], keys: list[bool], packets: list[bytes], shifts: list[int] | None = None, per_chunk: int = 5) -> bytes:
    """A movie of one video track that begins at ``start`` microseconds; ``shifts`` move packets from decoding to presentation time."""
    n = len(packets)
    ftyp = box("ftyp", b"isom", struct.pack(">I", 512), b"isom")
    sizes = np.array([len(p) for p in packets], np.int64)
    firsts = np.arange(0, n, per_chunk)
    data_at = len(ftyp) + 16
    places = (data_at + np.r_[0, np.cumsum(sizes)])[firsts] if n else np.zeros(0, np.int64)
    mdat = struct.pack(">I4sQ", 1, b"mdat", 16 + int(sizes.sum())) + b"".join(packets)
    each, count = runs(np.minimum(per_chunk, n - firsts))
    chunk = 1 + np.r_[0, np.cumsum(each)[:-1]] if n else np.zeros(0, int)
    wide = n > 0 and places[-1] >= 1 << 32
    tables = [full("stsd", 0, struct.pack(">I", 0)), full("stts", 0, table(*runs(np.array(durations, np.int64))))]
    if shifts:
        tables.append(full("ctts", 1, table(*runs(np.array(shifts, np.int64)), kind=">i4")))
    if not all(keys):
        tables.append(full("stss", 0, table(np.flatnonzero(keys) + 1)))
    tables.append(full("stsc", 0, table(chunk, count, np.ones(len(count), int))))
    tables.append(full("stsz", 0, struct.pack(">I", 0), table(sizes)))
    tables.append(full("co64" if wide else "stco", 0, table(places, kind=">u8" if wide else ">u4")))
    length = int(sum(durations))
    edits = full("elst", 1, struct.pack(">I", 2), struct.pack(">QqI", start, -1, 1 << 16), struct.pack(">QqI", length, 0, 1 << 16))
    media = [full("mdhd", 1, struct.pack(">QQIQI", 0, 0, SCALE, length, 0)), full("hdlr", 0, struct.pack(">I4s13x", 0, b"vide"))]
    track = box("trak", box("edts", edits), box("mdia", *media, box("minf", box("stbl", *tables))))
    return ftyp + mdat + box("moov", full("mvhd", 1, struct.pack(">QQIQ80x", 0, 0, SCALE, start + length)), track)


class Damaged(Exception):
    """A file that isn't a whole movie."""


def children(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Kind and body of the boxes that follow one another."""
    at = 0
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1 and at + 16 <= len(data):
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        size = len(data) - at if size == 0 else size
        if size < head or at + size > len(data):
            raise Damaged("a box ends outside the one around it")
        yield kind, data[at + head : at + size]
        at += size


def child(data: bytes, *path: bytes) -> bytes | None:
    """The first box along a path of kinds."""
    for kind in path:
        data = next((body for k, body in children(data) if k == kind), None)
        if data is None:
            return None
    return data


def rows_of(body: bytes | None, width: int, kind: str = ">u4", skip: int = 4) -> np.ndarray:
    """A table's rows of ``width`` numbers; an absent table has none."""
    if body is None:
        return np.zeros((0, width), np.int64)
    n = int.from_bytes(body[skip : skip + 4], "big")
    size = n * width * np.dtype(kind).itemsize
    if len(body) < skip + 4 + size:
        raise Damaged("a table is cut off")
    return np.frombuffer(body, kind, n * width, skip + 4).astype(np.int64).reshape(n, width)


def movie_box(file: pa.NativeFile, length: int) -> bytes:
    """The movie's tables; the boxes around them are stepped over by their headers."""
    at = 0
    while at + 8 <= length:
        head = file.read_at(16, at)
        size, kind = struct.unpack_from(">I4s", head)
        start = 8
        if size == 1 and len(head) == 16:
            size, start = struct.unpack_from(">Q", head, 8)[0], 16
        size = length - at if size == 0 else size
        if size < start or at + size > length:
            raise Damaged("a box ends outside the file")
        if kind == b"moov":
            return file.read_at(size - start, at + start)
        at += size
    raise Damaged("no movie box")


def timescale(header: bytes | None) -> int:
    at = 20 if header and header[0] == 1 else 12
    found = int.from_bytes((header or b"")[at : at + 4], "big")
    if not found:
        raise Damaged("no unit of time")
    return found


@dataclass
class Packets:
    """Times in microseconds, places, sizes and key frames of a track's packets, in decoding order."""

    pts: np.ndarray
    dur: np.ndarray
    offset: np.ndarray
    size: np.ndarray
    key: np.ndarray


def expand(moov: bytes, length: int) -> Packets:
    """The packets of the first video track of a file of ``length`` bytes, out of its run-length tables."""
    tracks = [body for kind, body in children(moov) if kind == b"trak"]
    video = [t for t in tracks if (child(t, b"mdia", b"hdlr") or b"")[8:12] == b"vide"]
    if not video:
        raise Damaged("no video track")
    media = child(video[0], b"mdia") or b""
    tables = child(media, b"minf", b"stbl")
    if tables is None:
        raise Damaged("no sample tables")
    unit, clock = timescale(child(media, b"mdhd")), timescale(child(moov, b"mvhd"))

    sized = child(tables, b"stsz") or b""
    same, n = (int.from_bytes(sized[at : at + 4], "big") for at in (4, 8))
    if same * n > length:
        raise Damaged("packets outside the file")
    size = np.full(n, same, np.int64) if same else rows_of(sized or None, 1, skip=8)[:, 0]
    n = len(size)
    durations = rows_of(child(tables, b"stts"), 2)
    if durations[:, 0].sum() != n:
        raise Damaged("durations and sizes differ in number")
    dur = np.repeat(durations[:, 1], durations[:, 0])
    time = np.cumsum(dur) - dur

    far = child(tables, b"co64")
    places = rows_of(far, 1, ">i8")[:, 0] if far is not None else rows_of(child(tables, b"stco"), 1)[:, 0]
    spans = rows_of(child(tables, b"stsc"), 3)
    lasting = np.diff(np.r_[spans[:, 0], len(places) + 1])
    if n and (not len(spans) or spans[0, 0] != 1 or (lasting < 0).any()):
        raise Damaged("chunks out of order")
    in_chunk = np.repeat(spans[:, 1], lasting)
    if in_chunk.sum() != n:
        raise Damaged("chunks and sizes differ in number")
    before = np.cumsum(size) - size
    firsts = (np.cumsum(in_chunk) - in_chunk)[in_chunk > 0]
    offset = before + np.repeat(places[in_chunk > 0] - before[firsts], in_chunk[in_chunk > 0])

    shifts = rows_of(child(tables, b"ctts"), 2, ">i4")
    if len(shifts) and (shifts[:, 0].sum() != n or (shifts[:, 0] < 0).any()):
        raise Damaged("composition offsets and sizes differ in number")
    shown = time + (np.repeat(shifts[:, 1], shifts[:, 0]) if len(shifts) else 0)
    listed = child(tables, b"stss")
    key = np.full(n, listed is None)
    marks = rows_of(listed, 1)[:, 0] - 1
    if ((marks < 0) | (marks >= n)).any():
        raise Damaged("a key frame outside the track")
    key[marks] = True

    delay, origin = edits(child(video[0], b"edts", b"elst"))
    micros = lambda t, u: t if u == SCALE else (t * SCALE + u // 2) // u
    return Packets(micros(delay, clock) + micros(shown - origin, unit), micros(dur, unit), offset, size, key)


def edits(body: bytes | None) -> tuple[int, int]:
    """How long the track waits, in the movie's unit, and the media time it then begins with. Later edits aren't applied."""
    wide, delay = bool(body) and body[0] == 1, 0
    step, kind = (20, ">Qq") if wide else (12, ">Ii")
    for at in range(8, len(body or b"") - step + 1, step):
        length, origin = struct.unpack_from(kind, body, at)
        if origin >= 0:
            return delay, origin
        delay += length
    return delay, 0


@dataclass
class Part(InputPartition):
    """Stretches of files: path, length, and the bytes in which the packets begin that this task reads."""

    stretches: list[tuple[str, int, int, int]]


class PacketReader(DataSourceReader):
    """Stretches of about ``split`` bytes, packed or cut like Spark's own file splits; packets outside [start, end] are never read."""

    def __init__(self, path: str, split: int, start: int | None, end: int | None):
        self.path, self.split, self.start, self.end = path, split, start, end

    def partitions(self) -> list[Part]:
        parts, held = [[]], 0
        for info in files.listed(self.path):
            for at in range(0, max(info.size, 1), self.split):
                size = min(self.split, info.size - at)
                if parts[-1] and (held + size > self.split or len(parts[-1]) >= 1000):
                    parts, held = [*parts, []], 0
                parts[-1].append((info.path, info.size, at, at + self.split))
                held += size
        return [Part(p) for p in parts]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        system, _ = files.place(self.path)
        for path, length, low, high in partition.stretches:
            with system.open_input_file(path) as file:
                try:
                    found = expand(movie_box(file, length), length)
                    if len(found.size) and (found.offset + found.size).max() > length:
                        raise Damaged("packets outside the file")
                except Damaged as error:
                    if low == 0:
                        yield self._batch([(path, *[None] * 8, str(error))])
                    continue
                wanted = (found.offset >= low) & (found.offset < high)
                if self.start is not None:
                    wanted &= found.pts >= self.start
                if self.end is not None:
                    wanted &= found.pts <= self.end
                yield from self._packets(path, file, found, np.flatnonzero(wanted))

    def _packets(self, path: str, file: pa.NativeFile, found: Packets, wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
        groups = np.maximum.accumulate(np.where(found.key, np.arange(len(found.key)), 0))
        rows, held = [], 0
        for i in wanted.tolist():
            offset, size = int(found.offset[i]), int(found.size[i])
            rows.append((path, i, int(groups[i]), bool(found.key[i]), int(found.pts[i]), int(found.dur[i]), offset, size, file.read_at(size, offset), None))
            held += size
            if held >= files.BATCH or len(rows) >= 4096:
                yield self._batch(rows)
                rows, held = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), ARROW.types)], schema=ARROW)


class PushedReader(PacketReader):
    """Takes the bounds of pts_us from the query's filters; Spark applies the filters again, so a bound may be a little wide."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if getattr(f, "attribute", None) == ("pts_us",) and isinstance(getattr(f, "value", None), int):
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    self.start = f.value if self.start is None else max(self.start, f.value)
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    self.end = f.value if self.end is None else min(self.end, f.value)
            yield f


class MoviePackets(DataSource):
    """``movie_packets``: a row a packet, with its number in decoding order (n) and that of the key frame it depends on (gop).

    Options: ``path`` (a folder), ``splitBytes`` (64 MiB), ``startUs`` and ``endUs`` (inclusive bounds of
    pts_us), ``pushdown`` (true where the session sets ``spark.sql.python.filterPushdown.enabled``: bounds
    come from filters too). A file that isn't a movie is one row with its ``error``, other files go
    on; under bounds such rows are there as well, but a filter on pts_us drops them. A movie without packets has no row.
    """

    @classmethod
    def name(cls) -> str:
        return "movie_packets"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PacketReader:
        bound = lambda k: int(self.options[k]) if k in self.options else None
        made = PushedReader if self.options.get("pushdown") == "true" else PacketReader
        return made(self.options["path"], int(self.options.get("splitBytes", 64 << 20)), bound("startUs"), bound("endUs"))


def packets(spark: SparkSession, path: str, start_us: int | None = None, end_us: int | None = None, split: int = 64 << 20) -> DataFrame:
    """The packets of all movies under a folder, or those shown within a range of time; see ``MoviePackets``."""
    spark.dataSource.register(MoviePackets)
    bounds = {k: v for k, v in (("startUs", start_us), ("endUs", end_us)) if v is not None}
    pushed = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("movie_packets").option("path", path).option("splitBytes", split).option("pushdown", pushed).options(**bounds).load()


def movies(rows: DataFrame) -> DataFrame:
    """name and content of a movie for each name of ``rows`` (name, pts_us, frame_id, key, data), packets in the order of pts_us and frame_id.

    A packet lasts until the next one, the last one 40 ms; gaps fit in 32 bits (71 minutes). Names stream through
    sorted partitions; one movie is held at a time, as it is one object. Null data is a packet without
    bytes; null key is no key frame, but a movie's first packet always is one.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, times, keys, data = None, [], [], []

        def done() -> Iterator[pa.RecordBatch]:
            if times:
                lasting = [*np.diff(times).tolist(), 40_000]
                yield pa.RecordBatch.from_pydict({"name": [name], "content": [movie(times[0], lasting, [True, *keys[1:]], data)]}, schema=made)

        made = pa.schema([("name", pa.string()), ("content", pa.binary())])
        for batch in batches:
            for row in batch.to_pylist():
                if row["name"] != name:
                    yield from done()
                    name, times, keys, data = row["name"], [], [], []
                times.append(row["pts_us"])
                keys.append(bool(row["key"]))
                data.append(row["data"] or b"")
        yield from done()

    placed = rows.where("name IS NOT NULL AND pts_us IS NOT NULL").repartition("name").sortWithinPartitions("name", "pts_us", "frame_id")
    return placed.select("name", "pts_us", "key", "data").mapInArrow(build, "name string, content binary").withColumn("exported_at", F.lit(0))
