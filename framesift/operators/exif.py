"""EXIF in JPEG bytes: find it, read date, zone and place, cut it down to the place, put it into another JPEG.

Bounds are checked everywhere: a field that points outside its segment counts as missing.
"""

from __future__ import annotations

import re
import struct

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of a picture that are searched for metadata (fixed value).
HEAD = 65536
#: Sizes of the TIFF field types 1 to 12 in bytes (fixed values).
SIZES = dict(enumerate((1, 1, 2, 4, 8, 1, 1, 2, 4, 8, 4, 8), 1))
EXIF, GPS, TAKEN, CHANGED, ZONE = 0x8769, 0x8825, 0x9003, 0x0132, 0x9011

FIELDS = ("year", "month", "day", "hour", "minute", "timezone")


def find_exif(jpeg: bytes | None) -> bytes | None:
    """The first EXIF segment before the picture data, marker included; None if there is none."""
    at, jpeg = 2, jpeg or b""
    while at + 4 <= len(jpeg) and jpeg[at] == 0xFF and jpeg[at + 1] != 0xDA:
        size = int.from_bytes(jpeg[at + 2 : at + 4], "big")
        if jpeg[at + 1] == 0xE1 and jpeg[at + 4 : at + 10] == b"Exif\0\0":
            return jpeg[at : at + 2 + size]
        at += 2 + size
    return None


class Tiff:
    """Directories of the TIFF part of an EXIF segment."""

    def __init__(self, segment: bytes | None):
        self.data = (segment or b"")[10:]
        self.order = "<" if self.data[:1] == b"I" else ">"
        self.good = len(self.data) >= 8 and self.number(2, "H") == 42

    def number(self, at: int, kind: str) -> int | None:
        try:
            return struct.unpack_from(self.order + kind, self.data, at)[0]
        except struct.error:
            return None

    def entries(self, at: int | None) -> dict[int, tuple[int, int, int]]:
        """Tag -> type, count and place of the value field; the first of equal tags counts."""
        found: dict[int, tuple[int, int, int]] = {}
        n = None if at is None else self.number(at, "H")
        for i in range(n or 0):
            place = at + 2 + 12 * i
            tag, kind, count = (self.number(place + o, k) for o, k in ((0, "H"), (2, "H"), (4, "I")))
            if count is None or place + 12 > len(self.data):
                break
            found.setdefault(tag, (kind, count, place + 8))
        return found

    def pointer(self, entries: dict, tag: int) -> int | None:
        return self.number(entries[tag][2], "I") if tag in entries else None

    def value(self, entry: tuple[int, int, int]) -> bytes | None:
        kind, count, place = entry
        size = SIZES.get(kind, 1) * count
        start = place if size <= 4 else self.number(place, "I")
        raw = self.data[start : start + size] if start is not None else b""
        return raw if len(raw) == size else None

    def text(self, entries: dict, tag: int) -> str | None:
        if tag not in entries or entries[tag][0] != 2:
            return None
        raw = self.value(entries[tag])
        return None if raw is None else raw[:-1].decode("latin-1")

    def degrees(self, entries: dict, tag: int) -> float | None:
        if tag not in entries or entries[tag][1] != 3:
            return None
        start = self.number(entries[tag][2], "I")
        parts = [self.number((start or 0) + 4 * i, "I") for i in range(6)]
        if start is None or None in parts:
            return None
        d, m, s = (a / b if b else 0.0 for a, b in zip(parts[::2], parts[1::2]))
        return d + m / 60 + s / 3600


def read_meta(jpeg: bytes | None) -> dict[str, object]:
    """year, month, day, hour, minute, timezone (text) and lat, lon (decimal degrees) as far as they are there."""
    tiff = Tiff(find_exif((jpeg or b"")[:HEAD]))
    if not tiff.good:
        return {}
    top = tiff.entries(tiff.number(4, "I"))
    exif, gps = tiff.entries(tiff.pointer(top, EXIF)), tiff.entries(tiff.pointer(top, GPS))
    found: dict[str, object] = {}
    taken = tiff.text(exif, TAKEN)
    taken = tiff.text(top, CHANGED) if taken is None else taken
    if taken and (m := re.fullmatch(r"([0-9]{4}):([0-9]{2}):([0-9]{2}) ([0-9]{2}):([0-9]{2}):[0-9]{2}", taken)):
        found |= dict(zip(FIELDS, m.groups()))
    zone = tiff.text(exif, ZONE)
    if zone and re.fullmatch(r"[+-][0-9]{2}:[0-9]{2}", zone):
        found["timezone"] = zone
    lat, lon = tiff.degrees(gps, 2), tiff.degrees(gps, 4)
    if lat is not None and lon is not None:
        found["lat"] = -lat if (tiff.text(gps, 1) or "").strip() == "S" else lat
        found["lon"] = -lon if (tiff.text(gps, 3) or "").strip() == "W" else lon
    return found


def place_only(jpeg: bytes | None) -> bytes | None:
    """An EXIF segment with the place directory alone, in the same byte order; None if the picture has none."""
    tiff = Tiff(find_exif(jpeg))
    gps_at = tiff.pointer(tiff.entries(tiff.number(4, "I")), GPS) if tiff.good else None
    if gps_at is None:
        return None
    kept = [(tag, kind, count, raw) for tag, (kind, count, at) in tiff.entries(gps_at).items() if (raw := tiff.value((kind, count, at))) is not None]
    pack = lambda f, *v: struct.pack(tiff.order + f, *v)
    start = 8 + 18  # after the header and a directory of one entry
    body, tail = pack("H", len(kept)), b""
    for tag, kind, count, raw in kept:
        far = len(raw) > 4
        body += pack("HHI", tag, kind, count) + (pack("I", start + 6 + 12 * len(kept) + len(tail)) if far else raw.ljust(4, b"\0"))
        tail += raw if far else b""
    mark = b"II" if tiff.order == "<" else b"MM"
    out = mark + pack("HI", 42, 8) + pack("H", 1) + pack("HHII", GPS, 4, 1, start) + pack("I", 0) + body + pack("I", 0) + tail
    payload = b"Exif\0\0" + out
    return b"\xff\xe1" + (len(payload) + 2).to_bytes(2, "big") + payload


def inject(jpeg: bytes | None, segment: bytes | None) -> bytes | None:
    """The JPEG with its leading application segments replaced by ``segment`` (None: by nothing)."""
    if jpeg is None:
        return None
    at = 2
    while at + 4 <= len(jpeg) and jpeg[at] == 0xFF and 0xE0 <= jpeg[at + 1] <= 0xEF:
        at += 2 + int.from_bytes(jpeg[at + 2 : at + 4], "big")
    return jpeg[:2] + (segment or b"") + jpeg[at:]


def carry_over(source: bytes | None, target: bytes | None, mode: str) -> bytes | None:
    """The target picture with the source's EXIF: all of it (keep), its place (gps) or none (strip)."""
    segment = {"keep": find_exif, "gps": place_only}.get(mode, lambda _: None)(source)
    return target if segment is None and mode != "strip" else inject(target, segment)


_META = ", ".join(f"{c} string" for c in FIELDS) + ", lat double, lon double"


def exif_meta(jpeg: Column) -> Column:
    """Struct of the fields of ``read_meta``, null where missing."""
    kinds = [(c, pa.string()) for c in FIELDS] + [("lat", pa.float64()), ("lon", pa.float64())]

    @F.arrow_udf(_META)
    def read(jpegs: pa.Array) -> pa.Array:
        rows = [read_meta(j) for j in jpegs.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([r.get(c) for r in rows], t) for c, t in kinds], [c for c, _ in kinds])

    return read(jpeg)


def exif_segment(jpeg: Column) -> Column:
    @F.arrow_udf("binary")
    def segment(jpegs: pa.Array) -> pa.Array:
        return pa.array([find_exif(j) for j in jpegs.to_pylist()], pa.binary())

    return segment(jpeg)


def exif_carried(source: Column, target: Column, mode: str) -> Column:
    """``carry_over`` of two binary columns."""

    @F.arrow_udf("binary")
    def carried(sources: pa.Array, targets: pa.Array) -> pa.Array:
        return pa.array([carry_over(s, t, mode) for s, t in zip(sources.to_pylist(), targets.to_pylist())], pa.binary())

    return carried(source, target)


def exif_stripped_and_back(jpeg: Column) -> Column:
    """Struct of the picture without its application segments (bare) and of that with the picture's own EXIF put back (again).

    One pass: as two calls of ``exif_carried`` each task would keep a Python worker for each, and send the pictures through both.
    """

    def both(raw: bytes | None) -> dict:
        bare = carry_over(raw, raw, "strip")
        return {"bare": bare, "again": carry_over(raw, bare, "keep")}

    @F.arrow_udf("bare binary, again binary")
    def carried(jpegs: pa.Array) -> pa.Array:
        return pa.array([both(x.as_py()) for x in jpegs], pa.struct([("bare", pa.binary()), ("again", pa.binary())]))

    return carried(jpeg)
