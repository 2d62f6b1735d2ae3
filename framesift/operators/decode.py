"""Packets to frames through decoders that may fail: groups by key frame, tried in order and replayed whole."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame

from framesift.sources.files import BATCH


class Decoder(Protocol):
    """A session for one group of packets. Any exception means that this mode can't decode the group."""

    def decode(self, packet: dict) -> list[tuple[int, bytes]]:
        """Frames (pts_us, pixels) that are ready after a packet (n, key, pts_us, dur_us, data)."""

    def flush(self) -> list[tuple[int, bytes]]:
        """The frames that are left."""


Modes = list[tuple[str, Callable[[], Decoder]]]


def through(packets: list[dict], modes: Modes) -> tuple[str | None, dict[int, bytes], str | None]:
    """The first mode that decodes all packets, its frames by time, and the last failure if there is none."""
    failure, times = "no decoder", {p["pts_us"] for p in packets}
    for name, open_decoder in modes:
        try:
            decoder, frames = open_decoder(), {}
            for found in (*map(decoder.decode, packets), decoder.flush()):
                for at, pixels in found:
                    if at in times:
                        frames.setdefault(at, pixels)
            return name, frames, None
        except Exception as error:
            failure = f"{name}: {error}"
    return None, {}, failure


def decoded(packets: DataFrame, modes: Modes) -> DataFrame:
    """path, gop, pts_us, mode, frame and error of ``packets`` (path, gop, n, key, pts_us, dur_us, data).

    A group (equal path and gop, see ``sources.movies``) goes through the ``modes`` in order, each with a session of its own.
    One that fails part of the way leaves nothing: the next gets the whole group again, so no frame is
    lost or there twice. A group that no mode decodes is one row with its error; others go
    on. Frames at a time that no packet of the group has are left out, of several at one time
    the first stays. Rows without path, gop or n are left out.

    Groups of all files are dealt over the tasks and stream through them in order; one group is held at a time.
    """
    schema = "path string, gop bigint, pts_us bigint, mode string, frame binary, error string"
    types = [("path", pa.string()), ("gop", pa.int64()), ("pts_us", pa.int64()), ("mode", pa.string()), ("frame", pa.binary()), ("error", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, out, size = None, [], [], 0

        def finished() -> list[tuple]:
            if not held:
                return []
            mode, frames, failure = through(held, modes)
            return [(*group, None, None, None, failure)] if mode is None else [(*group, at, mode, pixels, None) for at, pixels in sorted(frames.items())]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), types)], schema=pa.schema(types))

        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                if (row["path"], row["gop"]) != group:
                    for found in finished():
                        out.append(found)
                        size += len(found[4] or b"")
                        if size >= BATCH or len(out) >= 4096:
                            yield batch_of(out)
                            out, size = [], 0
                    group, held = (row["path"], row["gop"]), []
                held.append(row)
        out += finished()
        if out:
            yield batch_of(out)

    rows = packets.select("path", "gop", "n", "key", "pts_us", "dur_us", "data").where("path IS NOT NULL AND gop IS NOT NULL AND n IS NOT NULL")
    return rows.repartition("path", "gop").sortWithinPartitions("path", "gop", "n").mapInArrow(run, schema)
