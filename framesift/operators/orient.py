"""Pictures put upright by the orientation in their EXIF data: a permutation of pixels."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framesift.operators import exif

#: The EXIF tag, and for its values (rows reversed, columns reversed, rows and columns exchanged afterwards) (fixed values).
ORIENTATION = 0x0112
TURNS = {
    1: (False, False, False), 2: (False, True, False), 3: (True, True, False), 4: (True, False, False),
    5: (False, False, True), 6: (True, False, True), 7: (True, True, True), 8: (False, True, True),
}


def read_orientation(jpeg: bytes | None) -> int:
    """1 to 8; 1 where there is none, or another number."""
    tiff = exif.Tiff(exif.find_exif((jpeg or b"")[: exif.HEAD]))
    top = tiff.entries(tiff.number(4, "I")) if tiff.good else {}
    kind, _, place = top.get(ORIENTATION, (0, 0, 0))
    found = tiff.number(place, "H") if kind == 3 else None
    return found if found in TURNS else 1


def upright(rgba: bytes | None, width: int | None, height: int | None, orientation: int | None) -> bytes | None:
    rows, columns, exchanged = TURNS.get(orientation, TURNS[1])
    if rgba is None or width is None or height is None or len(rgba) != width * height * 4:
        return rgba
    pixels = np.frombuffer(rgba, np.uint32).reshape(height, width)[:: -1 if rows else 1, :: -1 if columns else 1]
    return np.ascontiguousarray(pixels.T if exchanged else pixels).tobytes()


def orientation(jpeg: Column) -> Column:
    """The orientation that a JPEG (or its first 64 KiB) names; 1 for null."""

    @F.arrow_udf("int")
    def read(jpegs: pa.Array) -> pa.Array:
        return pa.array((read_orientation(j.as_py()) for j in jpegs), pa.int32())

    return read(jpeg)


def oriented(pictures: DataFrame) -> DataFrame:
    """``pictures`` (width, height, rgba, orientation, ...) upright; width and height change places where the turn exchanges them.

    An orientation that is null or not 1 to 8 turns nothing. Pixels that are null or don't fit the
    size, and their sizes, stay as they are.
    """

    @F.arrow_udf("binary")
    def turned(rgba: pa.Array, width: pa.Array, height: pa.Array, to: pa.Array) -> pa.Array:
        return pa.array((upright(*(x.as_py() for x in row)) for row in zip(rgba, width, height, to)), pa.binary())

    fits = F.coalesce(F.length("rgba") == F.col("width").cast("bigint") * F.col("height") * 4, F.lit(False))
    exchanged = F.coalesce(F.col("orientation").isin([k for k, turn in TURNS.items() if turn[2]]), F.lit(False)) & fits
    side = lambda a, b: F.when(exchanged, F.col(b)).otherwise(F.col(a))
    return pictures.withColumns({"width": side("width", "height"), "height": side("height", "width"), "rgba": turned("rgba", "width", "height", "orientation")})
