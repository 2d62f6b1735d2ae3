"""Orientation of pictures: every turn and its inverse, damaged and missing values."""

import numpy as np
import pytest

from framesift.operators import orient
from framesift.sources.pictures import directory, exif_jpeg, segment


def jpeg(order, value, kind=3):
    tiff = (b"II" if order == "<" else b"MM") + np.array([42], order + "u2").tobytes() + np.array([8], order + "u4").tobytes()
    return b"\xff\xd8" + segment(0xE1, b"Exif\0\0" + tiff + directory(order, 8, [(0x0112, kind, 1, np.array([value], order + "u2").tobytes())])) + segment(0xDA, b"")


@pytest.mark.parametrize("order", "<>")
def test_reading(order):
    assert [orient.read_orientation(jpeg(order, v)) for v in range(10)] == [1, 1, 2, 3, 4, 5, 6, 7, 8, 1]
    assert orient.read_orientation(jpeg(order, 6, kind=2)) == 1
    whole = jpeg(order, 6)
    assert {orient.read_orientation(whole[:k]) for k in range(len(whole))} <= {1, 6}
    assert [orient.read_orientation(x) for x in (None, b"", b"\xff\xd8", exif_jpeg(3, "2024:03:15 10:42:00"))] == [1] * 4


def test_turns():
    """A letter F as stored under each orientation reads as an F once it is upright."""
    letter = np.array([[1, 1, 1], [1, 0, 0], [1, 1, 0], [1, 0, 0]], np.uint32)
    stored = {1: letter, 2: np.fliplr(letter), 3: np.rot90(letter, 2), 4: np.flipud(letter), 5: letter.T, 6: np.rot90(letter, 1), 7: np.rot90(letter, 2).T, 8: np.rot90(letter, -1)}
    for value, pixels in stored.items():
        height, width = pixels.shape
        assert orient.upright(np.ascontiguousarray(pixels).tobytes(), width, height, value) == letter.tobytes(), value


def test_rows_without_a_turn(spark):
    rows = [(0, 2, 1, b"abcdefgh", None), (1, 2, 1, b"abcdefgh", 9), (2, 2, 1, None, 6), (3, 2, 2, b"abcdefgh", 6), (4, None, 1, b"abcd", 6), (5, 2, 1, b"abcdefgh", 6), (6, 2, 1, b"abcdefgh", 2), (7, 0, 0, b"", 6)]
    df = spark.createDataFrame(rows, "id int, width int, height int, rgba binary, orientation int")
    found = {r.id: (r.width, r.height, r.rgba and bytes(r.rgba)) for r in orient.oriented(df).collect()}
    assert found[0] == found[1] == (2, 1, b"abcdefgh")
    assert found[2] == (2, 1, None) and found[3] == (2, 2, b"abcdefgh") and found[4] == (None, 1, b"abcd")
    assert found[5] == (1, 2, b"abcdefgh") and found[6] == (2, 1, b"efghabcd") and found[7][:2] == (0, 0)
    assert orient.oriented(df.limit(0)).count() == 0
