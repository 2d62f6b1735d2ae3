"""Date, place and length of pictures and videos by one operator."""

import datetime

from pyspark.sql import functions as F

from framesift.operators import filemeta
from framesift.sources.pictures import exif_jpeg

_ROW = "mime string, content binary, taken timestamp, place string, seconds double"
_META = lambda: filemeta.file_meta(F.col("mime"), F.col("content"), F.col("taken"), F.col("place"), F.col("seconds"))


def test_kinds_and_missing_fields(spark):
    at = datetime.datetime(1969, 12, 31, 23, 59, 30, tzinfo=datetime.timezone.utc)
    jpeg = exif_jpeg(2, "2023:04:05 06:07:08")
    rows = [
        ("image/jpeg", jpeg, at, "+1+2/", 9.0), ("image/jpeg", b"no picture", at, "+1+2/", 9.0), ("image/jpeg", None, at, "+1+2/", 9.0), ("image/png", jpeg, at, "+1+2/", 9.0),
        ("video/mp4", jpeg, at, "+53.5-009.25+021.300/", 360000.4), ("video/mp4", None, None, None, None), ("video/webm", None, at, "north", 0.0),
        ("text/plain", jpeg, at, "+1+2/", 9.0), (None, jpeg, at, "+1+2/", 9.0),
    ]
    found = [tuple(r.m) for r in spark.createDataFrame(rows, _ROW).coalesce(1).select(_META().alias("m")).collect()]
    nothing = (None,) * 9
    assert found[0][:6] == ("2023", "04", "05", "06", "07", "+01:00") and found[0][6] > 2 and found[0][8] is None
    assert found[4] == ("1969", "12", "31", "23", "59", None, 53.5, -9.25, "100:00:00")
    assert found[6] == ("1969", "12", "31", "23", "59", None, None, None, None)
    assert [found[i] for i in (1, 2, 3, 5, 7, 8)] == [nothing] * 6
    assert spark.createDataFrame([], _ROW).select(_META().alias("m")).count() == 0


def test_dates_dont_depend_on_the_time_zone(spark):
    rows = spark.range(200).select((F.col("id") * 13 * 3600 * 1_000_000 - 10**15).alias("us")).select(F.timestamp_micros("us").alias("taken"), "us")
    fields = filemeta.video_meta(F.col("taken"), F.lit("x"), F.lit(1.0))
    texts = {}
    for zone in ("America/New_York", "UTC"):
        before = spark.conf.get("spark.sql.session.timeZone")
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            texts[zone] = [tuple(r) for r in rows.orderBy("us").select(*(fields[c] for c in ("year", "month", "day", "hour", "minute"))).collect()]
        finally:
            spark.conf.set("spark.sql.session.timeZone", before)
    assert texts["America/New_York"] == texts["UTC"]
    epoch = datetime.datetime(1970, 1, 1)
    want = [(epoch + datetime.timedelta(seconds=i * 13 * 3600 - 10**9)).strftime("%Y %m %d %H %M").split() for i in range(200)]
    assert [list(t) for t in texts["UTC"]] == want
