"""What a file's own bytes and tags say about it: date, place and length, whichever kind of file it is.

Pictures are read out of their EXIF segment, videos out of their container's tags; both give the
same fields, so that names and filters needn't know the kind. A field that isn't there is null;
so are all fields of other kinds of files, of pictures that aren't JPEGs and of a null type.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from framesift.functions import media as m
from framesift.functions import timecode
from framesift.operators import exif

DAY_US, HOUR_US, MINUTE_US = 86_400_000_000, 3_600_000_000, 60_000_000


def video_meta(taken: Column, place: Column, seconds: Column) -> dict[str, Column]:
    """Fields of a video from its date tag, its coordinate tag and its length.

    The date is split in UTC by arithmetic, whatever the session's time zone. A coordinate tag that
    can't be read gives no place, a length that isn't positive none.
    """
    us = F.unix_micros(taken.cast("timestamp"))
    day = F.date_from_unix_date(F.floor(us / DAY_US).cast("int"))
    of_day = F.pmod(us, F.lit(DAY_US))
    two = lambda n: F.lpad(F.floor(n).cast("string"), 2, "0")
    lat, lon = m.iso6709(place)
    return {
        "year": F.year(day).cast("string"),
        "month": two(F.month(day)),
        "day": two(F.dayofmonth(day)),
        "hour": two(of_day / HOUR_US),
        "minute": two(of_day % HOUR_US / MINUTE_US),
        "timezone": F.lit(None).cast("string"),
        "lat": lat,
        "lon": lon,
        "duration": timecode.hms(seconds),
    }


def file_meta(mime: Column, content: Column, taken: Column, place: Column, seconds: Column) -> Column:
    """Struct of year, month, day, hour, minute, timezone, lat, lon and duration of a picture or video.

    ``content`` (its head is enough) is read for JPEGs alone, the other columns for videos alone.
    Rows are independent: ties and repeated rows need no rule, an empty table gives an empty one.
    """
    jpeg, video = mime == "image/jpeg", mime.startswith("video/")
    found = exif.exif_meta(F.when(jpeg, F.substring(content, 1, exif.HEAD)))
    fields = video_meta(taken, place, seconds)
    return F.struct(*(F.when(video, v).when(jpeg, found[k] if k != "duration" else F.lit(None).cast("string")).alias(k) for k, v in fields.items()))
