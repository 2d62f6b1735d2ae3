"""Names, time text, codecs and the cache, case by case."""

import pytest
from pyspark.sql import functions as F

from framesift.functions import media, naming, timecode
from framesift.operators import cache


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


VALUES = {"input": "clip", "index": "7", "year": "2024", "lat": None, "detect": "person-plate", "trick": "{input}"}


@pytest.mark.parametrize(
    "pattern, text",
    [("{input}", "clip"), ("{year}_{input}_{index}", "2024_clip_7"), ("{lat}x", "x"), ("{nope}", ""), ("", ""), ("plain", "plain"), ("{input", "{input"), ("{{input}}", "{clip}"), ("{ input }", "{ input }"), ("{trick}", "{input}"), ("{detect}{detect}", "person-plateperson-plate")],
)
def test_template(spark, pattern, text):
    values = F.create_map(*[F.lit(x) for kv in VALUES.items() for x in kv])
    assert value(spark, naming.fill(F.lit(pattern), values)) == text


@pytest.mark.parametrize("name, stem", [("a.jpg", "a"), ("a.b.mp4", "a.b"), ("none", "none"), (".hidden", ""), ("end.", "end.")])
def test_stem(spark, name, stem):
    assert value(spark, naming.stem(F.lit(name))) == stem


@pytest.mark.parametrize("text, seconds", [("1:02:03.5", 3723.5), ("2:05", 125.0), ("7.25", 7.25), ("12abc", 12.0), ("-3", None), ("", None), ("x", None), (" 4 ", 4.0), ("1:2:", 1.0)])
def test_parse_time(spark, text, seconds):
    assert value(spark, timecode.parse(F.lit(text))) == seconds


@pytest.mark.parametrize("seconds, text", [(83.4, "00:01:23"), (0.0, None), (360000.0, "100:00:00"), (None, None)])
def test_hms(spark, seconds, text):
    assert value(spark, timecode.hms(F.lit(seconds).cast("double"))) == text


@pytest.mark.parametrize("ms, text", [(4000, "almost done"), (59400, "~59s"), (61000, "~1m 01s"), (3600000, "~60m 00s")])
def test_eta(spark, ms, text):
    assert value(spark, timecode.eta_text(F.lit(float(ms)))) == text


@pytest.mark.parametrize("mode, source, rate, quality", [("quality", 10_000_000, 10_000_000, 0.95), ("filesize", 10_000_000, 5_000_000, 0.65), ("filesize", 5, 3, 0.65), ("quality", None, None, 0.95), ("filesize", None, None, 0.65)])
def test_export_mode(spark, mode, source, rate, quality):
    assert value(spark, media.effective_bitrate(F.lit(mode), F.lit(source).cast("bigint"))) == rate
    assert value(spark, media.jpeg_quality(F.lit(mode))) == quality


@pytest.mark.parametrize("stored, wanted", [("{}", "keep"), ('{"keepMetadata":true}', "keep"), ('{"keepMetadata":false}', "strip"), ('{"keepMetadata":"gps"}', "gps"), ("broken", "keep"), (None, "keep")])
def test_config(spark, stored, wanted):
    assert value(spark, media.merged_config(F.lit(stored).cast("string"))["keep_metadata"]) == wanted


def replay(spark, log, capacity):
    rows = spark.createDataFrame([(1, i, k, g) for i, (k, g) in enumerate(log)], "file_id int, i int, key string, is_get boolean")
    return cache.replay(rows, ["i"], capacity).select("keys", "hits").first()


def test_lru_evicts_the_oldest(spark):
    put, get = (lambda k: (k, False)), (lambda k: (k, True))
    assert replay(spark, [put("a"), put("b"), put("c")], 2).keys == ["b", "c"]
    assert replay(spark, [put("a"), put("b"), get("a"), put("c")], 2).keys == ["a", "c"]
    assert replay(spark, [put("a"), put("b"), put("a"), put("c")], 2).keys == ["b", "c"]  # setting doesn't refresh
    assert tuple(replay(spark, [get("x"), put("a"), get("a")], 2)) == (["a"], 1)


def test_upsert_takes_the_later_and_then_the_new(spark):
    old = spark.createDataFrame([("a", 1, 5), ("b", 1, 9), ("c", 1, 7)], "key string, n int, cached_at int")
    new = spark.createDataFrame([("a", 2, 6), ("b", 2, 8), ("c", 2, 7), ("d", 2, 1)], "key string, n int, cached_at int")
    assert {r.key: r.n for r in cache.upsert(old, new).collect()} == {"a": 2, "b": 1, "c": 2, "d": 2}
