"""Keys, metadata, codecs and colour of media files as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framesift.functions.geometry import half_up

#: Bytes of a file's head that its fingerprint covers, and bit rate taken for sound (fixed values).
HEAD, SOUND = 8192, 192_000

# Numbers of the codec library's pixel formats, colour primaries, transfers and matrices (fixed values).
PIXEL_FORMATS = {0: "I420", 4: "I422", 5: "I444", 12: "I420", 13: "I422", 14: "I444", 23: "NV12", 62: "I420P10"}
FULL_RANGE_FORMATS = (12, 13, 14)
PRIMARIES = {1: "bt709", 4: "bt470m", 5: "bt470bg", 6: "smpte170m", 7: "smpte240m", 9: "bt2020", 11: "smpte431", 12: "smpte432"}
TRANSFERS = {1: "bt709", 4: "gamma22", 5: "gamma28", 6: "smpte170m", 7: "smpte240m", 8: "linear", 13: "iec61966-2-1", 14: "bt2020-10", 15: "bt2020-12", 16: "pq", 18: "hlg"}
MATRICES = {0: "rgb", 1: "bt709", 4: "fcc", 5: "bt470bg", 6: "smpte170m", 7: "smpte240m", 9: "bt2020-ncl", 10: "bt2020-cl"}

# Encoders in order of preference, and settings that hold where none are stored (fixed values).
ACCELERATIONS, CODECS = ("prefer-hardware", "prefer-software"), ("av1", "hevc", "avc", "vp9")
DEFAULTS = {"model": "detect_n", "draw_mode": "blur", "solid_color": "#000000", "keep_metadata": "keep", "keep_audio": True, "export_mode": "quality", "min_confidence": 0.05, "expansion_fraction": 0.0, "naming_pattern": "{input}"}


def fingerprint(content: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the head."""
    return F.substring(F.sha2(F.substring(content, 1, HEAD), 256), 1, 16)


def detection_key(model: Column, content: Column, name: Column, size: Column, width: Column, height: Column, at_us: Column) -> Column:
    """Key of a picture's (null time) or a frame's detections in the cache."""
    place = F.coalesce(F.concat(F.lit("t"), half_up(at_us).cast("bigint").cast("string")), F.lit("img"))
    return F.concat_ws("|", model, fingerprint(content), name, size.cast("string"), F.concat_ws("x", width.cast("string"), height.cast("string")), place)


def iso6709(text: Column) -> tuple[Column, Column]:
    """Latitude and longitude of a coordinate string, or nulls."""
    number = lambda i: F.nullif(F.regexp_extract(text, r"^([+-]\d+\.?\d*)([+-]\d+\.?\d*)", i), F.lit("")).try_cast("double")
    return number(1), number(2)


def degrees(ref: Column, parts: list[tuple[Column, Column]]) -> Column:
    """Decimal degrees of three fractions (degrees, minutes, seconds); a zero denominator counts as 0, south and west as negative."""
    d, m, s = (F.when(b == 0, F.lit(0.0)).otherwise(F.try_divide(a.cast("double"), b.cast("double"))) for a, b in parts)
    return F.when(ref.isin("S", "W"), F.lit(-1)).otherwise(F.lit(1)) * (d + m / 60 + s / 3600)


def reduce_tags(tags: Column, mode: str) -> Column:
    """Text tags that a metadata mode lets through: keep all, gps only the place, strip none."""
    if mode == "strip":
        return F.map_filter(tags, lambda k, v: F.lit(False))
    place = ("©xyz", "loci")
    return F.map_filter(tags, lambda k, v: v.isNotNull() & (k.isin(*place) if mode == "gps" else F.lit(True)))


def jpeg_quality(mode: Column) -> Column:
    return F.when(mode == "filesize", 0.65).otherwise(0.95)


def effective_bitrate(mode: Column, source: Column) -> Column:
    """Half the source's bit rate where small files are wanted; null where it isn't known."""
    return F.when(mode == "filesize", half_up(source * 0.5).cast("bigint")).otherwise(source)


def source_bitrate(stated: Column, size: Column, seconds: Column) -> Column:
    """The stated bit rate, or an estimate from size and duration without sound."""
    guess = F.greatest(F.lit(100_000), half_up(F.try_divide((size * 8).cast("double"), seconds)).cast("bigint") - SOUND)
    return F.coalesce(stated, F.when(seconds > 0, guess))


def display_size(w: Column, h: Column, across: Column, down: Column) -> tuple[Column, Column]:
    """Size on screen for a sample aspect ratio: the longer side grows; zero and square ratios change nothing."""
    given = (across > 0) & (down > 0)
    aspect = F.try_divide(across.cast("double"), down.cast("double"))
    wide, tall = given & (across > down), given & (across < down)
    return F.when(wide, half_up(w * aspect).cast("bigint")).otherwise(w), F.when(tall, half_up(h / aspect).cast("bigint")).otherwise(h)


def _lookup(values: dict[int, str], number: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), number)


def colour_space(pixel_format: Column, primaries: Column, transfer: Column, matrix: Column, colour_range: Column) -> dict[str, Column]:
    """Names of the library's numbers (unknown: null), and whether samples use the full range."""
    return {
        "pixel_format": _lookup(PIXEL_FORMATS, pixel_format), "primaries": _lookup(PRIMARIES, primaries), "transfer": _lookup(TRANSFERS, transfer),
        "matrix": _lookup(MATRICES, matrix), "full_range": pixel_format.isin(*FULL_RANGE_FORMATS) | (colour_range == 2),
    }


def is_hdr(primaries: Column, transfer: Column) -> Column:
    by_transfer = F.coalesce(transfer.isin("hlg", "pq"), F.lit(False))
    return by_transfer | F.coalesce((primaries == "bt2020") & (transfer.isNull() | (transfer == "bt709")), F.lit(False))


def effective_transfer(transfer: Column) -> Column:
    return F.when(transfer.eqNullSafe("pq"), "pq").otherwise("hlg")


def encoder_options() -> Column:
    """Array of rank, acceleration and codec of the encoders, best first."""
    rows = [(i * len(CODECS) + j, a, c) for i, a in enumerate(ACCELERATIONS) for j, c in enumerate(CODECS)]
    return F.array(*(F.struct(F.lit(r).alias("rank"), F.lit(a).alias("acceleration"), F.lit(c).alias("codec")) for r, a, c in rows))


def first_supported(probes: DataFrame) -> DataFrame:
    """pos, codec, acceleration and ext of the best of each item's supported options."""
    best = probes.groupBy("pos").agg(F.min_by(F.struct("codec", "acceleration"), "rank").alias("b"))
    return best.select("pos", "b.codec", "b.acceleration", F.when(F.col("b.codec") == "vp9", ".webm").otherwise(".mp4").alias("ext"))


def decoder(codec: Column, all_failed: Column, software: bool) -> Column:
    """The first decoder in the order of registration that claims a codec; null if none does.

    The web decoder also keeps codecs that its software core can take over when all its modes failed.
    """
    core = codec.isin("avc", "av1") & F.lit(software)
    return F.when(codec == "hevc", "hevc_software").when(codec.isin("avc", "vp9", "av1", "vp8") & (~all_failed | core), "web_codecs")


def merged_config(stored: Column) -> dict[str, Column]:
    """Settings from stored JSON over the defaults; a stored boolean for metadata becomes keep or strip."""
    names = {"model": "model", "draw_mode": "drawMode", "solid_color": "solidColor", "export_mode": "exportMode", "naming_pattern": "namingPattern"}
    found = {k: F.coalesce(F.get_json_object(stored, f"$.{v}"), F.lit(DEFAULTS[k])) for k, v in names.items()}
    keep = F.get_json_object(stored, "$.keepMetadata")
    found["keep_metadata"] = F.when(keep == "true", "keep").when(keep == "false", "strip").otherwise(F.coalesce(keep, F.lit(DEFAULTS["keep_metadata"])))
    for k, v in {"min_confidence": "minConfidence", "expansion_fraction": "expansionFraction"}.items():
        found[k] = F.coalesce(F.get_json_object(stored, f"$.{v}").try_cast("double"), F.lit(DEFAULTS[k]))
    return found


def stored_model(asked: Column, confirmed: Column) -> Column:
    """The model to store: the large one only once it is confirmed to run."""
    return F.when((asked == "detect_x") & ~confirmed, "detect_n").otherwise(asked)
