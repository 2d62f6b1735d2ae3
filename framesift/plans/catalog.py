"""Queries over the media catalog: admission, trims, keys, names, time text, codecs, metadata."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framesift.functions import media as m
from framesift.functions import naming, timecode
from framesift.functions.geometry import half_up, letterbox
from framesift.operators import catalog as c
from framesift.plans.registry import query
from framesift.sources.tables import MEDIA, TRIMS, media, table, trims

_MEDIA = "WITH " + MEDIA
_TRIMMED = _MEDIA + ", " + TRIMS

_FIRST = """, f AS (SELECT *, row_number() OVER (PARTITION BY name, size ORDER BY pos) AS n FROM media WHERE mime LIKE 'image/%' OR mime LIKE 'video/%')
"""


@query(_MEDIA + _FIRST + """, old AS (SELECT DISTINCT name, size FROM media WHERE pos % 11 = 0)
SELECT pos, f.name, f.size, pos = min(pos) OVER () AS active FROM f LEFT JOIN old ON f.name = old.name AND f.size = old.size WHERE n = 1 AND old.name IS NULL""")
def admit_files(spark, sf_dir):
    rows = media(spark, sf_dir)
    return c.admit(rows, rows.where("pos % 11 = 0")).select("pos", "name", "size", "active")


@query(_MEDIA + _FIRST + "SELECT name, size, pos FROM f WHERE n = 1")
def dedupe_catalog(spark, sf_dir):
    return c.first_by(c.accepted(media(spark, sf_dir)), ["name", "size"], "pos").select("name", "size", "pos")


_CLAMPED = _TRIMMED + """, s AS (SELECT media.pos, duration_s, greatest(0::DOUBLE, least(duration_s, coalesce(t0, 0::DOUBLE))) AS a, greatest(0::DOUBLE, least(duration_s, coalesce(t1, duration_s))) AS b
  FROM media LEFT JOIN trims ON media.pos = trims.pos WHERE is_video),
clamped AS (SELECT pos, duration_s, least(a, b) AS trim_start, greatest(a, b) AS trim_end FROM s)
"""


@query(_CLAMPED + "SELECT pos, trim_start, trim_end, trim_start = trim_end AS single_frame, trim_start > 0 OR abs(trim_end - duration_s) > 0.001::DOUBLE AS is_trimmed FROM clamped")
def clamp_trims(spark, sf_dir):
    return c.clamp_trims(media(spark, sf_dir), trims(spark, sf_dir)).select("pos", "trim_start", "trim_end", "single_frame", "is_trimmed")


@query(_CLAMPED + """, x AS (SELECT event_id, user_id, CAST(event_id * 7919 % 600000000 AS BIGINT) AS pts_us FROM events)
SELECT event_id AS frame_id, pos, pts_us FROM x JOIN clamped ON user_id = pos WHERE pts_us / 1000000::DOUBLE BETWEEN trim_start AND trim_end""")
def frames_in_trim(spark, sf_dir):
    frames = table(spark, sf_dir, "events").select(F.col("event_id").alias("frame_id"), F.col("user_id").alias("pos"), F.expr("event_id * 7919 % 600000000").alias("pts_us"))
    kept = c.clamp_trims(media(spark, sf_dir), trims(spark, sf_dir)).select("pos", "trim_start", "trim_end")
    seconds = F.col("pts_us") / 1e6
    return frames.join(kept, "pos").where(seconds.between(F.col("trim_start"), F.col("trim_end"))).select("frame_id", "pos", "pts_us")


_VALUES = """MAP {'input': regexp_replace(name, '\\.[^.]+$', ''), 'index': CAST(pos AS VARCHAR), 'year': strftime(captured_at, '%Y'), 'month': strftime(captured_at, '%m'), 'day': strftime(captured_at, '%d'),
  'hour': strftime(captured_at, '%H'), 'minute': strftime(captured_at, '%M'), 'model': CASE WHEN pos % 2 = 0 THEN 'large' ELSE 'small' END, 'redaction_style': 'blur', 'detect': 'person-plate', 'min_confidence': '0.05', 'area_expansion': '0'}"""


@query(_MEDIA + rf""", p AS (SELECT *, CASE pos % 4 WHEN 0 THEN '{{input}}' WHEN 1 THEN '{{year}}-{{month}}-{{day}}_{{input}}_{{index}}' WHEN 2 THEN 'a{{nope}}b{{{{lat}}}}{{ input }}{{detect}}' ELSE '{{model}}/{{redaction_style}}/{{area_expansion}}{{hour}}{{minute}}{{' END AS pattern FROM media),
v AS (SELECT pos, name, pattern, {_VALUES} AS vals, string_split_regex(pattern, '\{{\w+\}}') AS gaps, regexp_extract_all(pattern, '\{{(\w+)\}}', 1) AS keys FROM p)
SELECT pos, array_to_string(list_transform(range(1, len(gaps) + 1), lambda i: gaps[i] || CASE WHEN i <= len(keys) THEN coalesce(vals[keys[i]], '') ELSE '' END), '') || CASE WHEN pos % 3 <> 0 THEN '.mp4' ELSE '.jpg' END AS output FROM v""")
def output_name(spark, sf_dir):
    patterns = ["{input}", "{year}-{month}-{day}_{input}_{index}", "a{nope}b{{lat}}{ input }{detect}", "{model}/{redaction_style}/{area_expansion}{hour}{minute}{"]
    at = F.col("captured_at").cast("timestamp")
    values = naming.values(
        stem=naming.stem(F.col("name")), index=F.col("pos"), captured_at=at, model=F.when(F.expr("pos % 2 = 0"), "detect_x").otherwise("detect_n"),
        style=F.lit("blur"), labels=F.array(F.lit("plate"), F.lit("person")), least=F.lit(0.05), expansion=F.lit(0.0),
    )
    pattern = F.element_at(F.array(*map(F.lit, patterns)), F.expr("int(pos % 4) + 1"))
    return media(spark, sf_dir).select("pos", F.concat(naming.fill(pattern, values), F.when(F.col("is_video"), ".mp4").otherwise(".jpg")).alias("output"))


@query(r"SELECT doc_id, regexp_replace(source || '.' || lang || '.' || doc_id, '\.[^.]+$', '') AS stem FROM documents")
def file_stem(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", naming.stem(F.concat_ws(".", "source", "lang", "doc_id")).alias("stem"))


@query("""SELECT doc_id, 'detect_n|' || substr(sha256(substr(encode(text), 1, 8192)), 1, 16) || '|' || 'doc_' || doc_id || '|' || octet_length(encode(text)) || '|1429x497|' ||
  CASE WHEN doc_id % 2 = 0 THEN 'img' ELSE 't' || CAST(floor(doc_id * 1234.5::DOUBLE + 0.5) AS BIGINT) END AS key FROM documents""".replace("substr(encode(text), 1, 8192)", "encode(text)[1:8192]"))
def detection_key(spark, sf_dir):
    raw = F.encode(F.col("text"), "UTF-8")
    at = F.when(F.expr("doc_id % 2 = 0"), F.lit(None)).otherwise(F.col("doc_id") * 1234.5)
    key = m.detection_key(F.lit("detect_n"), raw, F.concat(F.lit("doc_"), F.col("doc_id")), F.length(raw), F.lit(1429), F.lit(497), at)
    return table(spark, sf_dir, "documents").select("doc_id", key.alias("key"))


@query("SELECT doc_id, substr(sha256(encode(text)[1:8192]), 1, 16) AS fingerprint FROM documents")
def file_fingerprint(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", m.fingerprint(F.encode(F.col("text"), "UTF-8")).alias("fingerprint"))


_ISO = "CASE WHEN c_custkey % 5 = 0 THEN 'none' ELSE CASE WHEN c_custkey % 2 = 0 THEN '+' ELSE '-' END || (c_custkey % 90) || '.' || (c_custkey * 7 % 10000) || CASE WHEN c_custkey % 3 = 0 THEN '+' ELSE '-' END || lpad(CAST(c_custkey % 180 AS VARCHAR), 3, '0') || '.5/' END"


@query(rf"""SELECT c_custkey, try_cast(nullif(regexp_extract(t, '^([+-]\d+\.?\d*)([+-]\d+\.?\d*)', 1), '') AS DOUBLE) AS lat,
  try_cast(nullif(regexp_extract(t, '^([+-]\d+\.?\d*)([+-]\d+\.?\d*)', 2), '') AS DOUBLE) AS lon FROM (SELECT c_custkey, {_ISO} AS t FROM customer)""")
def iso6709(spark, sf_dir):
    text = F.expr("case when c_custkey % 5 = 0 then 'none' else concat(if(c_custkey % 2 = 0, '+', '-'), string(c_custkey % 90), '.', string(c_custkey * 7 % 10000), if(c_custkey % 3 = 0, '+', '-'), lpad(string(c_custkey % 180), 3, '0'), '.5/') end")
    lat, lon = m.iso6709(text)
    return table(spark, sf_dir, "customer").select("c_custkey", lat.alias("lat"), lon.alias("lon"))


@query(_MEDIA + """, s AS (SELECT pos, CAST(floor(duration_s * 97 + 0.5) AS BIGINT) AS s FROM media WHERE duration_s > 0)
SELECT pos, CASE WHEN s // 3600 < 10 THEN '0' ELSE '' END || (s // 3600) || ':' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS duration FROM s""")
def duration_hms(spark, sf_dir):
    return media(spark, sf_dir).where("duration_s > 0").select("pos", timecode.hms(F.col("duration_s") * 97).alias("duration"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END) * (CAST(l_partkey % 90 AS DOUBLE) + CASE WHEN l_linenumber % 4 = 0 THEN 0::DOUBLE ELSE CAST(l_suppkey % 60 AS DOUBLE) / (l_linenumber % 4) END / 60 + CAST(l_orderkey % 6000 AS DOUBLE) / 100 / 3600) AS degrees FROM lineitem")
def gps_decimal(spark, sf_dir):
    parts = [(F.expr("l_partkey % 90"), F.lit(1)), (F.expr("l_suppkey % 60"), F.expr("l_linenumber % 4")), (F.expr("l_orderkey % 6000"), F.lit(100))]
    ref = F.when(F.col("l_returnflag") == "R", "S").otherwise("N")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", m.degrees(ref, parts).alias("degrees"))


_CODE = "CASE event_id % 8 WHEN 0 THEN ' 1:02:' || (event_id % 60) || '.5 ' WHEN 1 THEN (event_id % 90) || ':' || (event_id % 60) || '.25' WHEN 2 THEN CAST(event_id AS VARCHAR) || 'abc' WHEN 3 THEN '-5' WHEN 4 THEN 'x' WHEN 5 THEN (event_id % 100) || '.125' WHEN 6 THEN '1:2:' ELSE '.5e1' END"


@query(rf"""SELECT event_id, CASE WHEN regexp_full_match(t, '\d+:\d+:\d+(\.\d*)?') THEN CAST(split_part(t, ':', 1) AS DOUBLE) * 3600 + CAST(split_part(t, ':', 2) AS DOUBLE) * 60 + CAST(split_part(t, ':', 3) AS DOUBLE)
  WHEN regexp_full_match(t, '\d+:\d+(\.\d*)?') THEN CAST(split_part(t, ':', 1) AS DOUBLE) * 60 + CAST(split_part(t, ':', 2) AS DOUBLE)
  ELSE CASE WHEN v >= 0 THEN v END END AS seconds FROM (SELECT event_id, t, try_cast(nullif(regexp_extract(t, '^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?'), '') AS DOUBLE) AS v FROM (SELECT event_id, trim({_CODE}) AS t FROM events))""")
def parse_timecode(spark, sf_dir):
    text = F.expr("case event_id % 8 when 0 then concat(' 1:02:', string(event_id % 60), '.5 ') when 1 then concat(string(event_id % 90), ':', string(event_id % 60), '.25') when 2 then concat(string(event_id), 'abc') when 3 then '-5' when 4 then 'x' when 5 then concat(string(event_id % 100), '.125') when 6 then '1:2:' else '.5e1' end")
    return table(spark, sf_dir, "events").select("event_id", timecode.parse(text).alias("seconds"))


@query(_MEDIA + """, b AS (SELECT *, CASE WHEN pos % 2 = 0 THEN cents WHEN duration_s > 0 THEN greatest(100000, CAST(floor(cents * 100 * 8 / duration_s + 0.5) AS BIGINT) - 192000) END AS source FROM media)
SELECT pos, source AS source_bitrate, CASE WHEN pos % 3 = 0 THEN CAST(floor(source * 0.5::DOUBLE + 0.5) AS BIGINT) ELSE source END AS bitrate, CASE WHEN pos % 3 = 0 THEN 0.65::DOUBLE ELSE 0.95::DOUBLE END AS jpeg_quality FROM b""")
def bitrate_effective(spark, sf_dir):
    mode = F.when(F.expr("pos % 3 = 0"), "filesize").otherwise("quality")
    source = m.source_bitrate(F.when(F.expr("pos % 2 = 0"), F.col("cents")), F.col("cents") * 100, F.col("duration_s"))
    return media(spark, sf_dir).select("pos", source.alias("source_bitrate"), m.effective_bitrate(mode, source).alias("bitrate"), m.jpeg_quality(mode).alias("jpeg_quality"))


@query(_MEDIA + """, s AS (SELECT *, pos % 5 AS sn, pos % 4 AS sd FROM media)
SELECT pos, CASE WHEN sn > 0 AND sd > 0 AND sn > sd THEN CAST(floor(width * (CAST(sn AS DOUBLE) / sd) + 0.5) AS BIGINT) ELSE width END AS display_w,
  CASE WHEN sn > 0 AND sd > 0 AND sn < sd THEN CAST(floor(height / (CAST(sn AS DOUBLE) / sd) + 0.5) AS BIGINT) ELSE height END AS display_h FROM s""")
def sar_display_size(spark, sf_dir):
    w, h = m.display_size(F.col("width"), F.col("height"), F.expr("pos % 5"), F.expr("pos % 4"))
    return media(spark, sf_dir).select("pos", w.alias("display_w"), h.alias("display_h"))


def _map_sql(values: dict[int, str], col: str) -> str:
    return f"CASE {col} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in values.items()) + " END"


@query(f"""SELECT event_id, {_map_sql(m.PIXEL_FORMATS, 'event_id % 70')} AS pixel_format, {_map_sql(m.PRIMARIES, 'event_id % 16')} AS primaries, {_map_sql(m.TRANSFERS, 'event_id % 20')} AS transfer,
  {_map_sql(m.MATRICES, 'event_id % 12')} AS matrix, event_id % 70 IN (12, 13, 14) OR event_id % 3 = 2 AS full_range FROM events""")
def pixel_format_map(spark, sf_dir):
    number = lambda k: F.expr(f"int(event_id % {k})")
    return table(spark, sf_dir, "events").select("event_id", *(v.alias(k) for k, v in m.colour_space(number(70), number(16), number(20), number(12), number(3)).items()))


@query(_MEDIA + """, o AS (SELECT pos, hw, codec, ord FROM media, (SELECT hw, codec, h * 4 + k AS ord FROM (VALUES ('prefer-hardware', 0), ('prefer-software', 1)) a(hw, h), (VALUES ('av1', 0), ('hevc', 1), ('avc', 2), ('vp9', 3)) b(codec, k))
  WHERE (pos * 31 + ord * 17) % 7 = 0)
SELECT pos, arg_min(codec, ord) AS codec, arg_min(hw, ord) AS acceleration, CASE WHEN arg_min(codec, ord) = 'vp9' THEN '.webm' ELSE '.mp4' END AS ext FROM o GROUP BY pos""")
def pick_encoder(spark, sf_dir):
    """First of the probes that succeed, hardware before software, codecs by preference."""
    probes = media(spark, sf_dir).select("pos", F.inline(m.encoder_options())).where("(pos * 31 + rank * 17) % 7 = 0")
    return m.first_supported(probes)


_STATUS = "CASE (v * 3 + k * 5) % 4 WHEN 0 THEN 'untested' WHEN 1 THEN 'probe-ok' WHEN 2 THEN 'probe-fail' ELSE 'runtime-fail' END"


@query(f"""WITH g AS (SELECT event_id, ['avc', 'vp9', 'av1', 'vp8', 'hevc'][event_id % 5 + 1] AS codec, unnest([0, 1, 2]) AS k, event_id AS v FROM events),
s AS (SELECT event_id, any_value(codec) AS codec, bool_and({_STATUS} IN ('probe-fail', 'runtime-fail')) AS all_failed FROM g GROUP BY event_id)
SELECT event_id, codec, all_failed, CASE WHEN codec = 'hevc' THEN 'hevc_software' WHEN NOT all_failed OR codec IN ('avc', 'av1') THEN 'web_codecs' END AS decoder FROM s""")
def pick_decoder(spark, sf_dir):
    """Whether every mode of a codec failed, and the first decoder by registration that claims it."""
    codec = F.element_at(F.array(*map(F.lit, ("avc", "vp9", "av1", "vp8", "hevc"))), F.expr("int(event_id % 5) + 1"))
    rows = table(spark, sf_dir, "events").select("event_id", codec.alias("codec"), F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("k"))
    status = F.element_at(F.array(*map(F.lit, ("untested", "probe-ok", "probe-fail", "runtime-fail"))), F.expr("int((event_id * 3 + k * 5) % 4) + 1"))
    grouped = rows.groupBy("event_id", "codec").agg(F.bool_and(status.isin("probe-fail", "runtime-fail")).alias("all_failed"))
    return grouped.select("event_id", "codec", "all_failed", m.decoder(F.col("codec"), F.col("all_failed"), software=True).alias("decoder"))


_TAGS = "MAP {'title': 'doc_' || doc_id, '©xyz': CASE WHEN doc_id % 3 = 0 THEN '+53.5+009.9/' END, 'loci': CASE WHEN doc_id % 5 = 0 THEN 'x' END, 'artist': source}"


@query(f"SELECT doc_id, array_to_string(list_sort(list_transform(list_filter(map_entries({_TAGS}), lambda e: e.value IS NOT NULL), lambda e: e.key || '=' || e.value)), ';') AS tags FROM documents")
def metadata_keep(spark, sf_dir):
    return _tag_text(spark, sf_dir, "keep")


@query(f"SELECT doc_id, array_to_string(list_sort(list_transform(list_filter(map_entries({_TAGS}), lambda e: e.value IS NOT NULL AND e.key IN ('©xyz', 'loci')), lambda e: e.key || '=' || e.value)), ';') AS tags FROM documents")
def metadata_gps(spark, sf_dir):
    return _tag_text(spark, sf_dir, "gps")


@query("SELECT doc_id, '' AS tags FROM documents")
def metadata_strip(spark, sf_dir):
    return _tag_text(spark, sf_dir, "strip")


def _tag_text(spark, sf_dir, mode):
    tags = F.create_map(
        F.lit("title"), F.concat(F.lit("doc_"), F.col("doc_id")), F.lit("©xyz"), F.expr("if(doc_id % 3 = 0, '+53.5+009.9/', null)"),
        F.lit("loci"), F.expr("if(doc_id % 5 = 0, 'x', null)"), F.lit("artist"), F.col("source"),
    )
    entries = F.transform(F.map_entries(m.reduce_tags(tags, mode)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(entries), ";").alias("tags"))


@query(f"""WITH s AS (SELECT event_id, {_map_sql(m.PRIMARIES, 'event_id % 16')} AS p, {_map_sql(m.TRANSFERS, 'event_id % 20')} AS t FROM events),
h AS (SELECT *, coalesce(t IN ('hlg', 'pq'), false) OR coalesce(p = 'bt2020' AND (t IS NULL OR t = 'bt709'), false) AS is_hdr FROM s)
SELECT event_id, is_hdr, CASE WHEN is_hdr THEN CASE WHEN t = 'pq' THEN 'pq' ELSE 'hlg' END END AS effective FROM h""")
def is_hdr(spark, sf_dir):
    space = m.colour_space(F.lit(0), F.expr("int(event_id % 16)"), F.expr("int(event_id % 20)"), F.lit(0), F.lit(0))
    hdr = m.is_hdr(space["primaries"], space["transfer"])
    return table(spark, sf_dir, "events").select("event_id", hdr.alias("is_hdr"), F.when(hdr, m.effective_transfer(space["transfer"])).alias("effective"))


@query(_MEDIA + """, s AS (SELECT *, least(1280::DOUBLE / width, 1280::DOUBLE / height) AS scale FROM media), t AS (SELECT *, floor(width * scale + 0.5) AS sw, floor(height * scale + 0.5) AS sh FROM s)
SELECT pos, scale, CAST(sw AS BIGINT) AS scaled_w, CAST(sh AS BIGINT) AS scaled_h, CAST(floor((1280 - sw) / 2) AS BIGINT) AS pad_x, CAST(floor((1280 - sh) / 2) AS BIGINT) AS pad_y FROM t""")
def letterbox_params(spark, sf_dir):
    fit = letterbox(F.col("width"), F.col("height"))
    return media(spark, sf_dir).select("pos", *((v if k == "scale" else v.cast("bigint")).alias(k) for k, v in fit.items()))


@query("""WITH s AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
SELECT event_id, CASE WHEN k % 2 = 0 THEN 'detect_x' ELSE 'detect_n' END AS model, CASE k % 3 WHEN 0 THEN 'keep' WHEN 1 THEN 'strip' ELSE 'gps' END AS keep_metadata, 0.05::DOUBLE AS min_confidence, '{input}' AS naming_pattern FROM s""")
def config_defaults(spark, sf_dir):
    """Stored settings laid over the defaults; an old yes-or-no setting becomes keep or strip."""
    stored = F.expr("""concat('{', if(k % 2 = 0, '"model":"detect_x",', ''), '"keepMetadata":', case k % 3 when 0 then 'true' when 1 then 'false' else '"gps"' end, '}')""")
    rows = table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    merged = m.merged_config(stored)
    return rows.select("event_id", *(merged[c].alias(c) for c in ("model", "keep_metadata", "min_confidence", "naming_pattern")))


@query(_MEDIA + """, b AS (SELECT pos, size * cents AS n, duration_s AS d FROM media)
SELECT pos, CASE WHEN n < 1000000 THEN 'KB' WHEN n < 1000000000 THEN 'MB' ELSE 'GB' END AS unit, CAST(CASE WHEN n < 1000000 THEN n / 1000::DOUBLE WHEN n < 1000000000 THEN n / 1000000::DOUBLE ELSE n / 1000000000::DOUBLE END AS DOUBLE) AS amount,
  CAST(CAST(floor(d / 60) AS BIGINT) AS VARCHAR) || ':' || lpad(CAST(CAST(floor(d - floor(d / 60) * 60) AS BIGINT) AS VARCHAR), 2, '0') AS duration FROM b""")
def size_and_duration(spark, sf_dir):
    unit, amount = timecode.size_parts(F.col("size") * F.col("cents"))
    return media(spark, sf_dir).select("pos", unit.alias("unit"), amount.alias("amount"), timecode.minutes(F.col("duration_s")).alias("duration"))


@query("SELECT p_partkey, p_brand, p_type FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) AS n FROM part) WHERE n = 1")
def distinct_licences(spark, sf_dir):
    """One row for each name and version, the first by key."""
    return c.first_by(table(spark, sf_dir, "part"), ["p_brand", "p_type"], "p_partkey").select("p_partkey", "p_brand", "p_type")
