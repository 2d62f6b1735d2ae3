"""Queries over picture bytes and pixels. The tables hold no pictures: samples come from their numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from framesift.functions import tonemap
from framesift.functions.geometry import rounded_distance
from framesift.operators import exif, filemeta, hdr, inference, orient, redact
from framesift.plans.registry import query
from framesift.sources import pictures
from framesift.sources.tables import MEDIA, media, table

_RGB = "s AS (SELECT event_id, CAST(event_id % 101 AS DOUBLE) / 100 AS r, CAST(event_id * 7 % 101 AS DOUBLE) / 100 AS g, CAST(event_id * 13 % 101 AS DOUBLE) / 100 AS b FROM events)"
_SRGB = """, c AS (SELECT event_id, [least(greatest(1.6605::DOUBLE * r + -0.5877::DOUBLE * g + -0.0728::DOUBLE * b, 0), 1), least(greatest(-0.1246::DOUBLE * r + 1.1329::DOUBLE * g + -0.0083::DOUBLE * b, 0), 1), least(greatest(-0.0182::DOUBLE * r + -0.1006::DOUBLE * g + 1.1187::DOUBLE * b, 0), 1)] AS v FROM d),
o AS (SELECT event_id, list_transform(v, lambda x: CAST(floor(1000 * CASE WHEN x <= 0.0031308::DOUBLE THEN 12.92::DOUBLE * x ELSE 1.055::DOUBLE * pow(x, 1 / 2.4::DOUBLE) - 0.055::DOUBLE END + 0.5) AS BIGINT)) AS v FROM c)
SELECT event_id, v[1] AS r, v[2] AS g, v[3] AS b FROM o"""


def _mapped(spark, sf_dir, transfer):
    sample = lambda k: F.expr(f"double(event_id * {k} % 101) / 100")
    rgb = transfer([F.col("r"), F.col("g"), F.col("b")])
    rows = table(spark, sf_dir, "events").select("event_id", sample(1).alias("r"), sample(7).alias("g"), sample(13).alias("b"))
    # thousandths: the engines' powers may differ in their last bits
    return rows.select("event_id", *(F.floor(1000 * x + 0.5).cast("bigint").alias(c) for x, c in zip(rgb, "rgb")))


@query("WITH " + _RGB + """, l AS (SELECT event_id, list_transform([r, g, b], lambda x: CASE WHEN x <= 0.5::DOUBLE THEN x * x / 3 ELSE (exp((x - 0.55991073::DOUBLE) / 0.17883277::DOUBLE) + 0.28466892::DOUBLE) / 12 END) AS v FROM s),
y AS (SELECT *, pow(greatest(0.2627::DOUBLE * v[1] + 0.6780::DOUBLE * v[2] + 0.0593::DOUBLE * v[3], 1e-6), 0.2::DOUBLE) AS k FROM l),
d AS (SELECT event_id, v[1] * k AS r, v[2] * k AS g, v[3] * k AS b FROM y)""" + _SRGB)
def tonemap_hlg(spark, sf_dir):
    return _mapped(spark, sf_dir, tonemap.hlg)


@query("WITH " + _RGB + """, l AS (SELECT event_id, list_transform([r, g, b], lambda x: least(pow(greatest(pow(x, 1 / 78.84375::DOUBLE) - 0.8359375::DOUBLE, 0) / (18.8515625::DOUBLE - 18.6875::DOUBLE * pow(x, 1 / 78.84375::DOUBLE)), 1 / 0.1593017578125::DOUBLE) * (10000 / 203::DOUBLE), 1)) AS v FROM s),
d AS (SELECT event_id, v[1] AS r, v[2] AS g, v[3] AS b FROM l)""" + _SRGB)
def tonemap_pq(spark, sf_dir):
    return _mapped(spark, sf_dir, tonemap.pq)


@query("""WITH b AS (SELECT s_suppkey AS k, CAST(4 + s_suppkey % 3 AS DOUBLE) AS ox, CAST(3 + s_suppkey % 4 AS DOUBLE) AS oy, CAST(8 + s_suppkey % 5 AS DOUBLE) AS dw, CAST(9 + s_suppkey % 3 AS DOUBLE) AS dh, s_suppkey % 4 AS r FROM supplier),
p AS (SELECT b.*, x, y, CASE WHEN k % 2 = 0 AND x < ox THEN ox ELSE x END AS px, CASE WHEN k % 5 = 0 AND y > oy + dh THEN oy + dh ELSE y END AS py FROM b, range(0, 20) a(x), range(0, 18) c(y)),
q AS (SELECT *, abs(px - (ox + dw / 2)) - dw / 2 + r AS qx, abs(py - (oy + dh / 2)) - dh / 2 + r AS qy FROM p),
d AS (SELECT *, sqrt(greatest(qx, 0) * greatest(qx, 0) + greatest(qy, 0) * greatest(qy, 0)) + least(greatest(qx, qy), 0) - r AS d FROM q)
SELECT k, x, y, CAST(floor(1000 * CASE WHEN d <= 0 THEN 1::DOUBLE WHEN d >= 3 THEN 0::DOUBLE ELSE 1 - d * (1 / 3::DOUBLE) END + 0.5) AS BIGINT) AS alpha FROM d""")
def mask_sdf(spark, sf_dir):
    """Mask of rounded boxes over 20 x 18 pixels, feather 3, some left and bottom sides snapped; in thousandths."""
    boxes = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("k"), F.expr("double(4 + s_suppkey % 3)").alias("ox"), F.expr("double(3 + s_suppkey % 4)").alias("oy"),
        F.expr("double(8 + s_suppkey % 5)").alias("dw"), F.expr("double(9 + s_suppkey % 3)").alias("dh"), F.expr("s_suppkey % 4").alias("r"),
    )
    grid = boxes.withColumn("x", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(19).cast("bigint")))).withColumn("y", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(17).cast("bigint"))))
    px = F.when(F.expr("k % 2 = 0 and x < ox"), F.col("ox")).otherwise(F.col("x"))
    py = F.when(F.expr("k % 5 = 0 and y > oy + dh"), F.expr("oy + dh")).otherwise(F.col("y"))
    box = {c: F.col(c) for c in ("ox", "oy", "dw", "dh")} | {c: F.col("r") for c in ("tl", "tr", "br", "bl")}
    d = rounded_distance(px, py, box)
    alpha = F.when(d <= 0, F.lit(1.0)).when(d >= 3, F.lit(0.0)).otherwise(1 - d * (1 / 3))
    return grid.select("k", "x", "y", F.floor(1000 * alpha + 0.5).cast("bigint").alias("alpha"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 207 ELSE 93 END AS exif_bytes FROM orders")
def exif_find_app1(spark, sf_dir):
    return pictures.jpegs(spark, sf_dir).select("o_orderkey", F.length(exif.exif_segment(F.col("jpeg"))).alias("exif_bytes"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y') AS year, strftime(o_orderdate, '%m') AS month, strftime(o_orderdate, '%d') AS day, '+01:00' AS timezone,
  CASE WHEN o_orderkey % 2 = 0 THEN (CASE WHEN o_orderkey % 4 = 0 THEN -1 ELSE 1 END) * (CAST(o_orderkey % 90 AS DOUBLE) + CAST(o_orderkey % 60 AS DOUBLE) / 60 + CAST(o_orderkey % 6000 AS DOUBLE) / 100 / 3600) END AS lat,
  CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey % 180 AS DOUBLE) + CAST(o_orderkey % 60 AS DOUBLE) / 60 + CAST(o_orderkey % 6000 AS DOUBLE) / 100 / 3600 END AS lon FROM orders""")
def exif_parse(spark, sf_dir):
    found = pictures.jpegs(spark, sf_dir).withColumn("m", exif.exif_meta(F.col("jpeg")))
    return found.select("o_orderkey", *(F.col(f"m.{c}").alias(c) for c in ("year", "month", "day", "timezone", "lat", "lon")))


@query(rf"""WITH {MEDIA}, t AS (SELECT *, mime = 'video/mp4' AS video, mime = 'image/jpeg' AS jpeg, pos % 86400 AS s,
  CASE WHEN pos % 5 = 0 THEN 'none' ELSE '+' || (pos % 90) || '.25-' || lpad(CAST(pos % 180 AS VARCHAR), 3, '0') || '.5/' END AS xyz FROM media),
d AS (SELECT pos, CASE WHEN video OR jpeg THEN captured_at END AS day, video, jpeg, s, duration_s * 97 AS length, xyz FROM t)
SELECT pos, strftime(day, '%Y') AS year, strftime(day, '%m') AS month, strftime(day, '%d') AS day, CASE WHEN video THEN lpad(CAST(s // 3600 AS VARCHAR), 2, '0') WHEN jpeg THEN '00' END AS hour,
  CASE WHEN video THEN lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') WHEN jpeg THEN '00' END AS minute, CASE WHEN jpeg THEN '+01:00' END AS timezone,
  CASE WHEN video AND pos % 5 <> 0 THEN CAST(pos % 90 AS DOUBLE) + 0.25::DOUBLE WHEN jpeg AND pos % 2 = 0 THEN (CASE WHEN pos % 4 = 0 THEN -1 ELSE 1 END) * (CAST(pos % 90 AS DOUBLE) + CAST(pos % 60 AS DOUBLE) / 60 + CAST(pos % 6000 AS DOUBLE) / 100 / 3600) END AS lat,
  CASE WHEN video AND pos % 5 <> 0 THEN -(CAST(pos % 180 AS DOUBLE) + 0.5::DOUBLE) WHEN jpeg AND pos % 2 = 0 THEN CAST(pos % 180 AS DOUBLE) + CAST(pos % 60 AS DOUBLE) / 60 + CAST(pos % 6000 AS DOUBLE) / 100 / 3600 END AS lon,
  CASE WHEN video AND length > 0 THEN (CASE WHEN floor(length + 0.5) < 36000 THEN '0' ELSE '' END) || CAST(CAST(floor(length + 0.5) AS BIGINT) // 3600 AS VARCHAR) || ':' || lpad(CAST(CAST(floor(length + 0.5) AS BIGINT) % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(CAST(floor(length + 0.5) AS BIGINT) % 60 AS VARCHAR), 2, '0') END AS duration FROM d""")
def file_meta(spark, sf_dir):
    """Date, place and length of every catalogued file: pictures by their EXIF bytes, videos by their container's tags, others nothing."""
    place = F.expr("case when pos % 5 = 0 then 'none' else concat('+', string(pos % 90), '.25-', lpad(string(pos % 180), 3, '0'), '.5/') end")
    # the tag's date has a time of day, the session's time zone isn't part of it
    taken = F.timestamp_micros(F.unix_date(F.col("captured_at").cast("date")).cast("bigint") * filemeta.DAY_US + F.expr("pos % 86400") * 1_000_000)
    rows = media(spark, sf_dir).join(pictures.jpegs(spark, sf_dir), F.col("pos") == F.col("o_orderkey"))
    found = rows.withColumn("m", filemeta.file_meta(F.col("mime"), F.col("jpeg"), taken, place, F.col("duration_s") * 97))
    return found.select("pos", "m.*")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 1 THEN strftime(o_orderdate, '%Y') END AS year,
  CASE WHEN o_orderkey % 2 = 0 THEN (CASE WHEN o_orderkey % 4 = 0 THEN -1 ELSE 1 END) * (CAST(o_orderkey % 90 AS DOUBLE) + CAST(o_orderkey % 60 AS DOUBLE) / 60 + CAST(o_orderkey % 6000 AS DOUBLE) / 100 / 3600) END AS lat,
  CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey % 180 AS DOUBLE) + CAST(o_orderkey % 60 AS DOUBLE) / 60 + CAST(o_orderkey % 6000 AS DOUBLE) / 100 / 3600 END AS lon FROM orders""")
def exif_gps_only(spark, sf_dir):
    """What is left after a picture kept its place alone: no date, the same place. One without a place stays as it is."""
    rows = pictures.jpegs(spark, sf_dir).withColumn("place", exif.exif_carried(F.col("jpeg"), F.col("jpeg"), "gps"))
    rows = rows.withColumn("m", exif.exif_meta(F.col("place")))
    return rows.select("o_orderkey", F.col("m.year").alias("year"), F.col("m.lat").alias("lat"), F.col("m.lon").alias("lon"))


def _jpeg_hex() -> str:
    """SQL for a synthetic picture's bytes in hexadecimal: numbers of two and four bytes in either order, directories one after another."""
    two = lambda order, x: f"printf('%02x%02x', {x} % 256, {x} // 256)" if order == "II" else f"printf('%02x%02x', {x} // 256, {x} % 256)"
    four = lambda order, x: " || ".join([two(order, f"({x} % 65536)"), two(order, f"({x} // 65536)")][:: 1 if order == "II" else -1])

    def tiff(order: str, place: bool) -> str:
        def entry(tag, kind, count, value):
            return [two(order, tag), two(order, kind), four(order, count), value]

        text = lambda hexed: f"'{hexed}'"
        exif_at = 8 + 2 + 12 * (1 + place) + 4
        gps_at = exif_at + 30 + 27
        parts = [text("4949" if order == "II" else "4d4d"), two(order, 42), four(order, 8), two(order, 1 + place), *entry(0x8769, 4, 1, four(order, exif_at))]
        parts += entry(0x8825, 4, 1, four(order, gps_at)) if place else []
        parts += [four(order, 0), two(order, 2), *entry(0x9003, 2, 20, four(order, exif_at + 30)), *entry(0x9011, 2, 7, four(order, exif_at + 50)), four(order, 0)]
        parts += ["lower(hex(strftime(o_orderdate, '%Y:%m:%d %H:%M:%S')))", text("00"), text("2b30313a303000")]
        if place:
            rational = lambda d: [four(order, x) for x in (f"(k % {d})", 1, "(k % 60)", 1, "(k % 6000)", 100)]
            parts += [two(order, 4), *entry(1, 2, 2, "CASE WHEN k % 4 = 0 THEN '53' ELSE '4e' END || '00000000'[:6]"), *entry(2, 5, 3, four(order, gps_at + 54))]
            parts += [*entry(3, 2, 2, text("45000000")), *entry(4, 5, 3, four(order, gps_at + 78)), four(order, 0), *rational(90), *rational(180)]
        return " || ".join(f"({p})" for p in parts)

    head = lambda size: f"'ffd8ffe1{size + 10 - 2:04x}457869660000'"
    whole = lambda order, place: f"{head(197 if place else 83)} || {tiff(order, place)}"
    front = f"CASE WHEN k % 2 = 0 THEN CASE WHEN k % 3 > 0 THEN {whole('II', True)} ELSE {whole('MM', True)} END ELSE CASE WHEN k % 3 > 0 THEN {whole('II', False)} ELSE {whole('MM', False)} END END"
    scan = "array_to_string(list_transform(range(0, k % 50), lambda i: printf('%02x', i)), '')"
    return f"{front} || 'ffdb0042' || repeat('00', 64) || 'ffda000301' || {scan} || 'ffd9'"


@query(f"SELECT o_orderkey, CAST(77 + k % 50 AS INT) AS bare_bytes, sha1(unhex({_jpeg_hex()})) AS again, true AS same FROM (SELECT *, o_orderkey AS k FROM orders)")
def exif_inject(spark, sf_dir):
    """Stripped pictures, and those that got the source's EXIF back, by length and hash."""
    rows = pictures.jpegs(spark, sf_dir).withColumn("s", exif.exif_stripped_and_back(F.col("jpeg")))
    return rows.select("o_orderkey", F.length("s.bare").alias("bare_bytes"), F.sha1("s.again").alias("again"), (F.col("s.again") == F.col("jpeg")).alias("same"))


_BOARD = """pix AS (SELECT s_suppkey AS k, x, y, (x // (4 + s_suppkey % 5) + y // (4 + s_suppkey % 5)) % 2 = 0 AS red FROM supplier, range(0, 160) a(x), range(0, 120) b(y))"""
_BOXES = """bx AS (SELECT s_suppkey AS k, unnest([{'x': s_suppkey % 60, 'y': s_suppkey * 3 % 50, 'w': 30 + s_suppkey % 20, 'h': 20, 'c': 0.5::DOUBLE}, {'x': 90, 'y': s_suppkey * 7 % 40, 'w': 25, 'h': 60 + s_suppkey % 30, 'c': 0.8::DOUBLE}]) AS b FROM supplier),
bc AS (SELECT k, CAST(b.x AS DOUBLE) AS x, CAST(b.y AS DOUBLE) AS y, CAST(b.w AS DOUBLE) AS w, CASE WHEN b.y + b.h > 119.4::DOUBLE THEN 120::DOUBLE - b.y ELSE b.h END AS h, floor(least(b.w, b.h) / 2 * b.c + 0.5) AS r,
  b.x < 0.8::DOUBLE AS sl, b.y < 0.6::DOUBLE AS st, b.x + b.w > 159.2::DOUBLE AS sr, b.y + b.h > 119.4::DOUBLE AS sb FROM bx)"""


#: Which pixels of the boards a rounded box covers.
_COVERED = f"""WITH {_BOARD}, {_BOXES},
d AS (SELECT pix.k, pix.x AS px, pix.y AS py, red, w, h, bc.x + w / 2 AS cx, bc.y + h / 2 AS cy,
  CASE WHEN pix.x + 0.5::DOUBLE < bc.x + w / 2 THEN CASE WHEN pix.y + 0.5::DOUBLE < bc.y + h / 2 THEN CASE WHEN sl OR st THEN 0 ELSE r END ELSE CASE WHEN sl OR sb THEN 0 ELSE r END END
    ELSE CASE WHEN pix.y + 0.5::DOUBLE < bc.y + h / 2 THEN CASE WHEN sr OR st THEN 0 ELSE r END ELSE CASE WHEN sr OR sb THEN 0 ELSE r END END END AS r FROM pix JOIN bc ON pix.k = bc.k),
q AS (SELECT *, abs(px + 0.5::DOUBLE - cx) - w / 2 + r AS qx, abs(py + 0.5::DOUBLE - cy) - h / 2 + r AS qy FROM d),
i AS (SELECT k, px, py, red, bool_or(sqrt(greatest(qx, 0) * greatest(qx, 0) + greatest(qy, 0) * greatest(qy, 0)) + least(greatest(qx, qy), 0) - r <= 0) AS painted FROM q GROUP BY ALL)"""


@query(f"""{_COVERED}
SELECT k AS frame_id, 76800 AS n, CAST(sum(CASE WHEN painted THEN 10 WHEN red THEN 255 ELSE 0 END) AS BIGINT) AS red, CAST(sum(CASE WHEN painted THEN 20 ELSE 0 END) AS BIGINT) AS green,
  CAST(sum(CASE WHEN painted THEN 30 WHEN red THEN 0 ELSE 255 END) AS BIGINT) AS blue, CAST(sum((py * 160 + px) * CASE WHEN painted THEN 10 WHEN red THEN 255 ELSE 0 END) AS BIGINT) AS red_moment FROM i GROUP BY k""")
def redact_solid(spark, sf_dir):
    """Boxes painted over: the pictures' channel sums, and red weighed by place, tell how many pixels were painted and where."""
    return _redacted(spark, sf_dir, "solid")


#: The boards before anything is painted, boxes by their place among a frame's detections, and what is returned of a frame.
_PAINTED = f"""WITH {_BOARD}, {_BOXES}, bn AS (SELECT *, CASE WHEN x = 90 THEN 2 ELSE 1 END AS n FROM bc),
p0 AS (SELECT k, x, y, CASE WHEN red THEN 255 ELSE 0 END AS r, CASE WHEN red THEN 0 ELSE 255 END AS b FROM pix)"""
_SUMS = "SELECT k AS frame_id, 76800 AS n, CAST(sum(r) AS BIGINT) AS red, 0::BIGINT AS green, CAST(sum(b) AS BIGINT) AS blue, CAST(sum((y * 160 + x) * r) AS BIGINT) AS red_moment FROM p2 GROUP BY k"


def _pixelated(n: int) -> str:
    """SQL that replaces the n-th box of each frame by blocks of mean colour."""
    return f"""z{n} AS (SELECT k, CAST(x AS INT) AS ax, CAST(y AS INT) AS ay, CAST(w AS INT) AS w, CAST(h AS INT) AS h, greatest(8, least(60, floor(least(w, h) / 8 + 0.5))) AS block FROM bn WHERE n = {n}),
g{n} AS (SELECT p.*, p.x >= ax AND p.x < ax + w AND p.y >= ay AND p.y < ay + h AS inside, ((p.x - ax + 1) * CAST(ceil(w / block) AS INT) - 1) // w AS i, ((p.y - ay + 1) * CAST(ceil(h / block) AS INT) - 1) // h AS j FROM p{n - 1} p JOIN z{n} USING (k)),
m{n} AS (SELECT k, i, j, CAST(floor(sum(r) / count(*) + 0.5) AS INT) AS r, CAST(floor(sum(b) / count(*) + 0.5) AS INT) AS b FROM g{n} WHERE inside GROUP BY ALL),
p{n} AS (SELECT g.k, x, y, CASE WHEN inside THEN m.r ELSE g.r END AS r, CASE WHEN inside THEN m.b ELSE g.b END AS b FROM g{n} g LEFT JOIN m{n} m ON g.inside AND g.k = m.k AND g.i = m.i AND g.j = m.j)"""


def _triangle(name: str, source: str, n: int, along: str, across: str, start: str, size: str) -> str:
    """SQL that weighs a region's samples by a triangle along an axis: second differences of the sums of sums, edges repeated."""
    weighed = lambda c: f"CAST((lead(q{c}, s) OVER o - 2 * lag(q{c}, 1, 0) OVER o + lag(q{c}, s + 2, 0) OVER o) // ((s + 1) * (s + 1)) AS BIGINT) AS {c}"
    return f"""{name}a AS (SELECT p.k, p.{across}, t, s, {start} + t AS {along}, {size} AS size, p.r, p.b FROM (SELECT *, unnest(range(-s, {size} + s)) AS t FROM z{n}) z JOIN {source} p ON p.k = z.k AND p.{along} = {start} + greatest(0, least({size} - 1, t)) AND p.x BETWEEN xi AND xi + wi - 1 AND p.y BETWEEN yi AND yi + hi - 1),
{name}b AS (SELECT *, CAST(sum(r) OVER o AS BIGINT) AS sr, CAST(sum(b) OVER o AS BIGINT) AS sb FROM {name}a WINDOW o AS (PARTITION BY k, {across} ORDER BY t ROWS UNBOUNDED PRECEDING)),
{name}c AS (SELECT *, CAST(sum(sr) OVER o AS BIGINT) AS qr, CAST(sum(sb) OVER o AS BIGINT) AS qb FROM {name}b WINDOW o AS (PARTITION BY k, {across} ORDER BY t ROWS UNBOUNDED PRECEDING)),
{name} AS (SELECT k, x, y, {weighed("r")}, {weighed("b")} FROM {name}c WINDOW o AS (PARTITION BY k, {across} ORDER BY t) QUALIFY t BETWEEN 0 AND size - 1)"""


def _blurred(n: int) -> str:
    """SQL that blends the n-th box of each frame with its blurred region by the feathered mask."""
    corner = "CASE WHEN px < cx THEN CASE WHEN py < cy THEN CASE WHEN sl OR st THEN 0 ELSE r END ELSE CASE WHEN sl OR sb THEN 0 ELSE r END END ELSE CASE WHEN py < cy THEN CASE WHEN sr OR st THEN 0 ELSE r END ELSE CASE WHEN sr OR sb THEN 0 ELSE r END END END"
    mixed = lambda c: f"CASE WHEN f.k IS NULL THEN p.{c} ELSE CAST(round_even(v.{c} * share + p.{c} * (1 - share), 0) AS BIGINT) END AS {c}"
    return f"""f{n} AS (SELECT *, floor(greatest(3, greatest(w, h) / 12) + 0.5) AS fe FROM bn WHERE n = {n}),
e{n} AS (SELECT *, CAST(greatest(0, floor(x - 2 * fe)) AS INT) AS xi, CAST(greatest(0, floor(y - 2 * fe)) AS INT) AS yi, CAST(least(160, ceil(x + w + 2 * fe)) AS INT) AS xe, CAST(least(120, ceil(y + h + 2 * fe)) AS INT) AS ye FROM f{n}),
y{n} AS (SELECT * RENAME (x AS ax, y AS ay), least(xe - xi + 5 - (xe - xi) % 5, 160 - xi) AS wi, least(ye - yi + 5 - (ye - yi) % 5, 120 - yi) AS hi FROM e{n}),
z{n} AS (SELECT *, CAST(greatest(10, least(50, floor(wi * hi / 100 + 0.5))) AS INT) AS s FROM y{n}),
{_triangle(f"h{n}", f"p{n - 1}", n, "x", "y", "xi", "wi")},
{_triangle(f"v{n}", f"h{n}", n, "y", "x", "yi", "hi")},
k{n} AS (SELECT v.k, v.x, v.y, w, h, fe, z.r, sl, st, sr, sb, ax + w / 2 AS cx, ay + h / 2 AS cy, least(CASE WHEN sr THEN ax + w ELSE 1000 END, greatest(CASE WHEN sl THEN ax ELSE -1000 END, v.x)) AS px, least(CASE WHEN sb THEN ay + h ELSE 1000 END, greatest(CASE WHEN st THEN ay ELSE -1000 END, v.y)) AS py FROM v{n} v JOIN z{n} z USING (k)),
c{n} AS (SELECT *, {corner} AS rc FROM k{n}),
q{n} AS (SELECT *, abs(px - cx) - w / 2 + rc AS qx, abs(py - cy) - h / 2 + rc AS qy FROM c{n}),
a{n} AS (SELECT k, x, y, least(1, greatest(0, 1 - (sqrt(greatest(qx, 0) * greatest(qx, 0) + greatest(qy, 0) * greatest(qy, 0)) + least(greatest(qx, qy), 0) - rc) / fe)) AS share FROM q{n}),
p{n} AS (SELECT p.k, p.x, p.y, {mixed("r")}, {mixed("b")} FROM p{n - 1} p LEFT JOIN a{n} f ON p.k = f.k AND p.x = f.x AND p.y = f.y LEFT JOIN v{n} v ON p.k = v.k AND p.x = v.x AND p.y = v.y)"""


def _redacted(spark, sf_dir, mode):
    """Channel sums of redacted boards, and red weighed by place."""
    found = redact.redact(pictures.checkerboards(spark, sf_dir), mode, (10, 20, 30)).withColumn("s", redact.channel_sums(F.col("rgba")))
    return found.select("frame_id", F.length("rgba").alias("n"), "s.red", "s.green", "s.blue", "s.red_moment")


@query(f"{_COVERED} SELECT k AS frame_id, CAST(count(*) FILTER (WHERE NOT painted) AS BIGINT) AS lit, count(*) FILTER (WHERE NOT painted) / count(*)::DOUBLE AS ratio FROM i GROUP BY k")
def blackout_ratio(spark, sf_dir):
    """Share of a frame's pixels that aren't black once its boxes are painted in black: counted on the pixels."""
    found = redact.redact(pictures.checkerboards(spark, sf_dir), "solid").withColumn("lit", redact.channel_sums(F.col("rgba"))["lit"])
    return found.select("frame_id", "lit", (F.col("lit") / (F.col("width") * F.col("height"))).alias("ratio"))


@query(f"{_PAINTED}, {_pixelated(1)}, {_pixelated(2)} {_SUMS}")
def redact_pixelate(spark, sf_dir):
    """Boxes in blocks of mean colour, the second over the first; the SQL works the same blocks out pixel by pixel."""
    return _redacted(spark, sf_dir, "pixelate")


@query(f"{_PAINTED}, {_blurred(1)}, {_blurred(2)} {_SUMS}")
def redact_blur(spark, sf_dir):
    """Boxes blurred, the second over the first; the SQL weighs, masks and blends pixel by pixel."""
    return _redacted(spark, sf_dir, "blur")


@query(f"""WITH {_BOARD}, p AS (SELECT k, red, ((y + 1) * 160 + x) * 4 AS at FROM pix)
SELECT k AS frame_id, 230400 AS n, CAST(count(*) FILTER (WHERE red) AS BIGINT) AS ones_red, 0::BIGINT AS ones_green, CAST(count(*) FILTER (WHERE NOT red) AS BIGINT) AS ones_blue FROM p GROUP BY k""")
def tensor_build(spark, sf_dir):
    """Model input of checkerboards: its bytes, and how many samples of each plane are 1 (0000803f in little-endian floats), all others being 0."""
    rows = pictures.checkerboards(spark, sf_dir).withColumn("t", redact.tensor(F.col("rgba"), F.col("width"), F.col("height")))
    rows = rows.withColumn("ones", redact.samples_of_one(F.col("t")))
    return rows.select("frame_id", F.length("t").alias("n"), *(F.col("ones")[k].alias(f"ones_{c}") for k, c in enumerate(("red", "green", "blue"))))


@query(f"""WITH {_BOARD},
h AS (SELECT k, x // 2 AS x, y // 2 + 10 AS y, floor(255 * count(*) FILTER (WHERE red) / 4::DOUBLE + 0.5) AS r, floor(255 * count(*) FILTER (WHERE NOT red) / 4::DOUBLE + 0.5) AS b FROM pix GROUP BY k, x // 2, y // 2),
grid AS (SELECT k, gx, gy FROM (SELECT s_suppkey AS k FROM supplier), range(0, 4) a(gx), range(0, 4) b(gy)),
c AS (SELECT k, x // 20 AS gx, y // 20 AS gy, count(*) AS n, sum(r) AS r, sum(b) AS b FROM h GROUP BY ALL)
SELECT grid.k AS frame_id, gy * 4 + gx + 1 AS anchor, CAST(gx * 20 + 10 AS DOUBLE) AS cx, CAST(gy * 20 + 10 AS DOUBLE) AS cy, 20::DOUBLE AS w, 20::DOUBLE AS h,
  CAST(coalesce(r, 0) + 114 * (400 - coalesce(n, 0)) AS BIGINT) AS red, CAST(114 * (400 - coalesce(n, 0)) AS BIGINT) AS green, CAST(coalesce(b, 0) + 114 * (400 - coalesce(n, 0)) AS BIGINT) AS blue
FROM grid LEFT JOIN c USING (k, gx, gy)""")
def inference_heads(spark, sf_dir):
    """Head rows of a stand-in model on checkerboards that are letterboxed to half their size: sums of each plane over a grid of cells."""
    heads = inference.infer(pictures.checkerboards(spark, sf_dir), lambda: inference.cell_means(20), side=80)
    whole = lambda c: F.round(F.col(c) * (255 * 400)).cast("bigint")
    return heads.select("frame_id", "anchor", "cx", "cy", "w", "h", whole("obj").alias("red"), whole("c0").alias("green"), whole("c1").alias("blue"))


@query("""WITH s AS (SELECT event_id, list_transform(range(0, 24), lambda i: (event_id * 37 + i * 101) % 1024) AS v FROM events)
SELECT event_id, array_to_string(list_transform(v[1:16] || v[17:20] || v[21:24], lambda x: lpad(printf('%x', x // 4), 2, '0')), '') AS planes FROM s""")
def downscale_10bit(spark, sf_dir):
    """4 x 4 pictures of 10-bit samples, as hexadecimal 8-bit planes."""
    values = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda i: (F.col("event_id") * 37 + i * 101) % 1024)
    word = lambda v: F.concat(F.lpad(F.hex(v % 256), 2, "0"), F.lpad(F.hex(F.floor(v / 256)), 2, "0"))
    raw = F.unhex(F.array_join(F.transform(values, word), ""))
    layout = F.array(*(F.struct(F.lit(o).alias("offset"), F.lit(s).alias("stride")) for o, s in ((0, 8), (32, 4), (40, 4))))
    rows = table(spark, sf_dir, "events").select("event_id", redact.to_8_bit(raw, F.lit(4), F.lit(4), layout).alias("p"))
    return rows.select("event_id", F.lower(F.hex("p")).alias("planes"))


@query("""WITH p AS (SELECT event_id, i, event_id % 3 AS m, CAST((event_id * 37 + i * 53) % 877 AS DOUBLE) / 876 AS y, CAST(event_id * 7 % 101 - 50 AS DOUBLE) / 896 AS cb, CAST(event_id * 11 % 101 - 50 AS DOUBLE) / 896 AS cr,
  CASE WHEN event_id % 3 = 2 THEN 0.2126::DOUBLE ELSE 0.2627::DOUBLE END AS kr, CASE WHEN event_id % 3 = 2 THEN 0.0722::DOUBLE ELSE 0.0593::DOUBLE END AS kb FROM events, range(0, 16) t(i)),
q AS (SELECT *, y + 2 * (1 - kr) * cr AS r, y + 2 * (1 - kb) * cb AS b FROM p),
e AS (SELECT event_id, i, m, list_transform([r, (y - kr * r - kb * b) / (1 - kr - kb), b], lambda x: least(greatest(x, 0::DOUBLE), 1::DOUBLE)) AS v FROM q),
l AS (SELECT event_id, i, m, CASE m WHEN 0 THEN list_transform(v, lambda x: CASE WHEN x <= 0.5::DOUBLE THEN x * x / 3 ELSE (exp((x - 0.55991073::DOUBLE) / 0.17883277::DOUBLE) + 0.28466892::DOUBLE) / 12 END)
  WHEN 1 THEN list_transform(v, lambda x: least(pow(greatest(pow(x, 1 / 78.84375::DOUBLE) - 0.8359375::DOUBLE, 0) / (18.8515625::DOUBLE - 18.6875::DOUBLE * pow(x, 1 / 78.84375::DOUBLE)), 1 / 0.1593017578125::DOUBLE) * (10000 / 203::DOUBLE), 1)) ELSE v END AS v FROM e),
k AS (SELECT *, CASE WHEN m = 0 THEN pow(greatest(0.2627::DOUBLE * v[1] + 0.6780::DOUBLE * v[2] + 0.0593::DOUBLE * v[3], 1e-6), 0.2::DOUBLE) ELSE 1 END AS k FROM l),
d AS (SELECT event_id, i, m, v, v[1] * k AS r, v[2] * k AS g, v[3] * k AS b FROM k),
c AS (SELECT event_id, i, m, CASE WHEN m = 2 THEN v ELSE list_transform([1.6605::DOUBLE * r + -0.5877::DOUBLE * g + -0.0728::DOUBLE * b, -0.1246::DOUBLE * r + 1.1329::DOUBLE * g + -0.0083::DOUBLE * b, -0.0182::DOUBLE * r + -0.1006::DOUBLE * g + 1.1187::DOUBLE * b],
  lambda x: CASE WHEN least(greatest(x, 0), 1) <= 0.0031308::DOUBLE THEN 12.92::DOUBLE * least(greatest(x, 0), 1) ELSE 1.055::DOUBLE * pow(least(greatest(x, 0), 1), 1 / 2.4::DOUBLE) - 0.055::DOUBLE END) END AS v FROM d)
SELECT event_id, CASE m WHEN 0 THEN 'hlg' WHEN 1 THEN 'pq' END AS effective, string_agg(array_to_string(list_transform(v, lambda x: printf('%02X', CAST(floor(255 * x + 0.5) AS INT))), '') || 'FF', '' ORDER BY i) AS rgba FROM c GROUP BY event_id, m""")
def hdr_frames(spark, sf_dir):
    """4 x 4 frames of 10-bit planes in RGBA, as hexadecimal text: HLG and PQ frames tone-mapped, the others as they are."""
    luma = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: 64 + (F.col("event_id") * 37 + i * 53) % 877)
    chroma = lambda k: F.array_repeat(512 + F.col("event_id") * k % 101 - 50, 4)
    word = lambda v: F.concat(F.lpad(F.hex(v % 256), 2, "0"), F.lpad(F.hex(F.floor(v / 256)), 2, "0"))
    planes = F.unhex(F.array_join(F.transform(F.concat(luma, chroma(7), chroma(11)), word), ""))
    space = F.element_at(F.array(*map(F.lit, ("bt2020", "bt2020", "bt709"))), (F.col("event_id") % 3 + 1).cast("int"))
    transfer = F.element_at(F.array(*map(F.lit, ("hlg", "pq", "bt709"))), (F.col("event_id") % 3 + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select("event_id", F.lit(4).alias("width"), F.lit(4).alias("height"), planes.alias("planes"), space.alias("primaries"), transfer.alias("transfer"), F.lit(False).alias("full_range"))
    return hdr.rendered(rows).select("event_id", "effective", F.hex("rgba").alias("rgba"))


@query("""WITH p AS (SELECT p_partkey, 3 + p_partkey % 3 AS w, 2 + p_partkey // 3 % 2 AS h, CASE WHEN p_partkey % 10 BETWEEN 1 AND 8 THEN p_partkey % 10 ELSE 1 END AS o FROM part),
q AS (SELECT *, o IN (3, 4, 6, 7) AS rows, o IN (2, 3, 7, 8) AS columns, CASE WHEN o >= 5 THEN h ELSE w END AS width, CASE WHEN o >= 5 THEN w ELSE h END AS height FROM p),
x AS (SELECT *, CASE WHEN o >= 5 THEN i % width ELSE i // width END AS r, CASE WHEN o >= 5 THEN i // width ELSE i % width END AS c FROM q, range(0, 15) t(i) WHERE i < w * h),
y AS (SELECT *, CASE WHEN rows THEN h - 1 - r ELSE r END * w + CASE WHEN columns THEN w - 1 - c ELSE c END AS source FROM x)
SELECT p_partkey, o AS orientation, width, height, string_agg(printf('%02X%02X00FF', source, p_partkey % 251), '' ORDER BY i) AS rgba FROM y GROUP BY ALL""")
def oriented_pictures(spark, sf_dir):
    """Small pictures turned by the orientation in the EXIF segment of their files; 0 and 9 turn nothing."""
    size = {"width": F.expr("3 + p_partkey % 3"), "height": F.expr("2 + p_partkey div 3 % 2")}
    pixels = F.transform(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1), lambda i: F.concat(F.lpad(F.hex(i), 2, "0"), F.lpad(F.hex(F.col("p_partkey") % 251), 2, "0"), F.lit("00FF")))
    head = F.concat(F.lit("FFD8FFE10022457869660000" + "4D4D002A00000008" + "0001" + "0112000300000001" + "000"), (F.col("p_partkey") % 10).cast("string"), F.lit("0000" + "00000000" + "FFDA0002"))
    rows = table(spark, sf_dir, "part").select("p_partkey").withColumns(size).withColumn("rgba", F.unhex(F.array_join(pixels, "")))
    rows = rows.withColumn("orientation", orient.orientation(F.unhex(head)))
    return orient.oriented(rows).select("p_partkey", F.col("orientation").cast("bigint").alias("orientation"), "width", "height", F.hex("rgba").alias("rgba"))
