"""Queries over detector output: gates, suppression, coordinates, boxes on the canvas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framesift.functions import geometry as g
from framesift.operators import nms, overlap
from framesift.plans.registry import query
from framesift.sources.tables import RAW, raw_boxes

_GATED = "WITH RECURSIVE" + RAW + """,
c AS (SELECT frame_id, anchor, cx, cy, w, h, 'plate' AS label, obj * c0 AS conf FROM raw WHERE obj >= 0.01::DOUBLE
      UNION ALL SELECT frame_id, anchor, cx, cy, w, h, 'person', obj * c1 FROM raw WHERE obj >= 0.01::DOUBLE),
b AS (SELECT * FROM c WHERE conf >= 0.01::DOUBLE),
r AS (SELECT *, row_number() OVER (PARTITION BY frame_id, label ORDER BY conf DESC, anchor) AS rank FROM b QUALIFY rank <= 1500)
"""

#: Canvas of a frame, and a candidate's box on it.
_CANVAS = "CAST(CASE frame_id % 3 WHEN 0 THEN 300 WHEN 1 THEN 400 ELSE 1429 END AS DOUBLE) AS width, CAST(CASE frame_id % 3 WHEN 0 THEN 300 WHEN 1 THEN 250 ELSE 497 END AS DOUBLE) AS height"
_PLACED = _GATED + f""",
p AS (SELECT frame_id, label, anchor, rank, conf, cx - w / 2 AS x, cy - h / 2 AS y, w, h, {_CANVAS} FROM r)
"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nms.class_candidates(raw_boxes(spark, sf_dir))


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked candidates as top-left boxes on their frame's canvas."""
    return _on_canvas(nms.top_per_class(_candidates(spark, sf_dir)))


def _on_canvas(boxes: DataFrame) -> DataFrame:
    return boxes.select(
        "frame_id", "label", "anchor", "conf",
        (F.col("cx") - F.col("w") / 2).alias("x"), (F.col("cy") - F.col("h") / 2).alias("y"), "w", "h",
        F.expr("double(case frame_id % 3 when 0 then 300 when 1 then 400 else 1429 end)").alias("width"),
        F.expr("double(case frame_id % 3 when 0 then 300 when 1 then 250 else 497 end)").alias("height"),
    )


_KEY = ("frame_id", "label", "anchor")


def _box() -> dict:
    return {c: F.col(c) for c in ("x", "y", "w", "h")}


@query(_GATED + "SELECT frame_id, anchor, obj FROM raw WHERE obj >= 0.01::DOUBLE")
def gate_objectness(spark, sf_dir):
    return nms.gate_objectness(raw_boxes(spark, sf_dir)).select("frame_id", "anchor", "obj")


@query(_GATED + "SELECT frame_id, label, anchor, conf FROM b")
def gate_class_confidence(spark, sf_dir):
    return _candidates(spark, sf_dir).select(*_KEY, "conf")


@query(_GATED + "SELECT frame_id, label, anchor, conf, rank FROM r")
def topk_per_class(spark, sf_dir):
    return nms.top_per_class(_candidates(spark, sf_dir)).select(*_KEY, "conf", "rank")


_NMS = _GATED + """,
m AS (SELECT frame_id, label, max(rank) AS n FROM r GROUP BY ALL),
k AS (SELECT frame_id, label, 1::BIGINT AS i, [{'cx': cx, 'cy': cy, 'w': w, 'h': h, 'anchor': anchor, 'conf': conf}] AS acc FROM r WHERE rank = 1
  UNION ALL
  SELECT k.frame_id, k.label, k.i + 1,
    CASE WHEN len(list_filter(list_transform(k.acc, lambda a: {
        'n': greatest(0::DOUBLE, least(a.cx + a.w / 2, r.cx + r.w / 2) - greatest(a.cx - a.w / 2, r.cx - r.w / 2))
           * greatest(0::DOUBLE, least(a.cy + a.h / 2, r.cy + r.h / 2) - greatest(a.cy - a.h / 2, r.cy - r.h / 2)),
        's': a.w * a.h + r.w * r.h}), lambda z: z.n / (z.s - z.n) > 0.45::DOUBLE)) > 0 THEN k.acc
    ELSE list_append(k.acc, {'cx': r.cx, 'cy': r.cy, 'w': r.w, 'h': r.h, 'anchor': r.anchor, 'conf': r.conf}) END
  FROM k JOIN r ON r.frame_id = k.frame_id AND r.label = k.label AND r.rank = k.i + 1),
d AS (SELECT k.frame_id, k.label, unnest(k.acc) AS a FROM k JOIN m ON m.frame_id = k.frame_id AND m.label = k.label AND m.n = k.i),
kept AS (SELECT frame_id, label, a.anchor AS anchor, a.conf AS conf, a.cx AS cx, a.cy AS cy, a.w AS w, a.h AS h FROM d)
"""


@query(_NMS + "SELECT frame_id, label, anchor, conf FROM kept")
def nms_greedy(spark, sf_dir):
    return nms.suppress(_candidates(spark, sf_dir)).select(*_KEY, "conf")


@query(_NMS + "SELECT frame_id, label, anchor, conf FROM kept")
def nms_dense(spark, sf_dir):
    return nms.suppress_dense(_candidates(spark, sf_dir)).select(*_KEY, "conf")


@query(_GATED + """, s AS (SELECT *, least(1280::DOUBLE / 1429, 1280::DOUBLE / 497) AS scale, 0::DOUBLE AS px, floor((1280 - floor(497 * least(1280::DOUBLE / 1429, 1280::DOUBLE / 497) + 0.5)) / 2) AS py FROM r)
SELECT frame_id, label, anchor, CAST(floor((cx - w / 2 - px) / scale + 0.5) AS BIGINT) AS x, CAST(floor((cy - h / 2 - py) / scale + 0.5) AS BIGINT) AS y,
  CAST(floor(w / scale + 0.5) AS BIGINT) AS w, CAST(floor(h / scale + 0.5) AS BIGINT) AS h FROM s""")
def unletterbox(spark, sf_dir):
    fit = g.letterbox(F.lit(1429), F.lit(497))
    box = g.to_picture({c: F.col(c) for c in ("cx", "cy", "w", "h")}, fit["scale"], fit["pad_x"], fit["pad_y"])
    return nms.top_per_class(_candidates(spark, sf_dir)).select(*_KEY, *(v.cast("bigint").alias(k) for k, v in box.items()))


@query(_GATED + "SELECT frame_id, label, anchor, conf FROM b WHERE conf >= 0.25::DOUBLE")
def filter_confidence(spark, sf_dir):
    return nms.filter_detections(_candidates(spark, sf_dir), 0.25, nms.LABELS).select(*_KEY, "conf")


@query(_GATED + "SELECT frame_id, label, anchor, conf FROM b WHERE label IN ('person')")
def filter_labels(spark, sf_dir):
    return nms.filter_detections(_candidates(spark, sf_dir), 0.0, ("person",)).select(*_KEY, "conf")


@query(_PLACED + """, e AS (SELECT *, greatest(0::DOUBLE, x - w * 0.2::DOUBLE * 0.5::DOUBLE) AS ex, greatest(0::DOUBLE, y - h * 0.2::DOUBLE * 0.5::DOUBLE) AS ey FROM p)
SELECT frame_id, label, anchor, ex AS x, ey AS y, least(width, x + w + w * 0.2::DOUBLE * 0.5::DOUBLE) - ex AS w, least(height, y + h + h * 0.2::DOUBLE * 0.5::DOUBLE) - ey AS h FROM e""")
def expand_boxes(spark, sf_dir):
    box = g.expand(_box(), 0.2, F.col("width"), F.col("height"))
    return _placed(spark, sf_dir).select(*_KEY, *(v.alias(k) for k, v in box.items()))


@query(_NMS + "SELECT frame_id, count(*) AS n, count(*) FILTER (WHERE label = 'plate') AS n_plate, max(conf) AS best FROM kept GROUP BY frame_id")
def detections_per_frame(spark, sf_dir):
    found = nms.suppress(_candidates(spark, sf_dir))
    return found.groupBy("frame_id").agg(F.count("*").alias("n"), F.count(F.when(F.col("label") == "plate", 1)).alias("n_plate"), F.max("conf").alias("best"))


@query(_GATED + """, n AS (SELECT *, lag(cx) OVER o AS px, lag(cy) OVER o AS py, lag(w) OVER o AS pw, lag(h) OVER o AS ph FROM r WINDOW o AS (PARTITION BY frame_id, label ORDER BY rank)),
i AS (SELECT *, greatest(0::DOUBLE, least(px + pw / 2, cx + w / 2) - greatest(px - pw / 2, cx - w / 2)) * greatest(0::DOUBLE, least(py + ph / 2, cy + h / 2) - greatest(py - ph / 2, cy - h / 2)) AS inter FROM n WHERE px IS NOT NULL)
SELECT frame_id, label, rank, inter / (pw * ph + w * h - inter) AS iou FROM i""")
def iou_neighbours(spark, sf_dir):
    """IoU of each candidate with the one ranked before it."""
    order = Window.partitionBy("frame_id", "label").orderBy("rank")
    rows = nms.top_per_class(_candidates(spark, sf_dir)).withColumn("here", F.struct("cx", "cy", "w", "h"))
    rows = rows.withColumn("before", F.lag("here").over(order)).where("before IS NOT NULL")
    return rows.select("frame_id", "label", "rank", g.iou(F.col("before"), F.col("here")).alias("iou"))


_CLIP = _PLACED + """,
e AS (SELECT *, floor(least(w, h) / 2 * CASE WHEN label = 'plate' THEN 0.5::DOUBLE ELSE 0.8::DOUBLE END + 0.5) AS r, x < width * 0.005::DOUBLE AS l, y < height * 0.005::DOUBLE AS t,
  x + w > width - width * 0.005::DOUBLE AS rr, y + h > height - height * 0.005::DOUBLE AS bb FROM p),
clip AS (SELECT frame_id, label, anchor, width, height, CASE WHEN l THEN 0 ELSE x END AS x, CASE WHEN t THEN 0 ELSE y END AS y,
  CASE WHEN rr THEN width - CASE WHEN l THEN 0 ELSE x END WHEN l THEN w + x ELSE w END AS w,
  CASE WHEN bb THEN height - CASE WHEN t THEN 0 ELSE y END WHEN t THEN h + y ELSE h END AS h, l, t, rr, bb, r FROM e)
"""


@query(_CLIP + """SELECT frame_id, label, anchor, x, y, w, h, l AS snap_l, t AS snap_t, rr AS snap_r, bb AS snap_b,
  CAST(CASE WHEN NOT l AND NOT t THEN r ELSE 0 END AS BIGINT) AS tl, CAST(CASE WHEN NOT rr AND NOT t THEN r ELSE 0 END AS BIGINT) AS tr,
  CAST(CASE WHEN NOT rr AND NOT bb THEN r ELSE 0 END AS BIGINT) AS br, CAST(CASE WHEN NOT l AND NOT bb THEN r ELSE 0 END AS BIGINT) AS bl FROM clip""")
def clip_to_edges(spark, sf_dir):
    radius = g.corner_radius(F.col("label"), F.col("w"), F.col("h"))
    box = g.clip_to_edges(_box(), radius, F.col("width"), F.col("height"))
    return _placed(spark, sf_dir).select(*_KEY, *((v.cast("bigint") if k in ("tl", "tr", "br", "bl") else v).alias(k) for k, v in box.items()))


@query(_PLACED + "SELECT frame_id, label, anchor, CAST(floor(least(w, h) / 2 * CASE WHEN label = 'plate' THEN 0.5::DOUBLE ELSE 0.8::DOUBLE END + 0.5) AS BIGINT) AS radius FROM p")
def corner_radius(spark, sf_dir):
    return _placed(spark, sf_dir).select(*_KEY, g.corner_radius(F.col("label"), F.col("w"), F.col("h")).cast("bigint").alias("radius"))


_REGION = _CLIP + """,
f AS (SELECT *, floor(greatest(3::DOUBLE, greatest(w, h) / 12) + 0.5) AS fe FROM clip),
x0 AS (SELECT *, greatest(0, floor(x - fe * 2)) AS xi, greatest(0, floor(y - fe * 2)) AS yi, least(width, ceil(x + w + fe * 2)) AS xe, least(height, ceil(y + h + fe * 2)) AS ye FROM f),
region AS (SELECT *, least(xe - xi + 5 - CAST(xe - xi AS BIGINT) % 5, width - xi) AS wi, least(ye - yi + 5 - CAST(ye - yi AS BIGINT) % 5, height - yi) AS hi FROM x0)
"""


def _region(placed: DataFrame) -> DataFrame:
    radius = g.corner_radius(F.col("label"), F.col("w"), F.col("h"))
    box = g.clip_to_edges(_box(), radius, F.col("width"), F.col("height"))
    clipped = placed.select(*_KEY, "conf", "width", "height", *(box[c].alias(c) for c in ("x", "y", "w", "h")))
    region = g.blur_region(_box(), F.col("width"), F.col("height"))
    return clipped.select(*_KEY, "conf", *(v.cast("bigint").alias(k) for k, v in region.items()))


@query(_REGION + """SELECT frame_id, label, anchor, CAST(fe AS BIGINT) AS feather, CAST(xi AS BIGINT) AS xi, CAST(yi AS BIGINT) AS yi, CAST(xe AS BIGINT) AS xe, CAST(ye AS BIGINT) AS ye,
  CAST(wi AS BIGINT) AS wi, CAST(hi AS BIGINT) AS hi, CAST(greatest(10, least(50, floor(wi * hi / 100 + 0.5))) AS BIGINT) AS strength FROM region""")
def blur_region(spark, sf_dir):
    return _region(_placed(spark, sf_dir)).drop("conf")


@query(_PLACED + """, s AS (SELECT *, floor(w + 0.5) AS bw, floor(h + 0.5) AS bh FROM p),
b2 AS (SELECT *, greatest(8, least(60, floor(least(bw, bh) / 8 * greatest(1::DOUBLE, width / 1280) + 0.5))) AS block FROM s)
SELECT frame_id, label, anchor, CAST(block AS BIGINT) AS block, CAST(ceil(bw / block) AS BIGINT) AS cols, CAST(ceil(bh / block) AS BIGINT) AS rows FROM b2""")
def pixelate_grid(spark, sf_dir):
    grid = g.pixel_grid(g.half_up(F.col("w")), g.half_up(F.col("h")), F.col("width"))
    return _placed(spark, sf_dir).select(*_KEY, *(v.cast("bigint").alias(k) for k, v in grid.items()))


@query(_NMS + """, o AS (SELECT *, row_number() OVER (PARTITION BY frame_id, label ORDER BY conf DESC, anchor) - 1 AS idx FROM kept)
SELECT frame_id, label, anchor, CAST(floor(conf * 100 + 0.5) AS BIGINT) AS percent,
  label || ' ' || CAST(CAST(floor(conf * 100 + 0.5) AS BIGINT) AS VARCHAR) || '%' AS caption,
  CASE WHEN label = 'plate' THEN ['#ff3b30', '#ff9500', '#ff2d55', '#ffcc00'][idx % 4 + 1] ELSE ['#0a84ff', '#5ac8fa', '#30d158', '#64d2ff'][idx % 4 + 1] END AS colour FROM o""")
def outline_palette(spark, sf_dir):
    # colours of outlines by label, in the order they are used (fixed values)
    palette = {"plate": ["#ff3b30", "#ff9500", "#ff2d55", "#ffcc00"], "person": ["#0a84ff", "#5ac8fa", "#30d158", "#64d2ff"]}
    order = Window.partitionBy("frame_id", "label").orderBy(F.desc("conf"), "anchor")
    found = nms.suppress(_candidates(spark, sf_dir)).withColumn("idx", (F.row_number().over(order) - 1) % 4 + 1)
    percent = g.half_up(F.col("conf") * 100).cast("bigint")
    colour = [F.element_at(F.array(*map(F.lit, palette[k])), F.col("idx")) for k in nms.LABELS]
    return found.select(
        *_KEY, percent.alias("percent"), F.concat(F.col("label"), F.lit(" "), percent.cast("string"), F.lit("%")).alias("caption"),
        F.when(F.col("label") == "plate", colour[0]).otherwise(colour[1]).alias("colour"),
    )


@query(_NMS + f""", v AS (SELECT kept.*, {_CANVAS} FROM kept), t AS (SELECT *, greatest(11, floor(least(width, height) * 0.012::DOUBLE + 0.5)) AS font FROM v)
SELECT frame_id, label, anchor, cx - w / 2 AS x, cy - h / 2 AS y, w, h, CAST(font AS BIGINT) AS font, cy - h / 2 - font - 3 AS chip_y, CAST(font + 3 AS BIGINT) AS chip_h, cx - w / 2 + 2 AS text_x, cy - h / 2 - 5 AS text_y FROM t""")
def outline_geometry(spark, sf_dir):
    """Rectangle of each outline, and the place of its label: a chip above it as high as its text, whose width is the font's."""
    boxes = _on_canvas(nms.suppress(_candidates(spark, sf_dir)))
    return boxes.select(*_KEY, "x", "y", "w", "h", *(v.alias(k) for k, v in g.label_chip(_box(), F.col("width"), F.col("height")).items()))


@query(_NMS + """, s AS (SELECT frame_id, label, conf, least(1280::DOUBLE / 1429, 1280::DOUBLE / 497) AS scale, floor((1280 - floor(497 * least(1280::DOUBLE / 1429, 1280::DOUBLE / 497) + 0.5)) / 2) AS py, cx, cy, w, h FROM kept WHERE conf >= 0.05::DOUBLE),
p AS (SELECT frame_id, label, conf, floor((cx - w / 2) / scale + 0.5) AS x, floor((cy - h / 2 - py) / scale + 0.5) AS y, floor(w / scale + 0.5) AS w, floor(h / scale + 0.5) AS h FROM s),
e AS (SELECT *, greatest(0::DOUBLE, x - w * 0.2::DOUBLE * 0.5::DOUBLE) AS ex, greatest(0::DOUBLE, y - h * 0.2::DOUBLE * 0.5::DOUBLE) AS ey FROM p),
a AS (SELECT *, (least(1429::DOUBLE, x + w + w * 0.2::DOUBLE * 0.5::DOUBLE) - ex) * (least(497::DOUBLE, y + h + h * 0.2::DOUBLE * 0.5::DOUBLE) - ey) AS area FROM e)
SELECT frame_id, label, count(*) AS n, max(conf) AS best, CAST(sum(CAST(round(area) AS BIGINT)) AS BIGINT) AS area FROM a GROUP BY frame_id, label""")
def flagship(spark, sf_dir):
    """The whole chain, from head rows to expanded boxes on the picture, counted by frame and label."""
    from framesift.plans import flagship as chain

    return chain(spark, sf_dir)


#: Regions of the boxes that suppression keeps; the two recursive folds share one statement.
_KEPT_REGION = _NMS + _REGION[len(_GATED):] + """,
q AS MATERIALIZED (SELECT region.frame_id, region.label, region.anchor, z.conf, CAST(xi AS BIGINT) AS xi, CAST(yi AS BIGINT) AS yi, CAST(xe AS BIGINT) AS xe, CAST(ye AS BIGINT) AS ye
  FROM region JOIN (SELECT frame_id, label, anchor, conf FROM kept) z USING (frame_id, label, anchor))
"""


@query(_KEPT_REGION + """, g AS (SELECT *, unnest(range(xi // 128, (xe - 1) // 128 + 1)) AS gx FROM q WHERE xe > xi AND ye > yi),
c2 AS MATERIALIZED (SELECT *, unnest(range(yi // 128, (ye - 1) // 128 + 1)) AS gy FROM g)
SELECT a.frame_id, a.label AS label_a, a.anchor AS anchor_a, b.label AS label_b, b.anchor AS anchor_b FROM c2 a JOIN c2 b ON a.frame_id = b.frame_id AND a.gx = b.gx AND a.gy = b.gy
WHERE (a.label < b.label OR a.label = b.label AND a.anchor < b.anchor) AND NOT (a.xe <= b.xi OR b.xe <= a.xi OR a.ye <= b.yi OR b.ye <= a.yi)
  AND greatest(a.xi, b.xi) // 128 = a.gx AND greatest(a.yi, b.yi) // 128 = a.gy""")
def overlap_pairs(spark, sf_dir):
    """Blur regions of all detections of a frame that overlap; touching ones don't. Regions are computed once and meet by frame."""
    return overlap.overlapping(_kept_regions(spark, sf_dir))


def _kept_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of every box that suppression keeps."""
    return _region(_on_canvas(nms.suppress_dense(_candidates(spark, sf_dir))))


@query(_KEPT_REGION + """,
n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY CASE label WHEN 'plate' THEN 1 ELSE 2 END, conf DESC, anchor) AS i FROM q),
z AS (SELECT frame_id, max(i) AS n FROM n GROUP BY frame_id),
w AS (SELECT frame_id, 0::BIGINT AS i, []::STRUCT(b BIGINT, xi BIGINT, yi BIGINT, xe BIGINT, ye BIGINT)[] AS acc FROM z
  UNION ALL SELECT w.frame_id, n.i, list_append(w.acc, {'b': list_min(list_filter(range(1, len(w.acc) + 2),
     lambda t: NOT list_contains(list_transform(list_filter(w.acc, lambda o: NOT (n.xe <= o.xi OR o.xe <= n.xi OR n.ye <= o.yi OR o.ye <= n.yi)), lambda o: o.b), t))), 'xi': n.xi, 'yi': n.yi, 'xe': n.xe, 'ye': n.ye})
  FROM w JOIN n ON n.frame_id = w.frame_id AND n.i = w.i + 1)
SELECT w.frame_id, n.label, n.anchor, w.acc[n.i].b AS batch FROM w JOIN z ON z.frame_id = w.frame_id AND z.n = w.i JOIN n ON n.frame_id = w.frame_id""")
def overlap_batches(spark, sf_dir):
    """First-fit batches of the regions of all detections of a frame, so that no two of a batch overlap; plates first, then people, the surest first."""
    return overlap.batches(_kept_regions(spark, sf_dir))
