"""Box and canvas arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Model input side, and the share of a canvas within which a box sticks to its edge (fixed values).
SIDE, EDGE = 1280, 0.005
#: Corner rounding of each label (fixed values).
CORNER = {"plate": 0.5, "person": 0.8}


def half_up(x: Column) -> Column:
    """Rounds .5 towards plus infinity."""
    return F.floor(x + 0.5)


def iou(a: dict[str, Column] | Column, b: dict[str, Column] | Column) -> Column:
    """Intersection over union of centre boxes; 0 where the union is empty."""
    side = lambda c, s: F.greatest(F.lit(0.0), F.least(a[c] + a[s] / 2, b[c] + b[s] / 2) - F.greatest(a[c] - a[s] / 2, b[c] - b[s] / 2))
    inter = side("cx", "w") * side("cy", "h")
    union = a["w"] * a["h"] + b["w"] * b["h"] - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def letterbox(width: Column, height: Column, side: int = SIDE) -> dict[str, Column]:
    """Scale, scaled size and padding that fit a picture into the model's square."""
    scale = F.least(F.lit(float(side)) / width, F.lit(float(side)) / height)
    w, h = half_up(width * scale), half_up(height * scale)
    return {"scale": scale, "scaled_w": w, "scaled_h": h, "pad_x": F.floor((side - w) / 2), "pad_y": F.floor((side - h) / 2)}


def to_picture(box: dict[str, Column], scale: Column, pad_x: Column, pad_y: Column) -> dict[str, Column]:
    """A centre box in model space as a top-left box in picture pixels, whole numbers."""
    return {
        "x": half_up((box["cx"] - box["w"] / 2 - pad_x) / scale),
        "y": half_up((box["cy"] - box["h"] / 2 - pad_y) / scale),
        "w": half_up(box["w"] / scale),
        "h": half_up(box["h"] / scale),
    }


def expand(box: dict[str, Column], fraction: float, width: Column, height: Column) -> dict[str, Column]:
    """Pad a top-left box by half the fraction of its size on every side, within the canvas; no fraction, no change."""
    if fraction <= 0:
        return box
    pad_x, pad_y = box["w"] * fraction * 0.5, box["h"] * fraction * 0.5
    x, y = F.greatest(F.lit(0.0), box["x"] - pad_x), F.greatest(F.lit(0.0), box["y"] - pad_y)
    right, bottom = F.least(width, box["x"] + box["w"] + pad_x), F.least(height, box["y"] + box["h"] + pad_y)
    return {"x": x, "y": y, "w": right - x, "h": bottom - y}


def corner_radius(label: Column, w: Column, h: Column) -> Column:
    ratio = F.when(label == "plate", CORNER["plate"]).otherwise(CORNER["person"])
    return half_up(F.least(w, h) / 2 * ratio)


def clip_to_edges(box: dict[str, Column], radius: Column, width: Column, height: Column) -> dict[str, Column]:
    """Stretch a box that comes close to an edge up to it; corners at such edges are square."""
    near_x, near_y = width * EDGE, height * EDGE
    left, top = box["x"] < near_x, box["y"] < near_y
    right, bottom = box["x"] + box["w"] > width - near_x, box["y"] + box["h"] > height - near_y
    zero = F.lit(0.0)
    x, y = F.when(left, zero).otherwise(box["x"]), F.when(top, zero).otherwise(box["y"])
    w = F.when(right, width - x).when(left, box["w"] + box["x"]).otherwise(box["w"])
    h = F.when(bottom, height - y).when(top, box["h"] + box["y"]).otherwise(box["h"])
    corner = lambda a, b: F.when(~a & ~b, radius).otherwise(F.lit(0))
    return {
        "x": x, "y": y, "w": w, "h": h, "snap_l": left, "snap_t": top, "snap_r": right, "snap_b": bottom,
        "tl": corner(left, top), "tr": corner(right, top), "br": corner(right, bottom), "bl": corner(left, bottom),
    }


def feather(w: Column, h: Column) -> Column:
    return half_up(F.greatest(F.lit(3.0), F.greatest(w, h) / 12))


def blur_region(box: dict[str, Column], width: Column, height: Column) -> dict[str, Column]:
    """Pixels that a blur reads: two feathers around the box, in the canvas; and its stepped size and strength."""
    f = feather(box["w"], box["h"])
    xi, yi = F.greatest(F.lit(0), F.floor(box["x"] - f * 2)), F.greatest(F.lit(0), F.floor(box["y"] - f * 2))
    xe, ye = F.least(width, F.ceil(box["x"] + box["w"] + f * 2)), F.least(height, F.ceil(box["y"] + box["h"] + f * 2))
    wi = F.least(xe - xi + 5 - (xe - xi) % 5, width - xi)
    hi = F.least(ye - yi + 5 - (ye - yi) % 5, height - yi)
    strength = F.greatest(F.lit(10), F.least(F.lit(50), half_up(wi * hi / 100)))
    return {"feather": f, "xi": xi, "yi": yi, "xe": xe, "ye": ye, "wi": wi, "hi": hi, "strength": strength}


def pixel_grid(w: Column, h: Column, width: Column) -> dict[str, Column]:
    """Block size of a pixelated box of whole-number size, and its columns and rows."""
    block = F.greatest(F.lit(8), F.least(F.lit(60), half_up(F.least(w, h) / 8 * F.greatest(F.lit(1.0), width / 1280))))
    return {"block": block, "cols": F.ceil(w / block), "rows": F.ceil(h / block)}


def label_chip(box: dict[str, Column], width: Column, height: Column) -> dict[str, Column]:
    """Font size of a label on a canvas, and where its chip and text stand above a top-left box."""
    font = F.greatest(F.lit(11), half_up(F.least(width, height) * 0.012)).cast("bigint")
    return {"font": font, "chip_y": box["y"] - font - 3, "chip_h": font + 3, "text_x": box["x"] + 2, "text_y": box["y"] - 5}


def rounded_distance(px: Column, py: Column, box: dict[str, Column]) -> Column:
    """Signed distance from a point to a rounded box (ox, oy, dw, dh and a radius for each corner)."""
    hx, hy = box["dw"] / 2, box["dh"] / 2
    cx, cy = box["ox"] + hx, box["oy"] + hy
    r = F.when(px < cx, F.when(py < cy, box["tl"]).otherwise(box["bl"])).otherwise(F.when(py < cy, box["tr"]).otherwise(box["br"]))
    qx, qy = F.abs(px - cx) - hx + r, F.abs(py - cy) - hy + r
    zero = F.lit(0.0)
    ax, ay = F.greatest(qx, zero), F.greatest(qy, zero)
    return F.sqrt(ax * ax + ay * ay) + F.least(F.greatest(qx, qy), zero) - r
