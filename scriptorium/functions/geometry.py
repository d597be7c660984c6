"""Box, polygon and page geometry as column expressions. Points are array<array<double>>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _axis(points: Column, i: int) -> Column:
    return F.transform(points, lambda p: p[i])


def bbox(points: Column) -> Column:
    """struct x0, y0, x1, y1 of a polygon; null without points."""
    x, y = _axis(points, 0), _axis(points, 1)
    box = F.struct(F.array_min(x).alias("x0"), F.array_min(y).alias("y0"), F.array_max(x).alias("x1"), F.array_max(y).alias("y1"))
    return F.when(F.size(points) > 0, box)


def clip_line(points: Column, box: Column, width: Column, height: Column) -> Column:
    """Points relative to the box's corner, kept inside a frame of the given size."""
    def inside(v: Column, size: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(v, size - 1))

    return F.transform(points, lambda p: F.array(inside(p[0] - box["x0"], width), inside(p[1] - box["y0"], height)))


def frame(width: Column, height: Column) -> Column:
    """Boundary of a whole line image."""
    w, h, z = (width - 1).cast("double"), (height - 1).cast("double"), F.lit(0.0)
    return F.array(F.array(z, z), F.array(w, z), F.array(w, h), F.array(z, h))


def middle_line(width: Column, height: Column) -> Column:
    """Baseline at three quarters of the height, at least one pixel off either edge."""
    y = F.greatest(F.lit(1), F.least((height * 0.75).cast("int"), height - 2)).cast("double")
    return F.array(F.array(F.lit(0.0), y), F.array((width - 1).cast("double"), y))


def crop_size(box: Column, kind: str) -> Column:
    """struct x, y, w, h. A rectangle leaves out its last row and column, a polygon's bounding box holds them."""
    if kind not in ("rectangle", "polygon"):
        raise ValueError(f"unknown crop: {kind}")
    more = 1 if kind == "polygon" else 0
    return F.struct(box["x0"].alias("x"), box["y0"].alias("y"), (box["x1"] - box["x0"] + more).alias("w"), (box["y1"] - box["y0"] + more).alias("h"))


def closed_polygon(points: Column) -> Column:
    """Blank-separated coordinates with the first pair repeated at the end where it differs; strings of
    fewer than four or an odd number of coordinates stay as they are."""
    xs = F.split(F.trim(points), r"\s+")
    same = (F.element_at(xs, -2) == xs[0]) & (F.element_at(xs, -1) == xs[1])
    # as the unchanged string where nothing is appended
    return F.when((F.size(xs) < 4) | (F.size(xs) % 2 == 1) | same, points).otherwise(F.concat_ws(" ", xs, F.slice(xs, 1, 2)))


def centre_box(x: Column, y: Column, w: Column, h: Column, page_w: Column, page_h: Column) -> Column:
    """struct cx, cy, w, h as shares of the page; a missing page size counts as 1."""
    pw, ph = F.coalesce(page_w, F.lit(1.0)), F.coalesce(page_h, F.lit(1.0))
    return F.struct(((x + w / 2) / pw).alias("cx"), ((y + h / 2) / ph).alias("cy"), (w / pw).alias("w"), (h / ph).alias("h"))


def zone_label(box: Column, kind: int = 4) -> Column:
    return F.format_string(f"{kind} %.6f %.6f %.6f %.6f", box["cx"], box["cy"], box["w"], box["h"])


def corner_box(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(x.alias("x1"), y.alias("y1"), (x + w).alias("x2"), (y + h).alias("y2"))


def overlap(a: Column, b: Column) -> Column:
    """Area that two boxes (x1, y1, x2, y2) share."""
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def iou(a: Column, b: Column) -> Column:
    both = overlap(a, b)
    either = (a["x2"] - a["x1"]) * (a["y2"] - a["y1"]) + (b["x2"] - b["x1"]) * (b["y2"] - b["y1"]) - both
    return F.when(either > 0, both / either).otherwise(F.lit(0.0))


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0 where there is nothing."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def fitted_size(w: Column, h: Column, target: int = 224) -> Column:
    """struct w, h, left, top, right, bottom: the longer side becomes ``target``, the shorter follows (halves to even), and
    padding centres it in a square, with an odd pixel at the right or bottom."""
    short_h = F.greatest(F.lit(1), F.bround(h * target / w, 0).cast("int"))
    short_w = F.greatest(F.lit(1), F.bround(w * target / h, 0).cast("int"))
    nw, nh = F.when(w > h, F.lit(target)).otherwise(short_w), F.when(w > h, short_h).otherwise(F.lit(target))
    left, top = F.floor((target - nw) / 2).cast("int"), F.floor((target - nh) / 2).cast("int")
    return F.struct(nw.alias("w"), nh.alias("h"), left.alias("left"), top.alias("top"), (target - nw - left).alias("right"), (target - nh - top).alias("bottom"))
