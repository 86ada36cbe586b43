"""Page geometry as Column builders: boxes are structs x0, y0, x1, y1 in points from the top left."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def normalised(b: Column, width: Column, height: Column, rotation: Column | None = None, from_bottom: bool = False) -> Column:
    """Turned with the page, ordered, kept on the page and rounded to two decimals."""
    rot = F.lit(0) if rotation is None else rotation
    x0, x1 = b["x0"], b["x1"]
    y0, y1 = (height - b["y1"], height - b["y0"]) if from_bottom else (b["y0"], b["y1"])
    px = lambda x, y: F.when(rot == 90, height - y).when(rot == 180, width - x).when(rot == 270, y).otherwise(x)
    py = lambda x, y: F.when(rot == 90, x).when(rot == 180, height - y).when(rot == 270, width - x).otherwise(y)
    turned = rot.isin(90, 270)
    w, h = F.when(turned, height).otherwise(width), F.when(turned, width).otherwise(height)
    keep = lambda v, most: F.round(F.greatest(F.lit(0.0), F.least(most, v)), 2)
    ax, bx, ay, by = px(x0, y0), px(x1, y1), py(x0, y0), py(x1, y1)
    return box(keep(F.least(ax, bx), w), keep(F.least(ay, by), h), keep(F.greatest(ax, bx), w), keep(F.greatest(ay, by), h))


def scaled(b: Column, from_width: Column, from_height: Column, width: Column, height: Column) -> Column:
    """Pixels, or the 0..1000 and 0..1 grids of vision models, to points."""
    return box(b["x0"] * width / from_width, b["y0"] * height / from_height, b["x1"] * width / from_width, b["y1"] * height / from_height)


def coverage(areas: Column, page_area: Column) -> Column:
    return F.least(F.lit(1.0), F.aggregate(areas, F.lit(0.0), lambda a, x: a + x) / page_area)
