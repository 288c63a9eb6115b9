"""Box geometry as column expressions, and the grids that keep box joins local.

A box is a tuple of four columns ``(x, y, w, h)``. Joining boxes on the frame key alone
compares every pair of a frame, which a crowded frame cannot afford. A grid adds a spatial
join key: one side sits in the single cell of its centre, the other side is copied to each
cell where a partner's centre may lie. Each pair meets exactly once.

The grid is a hierarchy: a box belongs to the level of its longer side, and cells are as large
as the boxes of their level. Boxes of any unit, normalised or in pixels of a stitched panorama,
share one table, and no coordinate is clamped. An overlap bounds the levels of partners.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]

#: Longer sides of one level differ by this factor at most; its cells are as large as its largest box.
LEVEL_BASE = 16
#: Cell numbers stop here. Beyond it, doubles are so coarse that no box there has an extent.
LAST_CELL = float(1 << 62)
#: Level of boxes that are single points.
POINT_LEVEL = -6
CELL = ("level", "across", "down")


def box_of(prefix: str = "") -> Box:
    """The columns ``{prefix}x, {prefix}y, {prefix}w, {prefix}h``."""
    x, y, w, h = (F.col(prefix + c) for c in "xywh")
    return x, y, w, h


def iou(a: Box, b: Box) -> Column:
    """Intersection over union, 0 when the boxes are disjoint or both are empty."""
    ax, ay, aw, ah = a
    bx, by, bw, bh = b
    iw = F.greatest(F.least(ax + aw, bx + bw) - F.greatest(ax, bx), F.lit(0.0))
    ih = F.greatest(F.least(ay + ah, by + bh) - F.greatest(ay, by), F.lit(0.0))
    inter = iw * ih
    union = aw * ah + bw * bh - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def centre(b: Box) -> tuple[Column, Column]:
    x, y, w, h = b
    return x + w / 2, y + h / 2


def centre_distance(a: Box, b: Box) -> Column:
    (ax, ay), (bx, by) = centre(a), centre(b)
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def contains_centre(outer: Box, inner: Box) -> Column:
    """True when the centre of ``inner`` lies in ``outer`` (borders included)."""
    x, y, w, h = outer
    cx, cy = centre(inner)
    return (cx >= x) & (cx <= x + w) & (cy >= y) & (cy <= y + h)


def _axis_cell(value: Column, side: Column) -> Column:
    inside = F.least(F.greatest(F.floor(value / side).cast("double"), F.lit(-LAST_CELL)), F.lit(LAST_CELL))
    return inside.cast("bigint")


def _level(side: Column) -> Column:
    """Level of a box whose longer side is ``side``; NULL for one that can overlap nothing."""
    sized = (side > 0) & (side < float("inf"))
    return F.when(sized, F.floor(F.log2(side) / math.log2(LEVEL_BASE)).cast("int"))


def _cell_side(level: Column, scale: float) -> Column:
    return F.pow(F.lit(float(LEVEL_BASE)), level + 1) * scale


def _longer(b: Box) -> Column:
    return F.greatest(b[2].cast("double"), b[3].cast("double"))


def in_own_cell(df: DataFrame, prefix: str = "", scale: float = 1.0) -> DataFrame:
    """Adds the cell of each box ``{prefix}x, ...``: ``{prefix}level, {prefix}across, {prefix}down``."""
    level = F.col(f"{prefix}level")
    cx, cy = centre(box_of(prefix))
    return df.withColumn(f"{prefix}level", _level(_longer(box_of(prefix)))).withColumns(
        {f"{prefix}across": _axis_cell(cx, _cell_side(level, scale)), f"{prefix}down": _axis_cell(cy, _cell_side(level, scale))}
    )


def _copied(df: DataFrame, prefix: str, reach_x: Column, reach_y: Column, scale: float) -> DataFrame:
    """A copy per cell of ``{prefix}level`` that lies within reach of the centre."""
    cx, cy = centre(box_of(prefix))
    side = _cell_side(F.col(f"{prefix}level"), scale)
    # a hair wider than the bound, so that rounding never loses a partner
    rx = reach_x * (1 + 1e-9) + F.least(F.abs(cx) * 1e-12, side)
    ry = reach_y * (1 + 1e-9) + F.least(F.abs(cy) * 1e-12, side)
    # plain explodes stay in generated code, unlike one over nested lambdas
    across = F.explode(F.sequence(_axis_cell(cx - rx, side), _axis_cell(cx + rx, side))).alias(f"{prefix}across")
    down = F.explode(F.sequence(_axis_cell(cy - ry, side), _axis_cell(cy + ry, side))).alias(f"{prefix}down")
    return df.select("*", across).select("*", down)


def with_level(df: DataFrame, prefix: str = "") -> DataFrame:
    """Adds ``{prefix}level`` to boxes that can hold a point, and drops the others."""
    longer = _longer(box_of(prefix))
    level = F.coalesce(_level(longer), F.lit(POINT_LEVEL)).alias(f"{prefix}level")
    return df.filter((longer >= 0) & (longer < float("inf"))).select("*", level)


def in_covered_cells(df: DataFrame, prefix: str = "", scale: float = 1.0) -> DataFrame:
    """Copies of boxes to the cells of their own level that they touch; those without a finite side >= 0 touch none."""
    sized = with_level(df, prefix)
    return _copied(sized, prefix, F.col(f"{prefix}w") / 2, F.col(f"{prefix}h") / 2, scale)


def in_level_cell(df: DataFrame, prefix: str = "", scale: float = 1.0) -> DataFrame:
    """The cell of each centre at the level given in ``{prefix}level``."""
    cx, cy = centre(box_of(prefix))
    side = _cell_side(F.col(f"{prefix}level"), scale)
    return df.withColumns({f"{prefix}across": _axis_cell(cx, side), f"{prefix}down": _axis_cell(cy, side)})


def in_partner_cells(df: DataFrame, min_iou: float, prefix: str = "", scale: float = 1.0) -> DataFrame:
    """Copies of boxes to every cell that can hold the centre of a partner with IoU >= ``min_iou``.

    Such a partner's area is at least ``min_iou`` times the box's own and its sides at most 1 / ``min_iou`` times, so
    few levels come into question. How far off its centre can be follows from the largest box of its level.
    Boxes without an area have no partners.
    """
    t = _checked(min_iou)
    w, h = (F.col(f"{prefix}{c}").cast("double") for c in "wh")
    low = _level(F.sqrt(w * h * (t * (1 - 1e-9))))
    high = _level(F.greatest(w, h) * ((1 + 1e-9) / t))
    levelled = df.filter((w > 0) & (h > 0)).select("*", F.explode(F.sequence(low, F.coalesce(high, low))).alias(f"{prefix}level"))
    largest = _cell_side(F.col(f"{prefix}level"), 1 + 1e-9)
    return _copied(levelled, prefix, _reach(w, largest, t), _reach(h, largest, t), scale)


def _reach(side: Column, largest: Column, t: float) -> Column:
    """How far apart centres can be on one axis: half of both sides less the least overlap, t times the longer one."""
    other = F.least(largest, side / t if t < 0.5 else side)
    return other / 2 + side / 2 - F.greatest(other, side) * t


def in_square_cell(df: DataFrame, side: float, prefix: str = "") -> DataFrame:
    """The cell of each centre in a plain grid, for neighbours within a fixed distance."""
    cx, cy = centre(box_of(prefix))
    return df.withColumns(
        {f"{prefix}level": F.lit(0), f"{prefix}across": _axis_cell(cx, F.lit(side)), f"{prefix}down": _axis_cell(cy, F.lit(side))}
    )


def in_near_cells(df: DataFrame, distance: float, side: float, prefix: str = "") -> DataFrame:
    """Copies of boxes to the cells of a plain grid within ``distance`` of their centre."""
    cx, cy = centre(box_of(prefix))
    r = distance * (1 + 1e-9)
    rx, ry = r + F.abs(cx) * 1e-12, r + F.abs(cy) * 1e-12
    across = F.explode(F.sequence(_axis_cell(cx - rx, F.lit(side)), _axis_cell(cx + rx, F.lit(side)))).alias(f"{prefix}across")
    down = F.explode(F.sequence(_axis_cell(cy - ry, F.lit(side)), _axis_cell(cy + ry, F.lit(side)))).alias(f"{prefix}down")
    return df.select("*", F.lit(0).alias(f"{prefix}level")).select("*", across).select("*", down)


def same_cell(a: str, b: str) -> Column:
    match = F.lit(True)
    for c in CELL:
        match = match & (F.col(a + c) == F.col(b + c))
    return match


def _checked(min_iou: float) -> float:
    if not 0 < min_iou <= 1:
        raise ValueError("min_iou must lie in (0, 1]")
    return float(min_iou)


def iou_reach(min_iou: float) -> float:
    """How far, in widths of box b, the centre of a box a with IoU(a, b) >= t can lie.

    IoU >= t needs an overlap of at least t * max(widths) on each axis and a width ratio
    r in [t, 1/t]; the largest possible offset over r is the value below.
    """
    t = _checked(min_iou)
    return max(1 - t, (1 / t - 1) / 2)
