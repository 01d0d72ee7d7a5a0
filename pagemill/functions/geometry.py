"""Boxes as arrays of doubles: flat [x0, y0, x1, y1], flat quadrilaterals, or lists of points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
VERTICAL_RATIO = 1.8
PLAIN_SCALE, GLOSS_SCALE, MOST_PIXELS, LONGEST_SIDE = 2.0, 4.2, 24_000_000, 8192


def box_union(coordinates: Column) -> Column:
    """Of a flat array x, y, x, y, ...; null coordinates of an empty array give an empty box."""
    even = F.filter(coordinates, lambda _, i: i % 2 == 0)
    odd = F.filter(coordinates, lambda _, i: i % 2 == 1)
    return F.when(F.size(coordinates) < 2, F.array().cast("array<double>")).otherwise(F.array(F.array_min(even), F.array_min(odd), F.array_max(even), F.array_max(odd)))


def polygon_bounds(points: Column) -> Column:
    return box_union(F.flatten(points))


def block_bounds(box: Column, polygon: Column) -> Column:
    """The box if it has four finite numbers, else the polygon's bounds, else empty."""
    whole = (F.size(box) == 4) & F.forall(box, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(whole, box).when(F.size(polygon) > 0, polygon_bounds(polygon)).otherwise(F.array().cast("array<double>"))


def overlap(a: Column, b: Column, axis: int) -> Column:
    return F.least(a[axis + 2], b[axis + 2]) - F.greatest(a[axis], b[axis])


def area_share(box: Column, width: Column, height: Column) -> Column:
    return (box[2] - box[0]) * (box[3] - box[1]) / (width * height)


def direction(box: Column) -> Column:
    tall = (F.size(box) == 4) & ((box[3] - box[1]) > (box[2] - box[0]) * VERTICAL_RATIO)
    return F.when(tall, "vertical").otherwise("horizontal")


def font_size(box: Column) -> Column:
    return F.when(F.size(box) == 4, F.least(box[2] - box[0], box[3] - box[1])).otherwise(F.lit(0.0))


def raster_scale(width: Column, height: Column, gloss: bool = False) -> Column:
    area, side = F.greatest(width * height, F.lit(1.0)), F.greatest(width, height, F.lit(1.0))
    return F.least(F.lit(GLOSS_SCALE if gloss else PLAIN_SCALE), F.sqrt(MOST_PIXELS / area), LONGEST_SIDE / side)
