"""Column expressions over class masks: arrays of rows of class numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ROAD, VEGETATION = 0, 8
#: Class number, red, green, blue of the 19 street-scene classes.
PALETTE = (
    (0, 128, 64, 128),
    (1, 244, 35, 232),
    (2, 70, 70, 70),
    (3, 102, 102, 156),
    (4, 190, 153, 153),
    (5, 153, 153, 153),
    (6, 250, 170, 30),
    (7, 220, 220, 0),
    (8, 0, 255, 0),
    (9, 152, 251, 152),
    (10, 70, 130, 180),
    (11, 220, 20, 60),
    (12, 255, 0, 0),
    (13, 0, 0, 142),
    (14, 0, 0, 70),
    (15, 0, 60, 100),
    (16, 0, 80, 100),
    (17, 0, 0, 230),
    (18, 119, 11, 32),
)


def rows_of(flat: Column, width: int) -> Column:
    """A flat array as rows of `width`."""
    return F.transform(F.sequence(F.lit(0), (F.size(flat) / width).cast("int") - 1), lambda i: F.slice(flat, i * width + 1, F.lit(width)))


def height(mask: Column) -> Column:
    return F.size(mask)


def width(mask: Column) -> Column:
    return F.coalesce(F.size(F.try_element_at(mask, F.lit(1))), F.lit(0))


def bottom_band_crop(mask: Column, share: float = 0.2) -> Column:
    """Without the last rows, where a panorama shows the vehicle."""
    return F.slice(mask, F.lit(1), height(mask) - F.floor(height(mask) * share).cast("int"))


def wrap_widen(mask: Column, share: float = 0.25) -> Column:
    """With the first columns again on the right, as a panorama goes round."""
    n = F.floor(width(mask) * share).cast("int")
    return F.transform(mask, lambda r: F.concat(r, F.slice(r, F.lit(1), n)))


def window(mask: Column, top: Column, rows: Column, left: Column, columns: Column) -> Column:
    """A rectangle of a mask, cut off at its edges; numbers count from 0."""
    return F.transform(F.slice(mask, top + 1, rows), lambda r: F.slice(r, left + 1, columns))


def quad_crop(mask: Column) -> Column:
    """Four windows side by side, a quarter of the width each and three quarters of that high, from a quarter down."""
    w4, h4 = F.floor(width(mask) / 4).cast("int"), F.floor(height(mask) / 4).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: window(mask, h4, F.floor(w4 * 0.75).cast("int"), k * w4, w4))


def road_centre_crop(mask: Column, centre: Column) -> Column:
    """The window around a road centre, a quarter of the mask wide.

    Near the right or left edge of the full picture, it is two pieces, one from the other edge.
    """
    w, w4, h4 = width(mask), F.floor(width(mask) / 4).cast("int"), F.floor(height(mask) / 4).cast("int")
    rows = F.floor(w4 * 0.75).cast("int")
    piece = lambda left, n: window(mask, h4, rows, F.greatest(left, F.lit(0)), F.greatest(n, F.lit(0)))
    joined = lambda a, b: F.zip_with(a, b, lambda x, y: F.concat(x, y))
    begin = F.floor(centre - w4 / 2).cast("int")
    over = F.floor(w4 / 2 - centre).cast("int")
    right = joined(piece(begin, w - begin), piece(F.lit(0), w4 - (w - begin)))
    left = joined(piece(w - over, over), piece(F.lit(0), w4 - over))
    return F.when(centre > F.floor(w * 7 / 8), right).when(centre < w4 / 2, left).otherwise(piece(begin, w4))


def without_duplicates(centres: Column, full_width: Column) -> Column:
    """Road centres without those that the widened part shows again."""
    again = F.transform(F.filter(centres, lambda c: c >= full_width), lambda c: c - full_width)
    return F.filter(centres, lambda c: ~F.array_contains(again, c))


def count_of(mask: Column, cls: int) -> Column:
    return F.aggregate(mask, F.lit(0).cast("long"), lambda a, r: a + F.size(F.filter(r, lambda x: x == cls)))


def pixels(mask: Column) -> Column:
    return F.aggregate(mask, F.lit(0).cast("long"), lambda a, r: a + F.size(r))


def gvi_pixel_ratio(crops: Column) -> Column:
    """Vegetation pixels of all crops over their pixels; 0 without pixels."""
    veg = F.aggregate(crops, F.lit(0).cast("long"), lambda a, m: a + count_of(m, VEGETATION))
    total = F.aggregate(crops, F.lit(0).cast("long"), lambda a, m: a + pixels(m))
    return F.when(total == 0, 0.0).otherwise(veg / total)


def max_run_length(values: Column, cls: int = ROAD) -> Column:
    """The longest run of a class; 0 if there is none."""
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"))
    step = lambda a, x: F.when(x == cls, F.struct((a["now"] + 1).alias("now"), F.greatest(a["best"], a["now"] + 1).alias("best"))).otherwise(F.struct(F.lit(0).alias("now"), a["best"].alias("best")))
    return F.aggregate(values, start, step, lambda a: a["best"])


def columns_of(mask: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), width(mask)), lambda j: F.transform(mask, lambda r: F.element_at(r, j)))


def run_length_encode(values: Column) -> Column:
    """Runs (value, begin, length) of an array."""
    borders = F.filter(F.sequence(F.lit(1), F.size(values)), lambda i: (i == 1) | ~F.element_at(values, i).eqNullSafe(F.element_at(values, F.greatest(i - 1, F.lit(1)))))
    ends = F.concat(F.slice(borders, 2, F.greatest(F.size(borders) - 1, F.lit(0))), F.array(F.size(values) + 1))
    found = F.zip_with(borders, ends, lambda a, b: F.struct(F.element_at(values, a).alias("value"), (a - 1).alias("begin"), (b - a).alias("length")))
    return F.when(F.size(values) > 0, found).otherwise(F.slice(found, 1, 0))
