"""Column expressions for texts and small arithmetic: addresses, labels, percentages, greenness of bands, travel time."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


def tile_url(template: str, tile: Column) -> Column:
    """The address of a tile (x, y, z) by a template with {z}, {x} and {y}."""
    out: Column = F.lit(template)
    for name in "zxy":
        out = F.replace(out, F.lit(f"{{{name}}}"), tile[name].cast("string"))
    return out


def rounded(value: Column, digits: int) -> Column:
    """value rounded as the SQL's engine does it: the double that is 10 to the digits times as large, to the nearest whole number,
    halves away from zero. F.round instead takes the shortest decimal that stands for value, so that 0.285 becomes 0.29, not 0.28."""
    v = value.cast("double")
    out = F.signum(v) * F.round(F.abs(v) * 10.0**digits, 0) / 10.0**digits
    return F.when(F.abs(v) * 10.0**digits < float("inf"), out).otherwise(v)


def number_text(value: Column) -> Column:
    """A double as text, as the SQL's engine writes it: without an exponent below 1e16."""
    # long: the digits of a double of 1e7 or more, which Spark writes with an exponent
    long = F.regexp_replace(value.try_cast("decimal(38, 17)").cast("string"), r"(\.\d+?)0+$", "$1")
    huge = F.regexp_replace(F.regexp_replace(value.cast("string"), r"(\.0)?E", "e"), "e(\\d)", "e+$1")
    size = F.abs(value)
    return F.when(F.isnan(value), "nan").when(size == float("inf"), F.when(value > 0, "inf").otherwise("-inf")).when(size >= 1e16, huge).when(size >= 1e7, long).otherwise(value.cast("string"))


def percentage_text(value: Column, digits: int = 2) -> Column:
    """A share in percent as text; null for none."""
    return F.concat(number_text(rounded(value, digits)), F.lit("%"))


def marker_label(id_: Column, gvi: Column) -> Column:
    """What a map shows at a point."""
    return F.concat(F.lit("ID: "), id_.cast("string"), F.lit(" / GVI: "), F.coalesce(number_text(rounded(gvi, 2)), F.lit("none")))


def latitude_first(x: Column, y: Column) -> Column:
    """A point in the order that maps expect."""
    return F.struct(y.alias("lat"), x.alias("lng"))


def elapsed(seconds: float) -> str:
    """A running time as text."""
    return str(timedelta(seconds=seconds))


def travel_minutes(length: Column, km_per_hour: Column) -> Column:
    """Minutes that an edge of so many metres takes."""
    return F.try_divide(length, km_per_hour * 1000 / 60)


def ndvi(near_infrared: Column, red: Column) -> Column:
    """The vegetation index of two bands; null where both are 0."""
    return F.try_divide(near_infrared - red, near_infrared + red)


def ndvi_clamp(value: Column) -> Column:
    """Negative values as 0; null stays."""
    return F.when(value.isNotNull(), F.greatest(value, F.lit(0.0)))
