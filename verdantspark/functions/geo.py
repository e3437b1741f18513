"""Column expressions for coordinates: tiles, projections, centroids, circle membership."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: WGS84.
A, FLATTENING = 6378137.0, 1 / 298.257223563
N = FLATTENING / (2 - FLATTENING)
ECCENTRICITY = math.sqrt(FLATTENING * (2 - FLATTENING))


def web_mercator_tile(lng: Column, lat: Column, zoom: int = 14, clipped: bool = True) -> Column:
    """The XYZ tile of a point; latitudes of the poles have none. Points beyond the map are in its outermost tiles, or, if not
    clipped, in tiles of their own beyond it."""
    s = F.sin(F.radians(lat))
    x = F.floor((lng / 360 + 0.5) * 2**zoom)
    y = F.floor((F.lit(0.5) - 0.25 * F.ln((1 + s) / (1 - s)) / math.pi) * 2**zoom)
    clip = lambda c: F.least(F.greatest(c, F.lit(0)), F.lit(2**zoom - 1)).cast("int") if clipped else c
    return F.struct(clip(x).alias("x"), clip(y).alias("y"), F.lit(zoom).alias("z"))


def utm_zone(lng: Column) -> Column:
    return (F.floor((lng + 180) / 6) + 1).cast("int")


def utm_project(lng: Column, lat: Column, zone: Column) -> Column:
    """Easting and northing by Kruger's series of the third order; southern latitudes get the false northing."""
    phi, lam = F.radians(lat), F.radians(lng - (zone * 6 - 183))
    c = 2 * math.sqrt(N) / (1 + N)
    t = F.sinh(F.atanh(F.sin(phi)) - c * F.atanh(c * F.sin(phi)))
    xi, eta = F.atan(t / F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    alpha = (N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16, 13 * N**2 / 48 - 3 * N**3 / 5, 61 * N**3 / 240)
    radius = A / (1 + N) * (1 + N**2 / 4 + N**4 / 64)
    e = eta + sum(a * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, a in enumerate(alpha, 1))
    n = xi + sum(a * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, a in enumerate(alpha, 1))
    return F.struct((500000 + 0.9996 * radius * e).alias("x"), (F.when(lat < 0, 1e7).otherwise(0.0) + 0.9996 * radius * n).alias("y"))


def world_mercator(lng: Column, lat: Column) -> Column:
    """Ellipsoidal Mercator in metres (EPSG 3395)."""
    phi = F.radians(lat)
    es = ECCENTRICITY * F.sin(phi)
    y = A * F.ln(F.tan(math.pi / 4 + phi / 2) * F.pow((1 - es) / (1 + es), ECCENTRICITY / 2))
    return F.struct((A * F.radians(lng)).alias("x"), y.alias("y"))


def polygon_area2(ring: Column) -> Column:
    """Twice the signed area of a ring of points (closed or not)."""
    return _sum(ring, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])


def polygon_centroid(ring: Column) -> Column:
    """The centroid of a ring by the shoelace formula; null if it has no area."""
    cross = lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]
    area = polygon_area2(ring)
    of = lambda axis: F.try_divide(_sum(ring, lambda p, q: (p[axis] + q[axis]) * cross(p, q)), 3 * area)
    return F.struct(of("x").alias("x"), of("y").alias("y"))


def _sum(ring: Column, term) -> Column:
    turned = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.aggregate(F.zip_with(ring, turned, term), F.lit(0.0), lambda a, x: a + x)


def in_buffer(dx: Column, dy: Column, radius: float, sides: int = 64) -> Column:
    """Whether an offset lies in the regular polygon, with a corner at angle 0, that stands for a circle."""
    sector = 2 * math.pi / sides
    angle = F.atan2(dy, dx)
    turned = F.abs(angle - sector * (F.floor(angle / sector) + 0.5))
    return F.sqrt(dx * dx + dy * dy) * F.cos(turned) <= radius * math.cos(sector / 2)


def buffer_ring(x: Column, y: Column, radius: float, sides: int = 64) -> Column:
    """That polygon's corners."""
    return F.array(*[F.struct((x + radius * math.cos(2 * math.pi * i / sides)).alias("x"), (y + radius * math.sin(2 * math.pi * i / sides)).alias("y")) for i in range(sides)])


def speed_to_buffer(minutes: Column, km_per_hour: Column) -> Column:
    """Metres walked a minute, and the radius that surely holds a trip of that time."""
    pace = km_per_hour * 1000 / 60
    return F.struct(pace.alias("metres_per_minute"), (minutes * pace * 1.25).alias("buffer"))
