"""Geometry on the sphere and on local planes, as column expressions that stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberglass.constants import EARTH_KM


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing, 0 to 360."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    y = F.sin(d) * F.cos(b)
    x = F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)) + F.lit(360.0), F.lit(360.0))


def circular_error(a: Column, b: Column) -> Column:
    """Degrees between two bearings, 0 to 180."""
    return F.abs(F.pmod(a - b + F.lit(180.0), F.lit(360.0)) - F.lit(180.0))


def compass(bearing: Column) -> Column:
    names = ["N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW"]
    return F.element_at(F.array(*[F.lit(n) for n in names]), (F.floor(bearing / 22.5 + 0.5) % 16 + 1).cast("int"))


def metres_per_degree(lat: Column) -> tuple[Column, Column]:
    """(of latitude, of longitude) by the series in the latitude."""
    p = F.radians(lat)
    of_lat = 111132.92 - 559.82 * F.cos(2 * p) + 1.175 * F.cos(4 * p) - 0.0023 * F.cos(6 * p)
    of_lon = 111412.84 * F.cos(p) - 93.5 * F.cos(3 * p) + 0.118 * F.cos(5 * p)
    return of_lat, of_lon


def point_segment_m(lat: Column, lon: Column, lat1: Column, lon1: Column, lat2: Column, lon2: Column, scale: tuple[Column, Column] | None = None) -> Column:
    """Metres from a point to a segment on the plane at the point; a segment of no length is its vertex.

    scale: metres_per_degree(lat), where that is at hand as columns, so that it isn't computed for every pair.
    """
    of_lat, of_lon = scale or metres_per_degree(lat)
    px, py, dx, dy = (lon - lon1) * of_lon, (lat - lat1) * of_lat, (lon2 - lon1) * of_lon, (lat2 - lat1) * of_lat
    t = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(px * dx + py * dy, dx * dx + dy * dy))), F.lit(0.0))
    return F.hypot(px - t * dx, py - t * dy)


def _pairs(ring: Column, f) -> Column:
    """Of an array of points, f(point, next point) for all but the last."""
    return F.transform(F.sequence(F.lit(1), F.size(ring) - 1), lambda i: f(F.element_at(ring, i), F.element_at(ring, i + 1)))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def ring_is_closed(ring: Column) -> Column:
    first, last = F.element_at(ring, 1), F.element_at(ring, -1)
    return F.when(F.size(ring) >= 4, (first["lat"] == last["lat"]) & (first["lon"] == last["lon"])).otherwise(False)


def ring_centroid(ring: Column) -> tuple[Column, Column]:
    """Mean (lat, lon) of the open vertices."""
    open_ = F.slice(ring, F.lit(1), F.size(ring) - 1)
    n = F.size(open_)
    return total(F.transform(open_, lambda p: p["lat"])) / n, total(F.transform(open_, lambda p: p["lon"])) / n


def ring_area_km2(ring: Column) -> Column:
    """Spherical area."""
    s = _pairs(ring, lambda p, q: F.radians(q["lon"] - p["lon"]) * (2 + F.sin(F.radians(p["lat"])) + F.sin(F.radians(q["lat"]))))
    return F.abs(total(s)) * (EARTH_KM * EARTH_KM / 2)


def ring_area_flat_km2(ring: Column) -> Column:
    """Area on the plane at the centroid."""
    lat, _ = ring_centroid(ring)
    kx, ky = F.cos(F.radians(lat)) * 111.32, F.lit(110.574)
    s = _pairs(ring, lambda p, q: p["lon"] * kx * q["lat"] * ky - q["lon"] * kx * p["lat"] * ky)
    return F.abs(total(s)) / 2


def in_ring(lat: Column, lon: Column, ring: Column) -> Column:
    """Ray casting with half-open edges."""
    hit = _pairs(ring, lambda p, q: F.when(((p["lat"] > lat) != (q["lat"] > lat)) & (lon < (q["lon"] - p["lon"]) * (lat - p["lat"]) / F.nullif(q["lat"] - p["lat"], F.lit(0.0)) + p["lon"]), 1).otherwise(0))
    return F.aggregate(hit, F.lit(0), lambda s, x: s + x) % 2 == 1


def utm30_forward(lat: Column, lon: Column) -> tuple[Column, Column]:
    """(easting, northing) on WGS84, zone 30 north (Snyder's series)."""
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    e2 = f * (2 - f)
    ep2 = e2 / (1 - e2)
    p = F.radians(lat)
    n = F.lit(a) / F.sqrt(1 - e2 * F.pow(F.sin(p), 2))
    t, c = F.pow(F.tan(p), 2), ep2 * F.pow(F.cos(p), 2)
    big = F.cos(p) * F.radians(lon + 3.0)
    m = a * ((1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * p - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * F.sin(2 * p) + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * F.sin(4 * p) - (35 * e2**3 / 3072) * F.sin(6 * p))
    east = 500000.0 + k0 * n * (big + (1 - t + c) * F.pow(big, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep2) * F.pow(big, 5) / 120)
    north = k0 * (m + n * F.tan(p) * (big * big / 2 + (5 - t + 9 * c + 4 * c * c) * F.pow(big, 4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep2) * F.pow(big, 6) / 720))
    return east, north


def grid_cell(lat: Column, lon: Column, lon0: float, lat0: float, cell: float) -> tuple[Column, Column]:
    """(row, col) of a grid whose row 0 is north and whose north-west corner is (lat0, lon0)."""
    return F.floor((F.lit(lat0) - lat) / cell + 1e-9).cast("int"), F.floor((lon - F.lit(lon0)) / cell + 1e-9).cast("int")


def utm30_inverse(east: Column, north: Column) -> tuple[Column, Column]:
    """(lat, lon) of a place in zone 30 north (Snyder's series)."""
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    e2 = f * (2 - f)
    ep2, e1 = e2 / (1 - e2), (1 - (1 - e2) ** 0.5) / (1 + (1 - e2) ** 0.5)
    mu = north / (k0 * a * (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256))
    p = mu + (3 * e1 / 2 - 27 * e1**3 / 32) * F.sin(2 * mu) + (21 * e1**2 / 16 - 55 * e1**4 / 32) * F.sin(4 * mu) + (151 * e1**3 / 96) * F.sin(6 * mu) + (1097 * e1**4 / 512) * F.sin(8 * mu)
    c, t, w = ep2 * F.pow(F.cos(p), 2), F.pow(F.tan(p), 2), 1 - e2 * F.pow(F.sin(p), 2)
    n, r = F.lit(a) / F.sqrt(w), F.lit(a * (1 - e2)) / F.pow(w, 1.5)
    d = (east - 500000.0) / (n * k0)
    lat = p - (n * F.tan(p) / r) * (d * d / 2 - (5 + 3 * t + 10 * c - 4 * c * c - 9 * ep2) * F.pow(d, 4) / 24 + (61 + 90 * t + 298 * c + 45 * t * t - 252 * ep2 - 3 * c * c) * F.pow(d, 6) / 720)
    lon = (d - (1 + 2 * t + c) * F.pow(d, 3) / 6 + (5 - 2 * c + 28 * t - 3 * c * c + 8 * ep2 + 24 * t * t) * F.pow(d, 5) / 120) / F.cos(p)
    return F.degrees(lat), F.degrees(lon) - 3.0


def drift_bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Bearing to a tenth of a degree, below 360; null where both places are one."""
    r = F.round(bearing_deg(lat1, lon1, lat2, lon2), 1)
    return F.when((lat1 != lat2) | (lon1 != lon2), F.when(r >= 360, 0.0).otherwise(r))


def signed_area_m2(ring: Column) -> Column:
    """Area on the plane at the first vertex, above 0 where the ring runs counter-clockwise. Measured from that vertex, so
    that small rings lose no digits to their distance from the origin."""
    at = F.element_at(ring, 1)
    of_lat, of_lon = metres_per_degree(at["lat"])
    x, y = lambda p: (p["lon"] - at["lon"]) * of_lon, lambda p: (p["lat"] - at["lat"]) * of_lat
    return total(_pairs(ring, lambda p, q: x(p) * y(q) - x(q) * y(p))) / 2


def line_length_m(line: Column) -> Column:
    """Metres along a line on the plane at its first vertex."""
    of_lat, of_lon = metres_per_degree(F.element_at(line, 1)["lat"])
    return F.when(F.size(line) < 2, 0.0).otherwise(total(_pairs(line, lambda p, q: F.hypot((q["lon"] - p["lon"]) * of_lon, (q["lat"] - p["lat"]) * of_lat))))


def point_line_m(lat: Column, lon: Column, line: Column) -> Column:
    """Metres to the nearest part of a line; null for an empty one."""
    one = F.element_at(line, 1)
    return F.when(F.size(line) == 1, point_segment_m(lat, lon, one["lat"], one["lon"], one["lat"], one["lon"])).when(F.size(line) > 1, F.array_min(_pairs(line, lambda p, q: point_segment_m(lat, lon, p["lat"], p["lon"], q["lat"], q["lon"]))))


def padded_box(south: Column, west: Column, north: Column, east: Column, metres: float) -> Column:
    of_lat, of_lon = metres_per_degree((south + north) / 2)
    return F.struct((south - metres / of_lat).alias("south"), (west - metres / of_lon).alias("west"), (north + metres / of_lat).alias("north"), (east + metres / of_lon).alias("east"))


def slope_aspect(dz_east: Column, dz_south: Column) -> tuple[Column, Column]:
    """(slope, aspect) in degrees from the rises per metre towards east and, as rows run, south; the aspect looks down."""
    return F.degrees(F.atan(F.hypot(dz_east, dz_south))), F.pmod(F.degrees(F.atan2(-dz_east, dz_south)) + 360.0, F.lit(360.0))


def frp_scale(frp: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), frp / 150))


def confidence_label(confidence: Column) -> Column:
    return F.when(confidence >= 0.8, "HIGH").when(confidence >= 0.5, "NOMINAL").when(confidence.isNotNull(), "LOW")


# Fixed values of the geostationary grid: metres above the surface, semi-axes, cells a side, metres a cell, begin.
GEOS_H, GEOS_A, GEOS_B, GEOS_CELLS, GEOS_CELL_M = 35786400.0, 6378137.0, 6356752.31414, 11136, 1000.0
# Fixed values, end.


def geos_forward(lat: Column, lon: Column) -> tuple[Column, Column]:
    """(x, y) in metres of the view from above longitude 0, east-west turned within north-south; null where the surface
    faces away."""
    b2 = (GEOS_B / GEOS_A) ** 2
    p = F.atan(b2 * F.tan(F.radians(lat)))  # the angle at the centre
    r = GEOS_B / F.sqrt(1 - (1 - b2) * F.pow(F.cos(p), 2))
    px, py, pz = r * F.cos(p) * F.cos(F.radians(lon)), r * F.cos(p) * F.sin(F.radians(lon)), r * F.sin(p)
    ahead = (GEOS_H + GEOS_A) - px
    seen = ahead * px - py * py - pz * pz / b2 >= 0
    return F.when(seen, GEOS_H * F.atan(py / ahead)), F.when(seen, GEOS_H * F.atan(pz / F.hypot(ahead, py)))


def geos_inverse(x: Column, y: Column) -> tuple[Column, Column]:
    """(lat, lon) at which the ray through (x, y) first meets the ellipsoid; null off the disc."""
    far, b2 = (GEOS_H + GEOS_A) / GEOS_A, (GEOS_B / GEOS_A) ** 2
    # the ray is (far - t, t * east, t * north), in semi-axes; its least t with X^2 + Y^2 + Z^2 / b2 = 1
    east = F.tan(x / GEOS_H)
    north = F.tan(y / GEOS_H) * F.sqrt(1 + east * east)
    a = 1 + east * east + north * north / b2
    under = far * far - a * (far * far - 1)
    t = (far - F.sqrt(F.when(under >= 0, under))) / a
    px, py, pz = far - t, t * east, t * north
    return F.degrees(F.atan(pz / (b2 * F.hypot(px, py)))), F.degrees(F.atan2(py, px))


def geos_cell(row: Column, col: Column) -> tuple[Column, Column]:
    """(lat, lon) of a cell's centre, rows from the north; null off the disc."""
    middle = (GEOS_CELLS - 1) / 2
    return geos_inverse((col - middle) * GEOS_CELL_M, (middle - row) * GEOS_CELL_M)
