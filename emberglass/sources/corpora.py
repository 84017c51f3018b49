"""States of fires over time from exported corpora, and hotspot tables of an older form."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberglass.functions.geo import bearing_deg, haversine_km
from emberglass.operators.ranks import running
from emberglass.storage import Scratch

#: States that a fire must have, and hours beyond which two states say nothing of the motion between them.
LEAST_STATES, MOST_GAP_H = 3, 168.0
#: Fixed values of the projection EPSG:3035: latitude and longitude of its origin, its false origin, its ellipsoid.
LAEA_LAT, LAEA_LON, LAEA_X, LAEA_Y, GRS80_A, GRS80_F = 52.0, 10.0, 4321000.0, 3210000.0, 6378137.0, 1 / 298.257222101


def legacy_hotspots(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, one row: dropped) of hotspot tables as CSV, packed or not: at_s, lat and lon as corrected for parallax,
    pixel_km2 (an area), and all other columns as text. Rows whose observed_at_utc is no time are dropped, and counted."""
    raw = spark.read.option("header", True).csv(path)
    text = F.trim("observed_at_utc")
    zoned = F.when(text.rlike("([zZ]|[-+]\\d\\d:?\\d\\d)$"), text).otherwise(F.concat(text, F.lit("Z")))  # a time without a zone is UTC
    at = F.floor(F.unix_micros(F.try_to_timestamp(zoned)) / 1000000)
    number = lambda c: F.col(c).try_cast("double")
    rows = raw.withColumns({"at_s": at.cast("long"), "lat": number("LATITUDE_PARALLAX"), "lon": number("LONGITUDE_PARALLAX"), "pixel_km2": number("PIXEL_SIZE")})
    return rows.filter("at_s is not null"), rows.agg(F.count_if(F.col("at_s").isNull()).alias("dropped"))


def _enough(rows: DataFrame) -> DataFrame:
    fires = rows.groupBy("fire").agg(F.count("*").alias("_n"), F.min("_when").alias("_start")).filter(F.col("_n") >= LEAST_STATES)
    return rows.join(fires.drop("_n"), "fire")


def progression(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """States (fire, t, area, bearing, rate) from behaviour rows (fname, type, enddoy, area, spdir_p, ros_p): progressions
    (type p) with a day and an area, of fires that have LEAST_STATES of them. t is hours from the fire's first, area the sum
    up to then in hectares, the bearing null unless 0 to 360, the rate in km/h, null unless above 0 (m/h in the rows).

    Sums run along ranges of days, so a fire of any size is spread; of rows at one time any may come first.
    """
    sound = rows.filter("type = 'p' and enddoy > 0 and area > 0 and fname is not null")
    kept = _enough(sound.select(F.col("fname").cast("string").alias("fire"), F.col("enddoy").cast("double").alias("_when"), F.col("area").cast("double").alias("area"), "spdir_p", "ros_p"))
    summed = running(kept, ["fire"], F.col("_when"), ["area"], scratch)
    bearing = F.when(F.col("spdir_p").between(0, 360), F.col("spdir_p").cast("double"))
    return summed.select("fire", ((F.col("_when") - F.col("_start")) * 24).alias("t"), F.col("area_").alias("area"), bearing.alias("bearing"), F.when(F.col("ros_p") > 0, F.col("ros_p") / 1000).alias("rate"))


def acquisitions(rows: DataFrame, prefix: str = "medeu-") -> DataFrame:
    """States (fire, t, area, bearing, rate) from rows (fire, at: text of date and time, area, x, y: a place in metres of
    EPSG:3035). A row without an area, a place or a time is no state, and takes nothing from its fire's others; fires need
    LEAST_STATES. Bearing and rate are those from the state before, null if it is at the same time or over MOST_GAP_H away."""
    lat, lon = laea_inverse(F.col("x"), F.col("y"))
    when = F.unix_micros(F.try_to_timestamp(F.col("at"))) / 3.6e9
    sound = rows.select(F.concat(F.lit(prefix), F.col("fire").cast("string")).alias("fire"), when.alias("_when"), F.col("area").cast("double").alias("area"), lat.alias("lat"), lon.alias("lon"))
    kept = _enough(sound.filter("fire is not null and _when is not null and area is not null and lat is not null and lon is not null"))
    w = Window.partitionBy("fire").orderBy("_when", "area", "lat", "lon")
    before = {f"_{c}": F.lag(c).over(w) for c in ("_when", "lat", "lon")}
    s = kept.withColumns(before).withColumn("_dt", F.col("_when") - F.col("__when"))
    near = (F.col("_dt") > 0) & (F.col("_dt") <= MOST_GAP_H)
    place = [F.col(c) for c in ("_lat", "_lon", "lat", "lon")]
    return s.select("fire", (F.col("_when") - F.col("_start")).alias("t"), "area", F.when(near, bearing_deg(*place)).alias("bearing"), F.when(near, haversine_km(*place) / F.col("_dt")).alias("rate"))


def _authalic() -> tuple[float, float, float, float]:
    """(e2, sphere's radius, latitude of the origin on it, stretch) of the projection."""
    e2 = GRS80_F * (2 - GRS80_F)
    e, p = math.sqrt(e2), math.radians(LAEA_LAT)

    def q(s: float) -> float:
        return (1 - e2) * (s / (1 - e2 * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))

    b0, radius = math.asin(q(math.sin(p)) / q(1.0)), GRS80_A * math.sqrt(q(1.0) / 2)
    return e2, radius, b0, GRS80_A * math.cos(p) / math.sqrt(1 - e2 * math.sin(p) ** 2) / (radius * math.cos(b0))


def laea_forward(lat: Column, lon: Column) -> tuple[Column, Column]:
    """(x, y) in metres of EPSG:3035."""
    e2, radius, b0, d = _authalic()
    e, s = math.sqrt(e2), F.sin(F.radians(lat))
    q = (1 - e2) * (s / (1 - e2 * s * s) - F.log((1 - e * s) / (1 + e * s)) / (2 * e))
    top = (1 - e2) * (1 / (1 - e2) - math.log((1 - e) / (1 + e)) / (2 * e))
    b, turn = F.asin(q / top), F.radians(lon - LAEA_LON)
    scale = radius * F.sqrt(2 / (1 + math.sin(b0) * F.sin(b) + math.cos(b0) * F.cos(b) * F.cos(turn)))
    x = LAEA_X + scale * d * F.cos(b) * F.sin(turn)
    return x, LAEA_Y + scale / d * (math.cos(b0) * F.sin(b) - math.sin(b0) * F.cos(b) * F.cos(turn))


def laea_inverse(x: Column, y: Column) -> tuple[Column, Column]:
    """(lat, lon) of a place in EPSG:3035 (Snyder's series)."""
    e2, radius, b0, d = _authalic()
    east, north = (x - LAEA_X) / d, (y - LAEA_Y) * d
    rho = F.hypot(east, north)
    c = 2 * F.asin(rho / (2 * radius))
    b = F.when(rho == 0, b0).otherwise(F.asin(F.cos(c) * math.sin(b0) + F.try_divide(north * F.sin(c), rho) * math.cos(b0)))
    lat = b + (e2 / 3 + 31 * e2**2 / 180 + 517 * e2**3 / 5040) * F.sin(2 * b) + (23 * e2**2 / 360 + 251 * e2**3 / 3780) * F.sin(4 * b) + 761 * e2**3 / 45360 * F.sin(6 * b)
    lon = F.atan2(east * F.sin(c), rho * math.cos(b0) * F.cos(c) - north * math.sin(b0) * F.sin(c))
    return F.degrees(lat), LAEA_LON + F.degrees(lon)
