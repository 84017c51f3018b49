"""Whole-shape work on rings: blending, rasterising, displacement. Pandas, one row or one group at a time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberglass.constants import EARTH_KM


def resample(ring: np.ndarray, n: int) -> np.ndarray:
    """n points at equal arc lengths along a closed ring (its last point is its first)."""
    steps = np.hypot(*np.diff(ring, axis=0).T)
    along = np.append(0, np.cumsum(steps))
    at = np.linspace(0, along[-1], n, endpoint=False)
    return np.column_stack([np.interp(at, along, ring[:, k]) for k in (0, 1)])


def morph(a: np.ndarray, b: np.ndarray, t: float, n: int = 64) -> np.ndarray:
    """The ring t of the way from a to b; b is turned so that its points are nearest to a's."""
    p, q = resample(a, n), resample(b, n)
    turn = min(range(n), key=lambda k: float(((p - np.roll(q, -k, axis=0)) ** 2).sum()))
    out = (1 - t) * p + t * np.roll(q, -turn, axis=0)
    return np.vstack([out, out[:1]])


def morphed(rings: DataFrame, t: str = "t", n: int = 64) -> DataFrame:
    """rings (id, a, b: arrays of (x, y), t) with ring, the blend."""

    @F.pandas_udf("array<struct<x: double, y: double>>")
    def blend(a: pd.Series, b: pd.Series, at: pd.Series) -> pd.Series:
        xy = lambda r: np.array([(p["x"], p["y"]) for p in r], float)
        return pd.Series([[{"x": x, "y": y} for x, y in morph(xy(p), xy(q), s, n)] for p, q, s in zip(a, b, at)])

    return rings.withColumn("ring", blend("a", "b", t))


def cells_in_ring(rings: DataFrame, size: float) -> DataFrame:
    """(id, row, col) of the grid cells whose centre lies in a ring (array of lat, lon): its box's cells, tested one by one."""
    from emberglass.functions.geo import in_ring

    lat, lon = F.transform("ring", lambda p: p["lat"]), F.transform("ring", lambda p: p["lon"])
    span = lambda v: F.sequence(F.floor(F.array_min(v) / size).cast("int"), F.floor(F.array_max(v) / size).cast("int"))
    cells = rings.withColumn("row", F.explode(span(lat))).withColumn("col", F.explode(span(lon)))
    return cells.filter(in_ring((F.col("row") + 0.5) * size, (F.col("col") + 0.5) * size, F.col("ring"))).select("id", "row", "col")


def destination(lat: Column, lon: Column, bearing: Column, km: Column) -> tuple[Column, Column]:
    """Where one gets to from a point."""
    p, d, b = F.radians(lat), km / EARTH_KM, F.radians(bearing)
    p2 = F.asin(F.sin(p) * F.cos(d) + F.cos(p) * F.sin(d) * F.cos(b))
    l2 = F.radians(lon) + F.atan2(F.sin(b) * F.sin(d) * F.cos(p), F.cos(d) - F.sin(p) * F.sin(p2))
    return F.degrees(p2), F.pmod(F.degrees(l2) + 540.0, F.lit(360.0)) - 180.0


def local_stamp(epoch_s: Column, zone: str = "Europe/Madrid") -> Column:
    """The time with its zone's offset, as alerts carry it."""
    utc = F.timestamp_seconds(epoch_s)
    local = F.from_utc_timestamp(utc, zone)
    minutes = ((F.unix_seconds(local) - F.unix_seconds(utc)) / 60).cast("int")
    sign = F.when(minutes < 0, "-").otherwise("+")
    return F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), F.format_string("%s%02d:%02d", sign, F.abs(minutes / 60).cast("int"), F.abs(minutes % 60)))
