"""Sensors, sweep configurations, roads, assumptions, rings. They must equal the published rules' values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EARTH_KM = 6371.0088
EARTH_M = 6371008.8

# Fixed values, begin.
LATENCY_S = {"MTG_I1": 1020, "VIIRS_SNPP_NRT": 10800, "VIIRS_NOAA20_NRT": 10800, "VIIRS_NOAA21_NRT": 10800, "MODIS_NRT": 10800, "SENTINEL_3A": 21600, "SENTINEL_3B": 21600}
DEFAULT_LATENCY_S = 10800
FOOTPRINT_M = {"MTG_I1": 600, "VIIRS_SNPP_NRT": 375, "VIIRS_NOAA20_NRT": 375, "VIIRS_NOAA21_NRT": 375, "MODIS_NRT": 1000, "SENTINEL_3A": 1000, "SENTINEL_3B": 1000}
DEFAULT_FOOTPRINT_M = 1000
FAMILY = {"MTG_I1": "MTG-I1", "VIIRS_SNPP_NRT": "VIIRS", "VIIRS_NOAA20_NRT": "VIIRS", "VIIRS_NOAA21_NRT": "VIIRS", "MODIS_NRT": "MODIS", "SENTINEL_3A": "Sentinel-3", "SENTINEL_3B": "Sentinel-3"}
FAMILIES = ["MTG-I1", "VIIRS", "MODIS", "Sentinel-3"]
GEOSTATIONARY = ["MTG_I1"]
CONFIDENCE = {"HIGH": 0.9, "MEDIUM": 0.65, "LOW": 0.3}
# order, id, sources, radius scale, least confidence, static heat kept, fixed metres
SWEEP = [
    (0, "all-1x", "all", 1.0, None, False, None),
    (1, "all-0.5x", "all", 0.5, None, False, None),
    (2, "all-2x", "all", 2.0, None, False, None),
    (3, "geopolar-1x", "geo+polar", 1.0, None, False, None),
    (4, "geopolar-2x", "geo+polar", 2.0, None, False, None),
    (5, "geo-1x", "geo", 1.0, None, False, None),
    (6, "geo-2x", "geo", 2.0, None, False, None),
    (7, "polar-1x", "polar", 1.0, None, False, None),
    (8, "polar-2x", "polar", 2.0, None, False, None),
    (9, "all-1x-highconf", "all", 1.0, 0.9, False, None),
    (10, "all-1x-withstatic", "all", 1.0, None, True, None),
    (11, "all-100m", "all", 1.0, None, False, 100.0),
]
SPEED_KMH = {"motorway": 100, "motorway_link": 60, "trunk": 90, "trunk_link": 60, "primary": 80, "primary_link": 50, "secondary": 70, "secondary_link": 45, "tertiary": 60, "tertiary_link": 40, "unclassified": 50, "residential": 30, "living_street": 20, "service": 20, "track": 15, "road": 30}
CAPACITY_VPH = {"motorway": 3600, "trunk": 2400, "primary": 1800, "secondary": 1500, "tertiary": 1200, "unclassified": 900, "residential": 600, "living_street": 400, "service": 300, "track": 300, "road": 600}
DEFAULT_CAPACITY_VPH = 600
# id, mobile fraction, departure delay min, persons per vehicle, speed scale, capacity scale
PROFILES = [("cautious", 0.7, 30.0, 1.2, 0.7, 0.6), ("optimistic", 0.9, 5.0, 1.6, 1.15, 1.2)]
NOMINAL = ("nominal", 0.8, 15.0, 1.4, 1.0, 1.0)
RINGS_KM = [5.0, 10.0, 20.0]
CATEGORY_WEIGHT = {"hospital": 0, "town": 1, "school": 1, "power-line": 2}
# Fixed values, end.

GATE_DELAY_S = int(max(p[2] for p in PROFILES) * 60)


def lookup(table: dict, key: Column, default=None) -> Column:
    """The value of a small fixed table as an expression."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    found = F.try_element_at(F.create_map(*pairs), key)
    return found if default is None else F.coalesce(found, F.lit(default) if not isinstance(default, Column) else default)


def sweep_configs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SWEEP, "config_ord int, config string, sources string, scale double, min_conf double, static_kept boolean, fixed_m double")


def profiles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PROFILES, "profile string, mobile double, delay_min double, occupancy double, speed_scale double, capacity_scale double")
