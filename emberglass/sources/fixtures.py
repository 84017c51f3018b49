"""Readers of single JSON files that an operator supplies: heat sources, settlements, cell surveys, scores, forecasts.

What a file may lack is told apart: a file that need not be there gives no rows and a warning, one that must state its
origin is refused with the name of what it lacks. Only file names and single head rows come to the driver.
"""

from __future__ import annotations

import re
import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberglass.functions.geo import utm30_inverse
from emberglass.operators.normalize import zoned_epoch_s

POINTS = "array<array<double>>"
SETTLEMENT = "id string, name string, buildings long, population long, centreUtm30n array<double>, hullUtm30n array<array<double>>"
CELL = "mcc int, mnc int, lac int, cellid long, lat double, lon double, range double"
SURVEY = f"source string, endpoint string, fetchedAt string, region struct<south: double, west: double, north: double, east: double>, maxAreaM2 double, tilesRequested double, tilesFailed double, measuredRangeCells double, failures array<string>, cells array<struct<{', '.join(f.replace(' ', ': ') for f in CELL.split(', '))}>>"
FIT = "struct<r2: double, median_r2_per_fire: double, median_mape: double>"
SCORES = f"corpus string, fires double, rate_basis string, primary boolean, mean_rate_kmh double, burned_area struct<persistence: {FIT}, constant_ros: {FIT}>, bearing_rate struct<rate_fires: double, direction_fires: double, persistence: struct<rate_r2: double, rate_median_mape: double, median_bearing_error_deg: double>>, model struct<computed: boolean, fires: double, rate: struct<model: struct<r2: double, median_mape: double>>, bearing: struct<model_median_error_deg: double>>"
INDEX_SCHEMA, INDEX_BYTES, FORECAST_BYTES, INDEX_ENTRIES = "thermal-forecast-index-v1", 4_000_000, 2_000_000, 10_000


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _optional(spark: SparkSession, path: str, schema: str, without: str) -> DataFrame:
    """The file as one row; no row and a warning where there is none."""
    if exists(spark, path):
        return spark.read.option("multiLine", True).option("mode", "FAILFAST").schema(schema).json(path)
    warnings.warn(f"no file at {path}: {without}", stacklevel=3)
    return spark.createDataFrame([], schema)


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def static_heat(spark: SparkSession, path: str) -> DataFrame:
    """(ring_id: place in the file, ring: array of lat, lon): the outer ring of a polygon, of the first part of a
    multipolygon. Points without two finite numbers go; a ring of fewer than three points is left out."""
    doc = _optional(spark, path, "features array<struct<geometry: struct<type: string, coordinates: string>>>", "static heat stays in the mask")
    f = doc.select(F.posexplode("features").alias("ring_id", "f"))
    outer = F.when(F.col("f.geometry.type") == "Polygon", F.get(F.from_json("f.geometry.coordinates", f"array<{POINTS}>"), 0)).otherwise(F.get(F.get(F.from_json("f.geometry.coordinates", f"array<array<{POINTS}>>"), 0), 0))
    sound = F.filter(outer, lambda p: (F.size(p) >= 2) & _finite(F.get(p, 0)) & _finite(F.get(p, 1)))
    ring = F.transform(sound, lambda p: F.struct(F.get(p, 1).alias("lat"), F.get(p, 0).alias("lon")))
    return f.select("ring_id", ring.alias("ring")).filter(F.size("ring") >= 3)


def settlements(spark: SparkSession, path: str) -> DataFrame:
    """(sid, name, buildings, population, lat, lon, outline: closed array of lat, lon) from hulls in UTM zone 30 north; a
    hull of fewer than three points is left out. Of equal ids the last in the file counts."""
    doc = _optional(spark, path, f"settlements array<struct<{', '.join(f.replace(' ', ': ', 1) for f in SETTLEMENT.split(', '))}>>", "areas will be placeholder boxes")
    s = doc.select(F.posexplode("settlements").alias("pos", "s")).select("pos", "s.*").filter(F.size("hullUtm30n") >= 3)

    def place(p: Column) -> Column:
        lat, lon = utm30_inverse(F.get(p, 0), F.get(p, 1))
        return F.struct(lat.alias("lat"), lon.alias("lon"))

    hull = F.transform("hullUtm30n", place)
    ends_meet = F.get("hullUtm30n", 0) == F.element_at("hullUtm30n", -1)
    rows = s.select("pos", F.col("id").alias("sid"), "name", "buildings", "population", place(F.col("centreUtm30n")).alias("c"), F.when(ends_meet, hull).otherwise(F.concat(hull, F.slice(hull, 1, 1))).alias("outline"))
    last = rows.groupBy("sid").agg(F.max_by(F.struct(*rows.columns), "pos").alias("r"))
    return last.select("sid", "r.name", "r.buildings", "r.population", "r.c.lat", "r.c.lon", "r.outline")


def cell_survey(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(cells: ord, mcc, mnc, lac, cellid, lat, lon, range_m; one row: where they are from) of a survey of cells.

    Nothing is put in place of what the file lacks: no cells, no origin, counts that aren't whole numbers from 0, an area
    not above 0, a region that isn't finite, or no list of failures are errors at once, naming the file and the field. A
    number counts as text where text is due.
    """
    if not exists(spark, path):
        raise ValueError(f"no survey at {path}")
    doc = spark.read.option("multiLine", True).schema(SURVEY).json(path)
    count = lambda c: _finite(F.col(c)) & (F.col(c) >= 0) & (F.col(c) == F.floor(c)) & (F.col(c) < 2.0**53)
    needs = {c: F.trim(c) != "" for c in ("source", "endpoint", "fetchedAt")}
    needs |= {c: count(c) for c in ("tilesRequested", "tilesFailed", "measuredRangeCells")}
    needs |= {"maxAreaM2": _finite(F.col("maxAreaM2")) & (F.col("maxAreaM2") > 0), "failures": F.col("failures").isNotNull(), "cells": F.size("cells") > 0}
    region = [_finite(F.col(f"region.{c}")) for c in ("south", "west", "north", "east")]
    needs["region"] = region[0] & region[1] & region[2] & region[3]
    lacking = doc.select(F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(c)) for c, ok in needs.items()]), lambda x: x.isNotNull()).alias("l")).first()
    if lacking is None or lacking["l"]:
        raise ValueError(f"{path} has no usable {', '.join(lacking['l']) if lacking else 'content'}")
    head = doc.select(*[F.trim(c).alias(c) for c in ("source", "endpoint", "fetchedAt")], "region", "maxAreaM2", *[F.col(c).cast("long").alias(c) for c in ("tilesRequested", "tilesFailed", "measuredRangeCells")], "failures")
    cells = doc.select(F.posexplode("cells").alias("ord", "c")).select("ord", "c.*")
    return cells.withColumnRenamed("range", "range_m"), head


def harness_scores(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(scores: name, target, corpus, r2, median_r2, median_mape, median_bearing_error, events; one row: mean_rate_kmh) of
    primary rows. No file gives no scores; a row of another shape is an error. The mean rate is that of the first primary
    corpus whose rate is that of a front, null if there is none."""
    doc = _optional(spark, path, f"rows array<struct<{re.sub(r'(^|, )(\w+) (?=string|double|boolean|struct)', r'\1\2: ', SCORES)}>>", "no scores")
    b, area, fit = F.col("r.bearing_rate"), F.col("r.burned_area"), F.col("r.model")
    shaped = F.col("r.corpus").isNotNull() & F.col("r.fires").isNotNull() & F.col("r.rate_basis").isin("frontal", "centroid_drift") & F.col("r.primary").isNotNull() & area["persistence"].isNotNull() & b["rate_fires"].isNotNull() & b["direction_fires"].isNotNull() & b["persistence"].isNotNull()
    bad = F.raise_error(F.lit(f"{path} is no harness output")).cast("boolean")
    every = F.when(F.col("rows").isNotNull(), F.col("rows")).otherwise(F.raise_error(F.lit(f"{path} is no harness output")).cast(doc.schema["rows"].dataType))
    rows = doc.select(F.posexplode(every).alias("ord", "r")).filter(F.when(F.coalesce(shaped, F.lit(False)), F.lit(True)).otherwise(bad)).filter("r.primary")
    none = F.lit(None).cast("double")

    def score(name: str, target: str, ok: Column, *values: Column) -> Column:
        names = ("r2", "median_r2", "median_mape", "median_bearing_error", "events")
        return F.when(ok, F.struct(F.lit(name).alias("name"), F.lit(target).alias("target"), *[v.alias(n) for n, v in zip(names, values)]))

    one = [score(k, "burned_area", area[k]["r2"].isNotNull(), *[area[k][c] for c in ("r2", "median_r2_per_fire", "median_mape")], none, F.col("r.fires")) for k in ("persistence", "constant_ros")]
    one.append(score("persistence", "bearing_rate", F.lit(True), b["persistence"]["rate_r2"], none, b["persistence"]["rate_median_mape"], b["persistence"]["median_bearing_error_deg"], b["rate_fires"]))
    one.append(score("model", "bearing_rate", F.coalesce(fit["computed"], F.lit(False)) & fit["rate"]["model"].isNotNull(), fit["rate"]["model"]["r2"], none, fit["rate"]["model"]["median_mape"], fit["bearing"]["model_median_error_deg"], F.coalesce(fit["fires"], F.col("r.fires"))))
    scores = rows.select(F.col("r.corpus").alias("corpus"), F.explode(F.filter(F.array(*one), lambda x: x.isNotNull())).alias("s")).select("s.name", "s.target", "corpus", "s.r2", "s.median_r2", "s.median_mape", "s.median_bearing_error", "s.events")
    front = (F.col("r.rate_basis") == "frontal") & F.col("r.mean_rate_kmh").isNotNull()
    return scores, rows.agg(F.min(F.when(front, F.struct("ord", F.col("r.mean_rate_kmh").alias("v"))))["v"].alias("mean_rate_kmh"))


def snapshot_name(spark: SparkSession, folder: str, wanted: str = "") -> str | None:
    """Of a folder's JSON files that of the wanted name, else the last by name that goes on from it after a hyphen; the
    newest one if none is wanted, the last by name of several. None for a folder without any; a wish that none meets is an
    error. Only names and times are read."""
    if not exists(spark, folder):
        return None
    name = F.element_at(F.split("path", "/"), -1)
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder).select(name.alias("name"), F.col("modificationTime").alias("at"))
    if not wanted:
        newest = listed.orderBy(F.desc("at"), F.desc("name")).first()
        return newest and newest["name"]
    rank = F.when(F.col("name") == wanted, 1).when(F.startswith("name", F.lit(f"{wanted}-")), 0)
    hit = listed.agg(F.max(F.when(rank.isNotNull(), F.struct(rank.alias("rank"), "name")))["name"].alias("name"), F.count("*").alias("n")).first()
    if hit["n"] and not hit["name"]:
        raise ValueError(f"no snapshot in {folder} is called {wanted}")
    return hit["name"]


def forecast_index(spark: SparkSession, root: str) -> DataFrame:
    """(event_id, issue_s, file, sha256) of a forecast store's index; an index of another shape or size is an error."""
    entry = "struct<eventId: string, issuedAt: string, file: string, sha256: string>"
    raw = spark.read.format("binaryFile").load(f"{root}/index.json").select("length", F.from_json(F.col("content").cast("string"), f"schema string, entries array<{entry}>").alias("d"))
    hexed = "^[a-f0-9]{64}"
    sound = F.forall("d.entries", lambda e: e["eventId"].isNotNull() & zoned_epoch_s(e["issuedAt"]).isNotNull() & e["file"].rlike(hexed + r"\.json$") & e["sha256"].rlike(hexed + "$"))
    ok = (F.col("length") <= INDEX_BYTES) & (F.col("d.schema") == INDEX_SCHEMA) & (F.size("d.entries") <= INDEX_ENTRIES) & sound
    entries = F.when(F.coalesce(ok, F.lit(False)), F.col("d.entries")).otherwise(F.raise_error(F.lit("invalid forecast index")).cast(f"array<{entry}>"))
    e = raw.select(F.explode(entries).alias("e"))
    return e.select(F.col("e.eventId").alias("event_id"), zoned_epoch_s(F.col("e.issuedAt")).alias("issue_s"), F.col("e.file").alias("file"), F.col("e.sha256").alias("sha256"))


def forecasts(spark: SparkSession, root: str) -> DataFrame:
    """(event_id, issue_s, content: JSON text) of all forecasts of the index whose file is there. A file that is too large,
    whose digest differs, or that is of another event or time is an error where it is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(root)
    j = forecast_index(spark, root).join(files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "length", "content"), "file")
    text = F.col("content").cast("string")
    own = (F.get_json_object(text, "$.eventId") == F.col("event_id")) & (zoned_epoch_s(F.get_json_object(text, "$.issuedAt")) == F.col("issue_s"))
    fault = F.when(F.col("length") > FORECAST_BYTES, "size").when(F.sha2("content", 256) != F.col("sha256"), "checksum").when(~F.coalesce(own, F.lit(False)), "request")
    checked = F.when(fault.isNull(), text).otherwise(F.raise_error(F.concat(F.lit("forecast mismatch: "), fault)).cast("string"))
    return j.select("event_id", "issue_s", checked.alias("content"))
