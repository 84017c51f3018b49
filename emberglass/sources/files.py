"""Readers of captures, infrastructure, road graphs, scans, forecasts and ledgers; writers that never mix with old output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberglass.operators.normalize import first_non_blank, number_or_null, point, zoned_epoch_s

FEATURE = "struct<id: string, type: string, geometry: struct<type: string, coordinates: string>, properties: map<string, string>>"
HIGHWAY_RANK = ["motorway", "trunk", "primary", "secondary", "tertiary", "unclassified", "residential", "living_street", "service", "track", "road"]


def features(spark: SparkSession, path: str) -> DataFrame:
    """(id, kind, coordinates as JSON text, props) of a feature collection file. A file of another shape is an error."""
    doc = spark.read.option("multiLine", True).schema(f"type string, features array<{FEATURE}>").json(path)
    bad = F.raise_error(F.lit("the file is no FeatureCollection")).cast(f"array<{FEATURE}>")
    ok = (F.col("type") == "FeatureCollection") & F.col("features").isNotNull()
    return doc.select(F.explode(F.when(ok, F.col("features")).otherwise(bad)).alias("f")).select("f.id", F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates"), F.col("f.properties").alias("props"))


def infrastructure(layers: dict[str, DataFrame | None]) -> tuple[DataFrame, DataFrame]:
    """(assets, status): points as they are; a line stands at vertex floor(n / 2) and keeps its path. A layer that is
    None could not be read. status: layer, assets, rejected, status (ok, partial, unavailable)."""
    spark = next(d for d in layers.values() if d is not None).sparkSession
    assets, counts = [], []
    for layer, raw in layers.items():
        if raw is None:
            counts.append(spark.createDataFrame([(layer, 0, 0)], "layer string, assets long, rejected long"))
            continue
        path = F.when(F.col("kind") == "LineString", F.from_json("coordinates", "array<array<double>>"))
        place = F.when(F.col("kind") == "Point", F.from_json("coordinates", "array<double>")).when(F.size(path) >= 2, F.get(path, F.floor(F.size(path) / 2).cast("int")))
        p = lambda k: F.col("props").getItem(k)
        rows = raw.select(F.lit(layer).alias("layer"), first_non_blank(p("id"), F.col("id")).alias("asset_id"), first_non_blank(p("name")).alias("name"), first_non_blank(p("category"), F.lit(layer)).alias("category"), point(place).alias("position"), number_or_null(p("voltageKv")).alias("voltage_kv"), path.alias("path"))
        assets.append(rows.filter("position is not null and asset_id is not null"))
        counts.append(rows.groupBy("layer").agg(F.count_if(F.col("position").isNotNull() & F.col("asset_id").isNotNull()).alias("assets"), F.count_if(F.col("position").isNull() | F.col("asset_id").isNull()).alias("rejected")))
    out, n = assets[0], counts[0]
    for a in assets[1:]:
        out = out.unionByName(a)
    for c in counts[1:]:
        n = n.unionByName(c)
    missing = [k for k, d in layers.items() if d is None]
    return out, n.withColumn("status", F.when(F.col("layer").isin(missing), "unavailable").when(F.col("rejected") > 0, "partial").otherwise("ok"))


def road_graph(edges: DataFrame, geometries: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges with their path, rejected edges with a reason). edges: edge, src, dst, highway, name, travel_s, geometry_ix,
    reversed; geometries: geometry_ix, path; nodes: node. A reversed edge walks its geometry backwards."""
    n = nodes.select("node").distinct()
    j = edges.join(geometries, "geometry_ix", "left").join(n.select(F.col("node").alias("src"), F.lit(True).alias("has_src")), "src", "left").join(n.select(F.col("node").alias("dst"), F.lit(True).alias("has_dst")), "dst", "left")
    reason = F.when(F.col("has_src").isNull() | F.col("has_dst").isNull(), "unknown node").when(F.col("path").isNull() | (F.size("path") < 2), "no geometry").when(F.coalesce(F.col("travel_s") <= 0, F.lit(True)), "no travel time")
    j = j.withColumns({"reason": reason, "path": F.when(F.col("reversed"), F.reverse("path")).otherwise(F.col("path"))}).drop("has_src", "has_dst")
    return j.filter("reason is null").drop("reason"), j.filter("reason is not null").select("edge", "reason")


def split_ways(ways: DataFrame) -> DataFrame:
    """Ways (way, refs, one_way: 1, -1 or 0) cut at vertices that ways share: edges (way, piece, src, dst, backwards)."""
    w = Window.partitionBy("way").orderBy("pos")
    v = ways.dropDuplicates(["way"]).select("way", "one_way", F.posexplode("refs").alias("pos", "ref"))
    shared = v.groupBy("ref").agg(F.count("*").alias("n"))
    v = v.join(shared, "ref").withColumn("end", (F.col("pos") == 0) | (F.col("n") > 1) | F.lead("ref").over(w).isNull())
    ends = v.filter("end").withColumns({"src": F.col("ref"), "dst": F.lead("ref").over(w), "piece": F.row_number().over(w) - 1}).filter("dst is not null")
    both = ends.withColumn("backwards", F.explode(F.when(F.col("one_way") == 1, F.array(F.lit(False))).when(F.col("one_way") == -1, F.array(F.lit(True))).otherwise(F.array(F.lit(False), F.lit(True)))))
    return both.select("way", "piece", F.when(F.col("backwards"), F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(F.col("backwards"), F.col("src")).otherwise(F.col("dst")).alias("dst"), "backwards")


def capture(raw: DataFrame, origin_s: int, clusters: DataFrame | None = None) -> DataFrame:
    """Detections of raw features: such without a finite place or a zoned time are dropped; of clusters, if given."""
    p = lambda k: F.col("props").getItem(k)
    at = zoned_epoch_s(p("observed_at"))
    place = point(F.from_json("coordinates", "array<double>"))
    out = raw.select(first_non_blank(p("id"), F.col("id")).alias("id"), place["lat"].alias("lat"), place["lon"].alias("lon"), (at - origin_s).alias("at_s"), first_non_blank(p("source")).alias("source"), first_non_blank(p("cluster_id")).alias("cluster_id")).filter("lat is not null and at_s is not null")
    return out if clusters is None else out.join(clusters.select("cluster_id").distinct(), "cluster_id", "left_semi")


SCAN = "ACQTIME string, ABS_LINE int, ABS_SAMP int, LONGITUDE double, LATITUDE double, FRP string, FRP_UNCERTAINTY string, FIRE_CONFIDENCE double, PIXEL_SIZE double"
#: Rows and columns of the full disc.
SIDE = 11136


def scans(spark: SparkSession, root: str, box: tuple[float, float, float, float], minutes: int = 11) -> DataFrame:
    """Rows of scan files named by their time (yyyyMMddHHmmss), within the box (west, south, east, north).

    Errors are: a time in another form, an acquisition outside [scan, scan + minutes), a row or column off the grid of
    SIDE, two files of one name, and a pixel that a scan has twice. Power below 0 or not finite is null.
    """
    raw = spark.read.schema(SCAN).option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv*").csv(root)
    west, south, east, north = box
    name, path = F.col("_metadata.file_name"), F.col("_metadata.file_path")
    names = raw.select(name.alias("name"), path.alias("path")).distinct().groupBy("name").agg(F.count("*").alias("files"))
    scan = F.unix_seconds(F.to_timestamp(F.regexp_extract(name, r"(\d{14})", 1), "yyyyMMddHHmmss"))
    acquired = F.unix_seconds(F.to_timestamp("ACQTIME", "yyyyMMddHHmmss"))
    rows = raw.withColumns({"scan_s": scan, "acquired_s": acquired, "name": name}).filter(F.col("LONGITUDE").between(west, east) & F.col("LATITUDE").between(south, north))
    rows = rows.join(names, "name").withColumn("times", F.count("*").over(Window.partitionBy("scan_s", "ABS_LINE", "ABS_SAMP")))
    in_scan = (F.col("acquired_s") >= F.col("scan_s")) & (F.col("acquired_s") < F.col("scan_s") + minutes * 60)
    on_grid = F.col("ABS_LINE").between(0, SIDE - 1) & F.col("ABS_SAMP").between(0, SIDE - 1)
    fault = F.when(F.col("files") > 1, "two files have one name").when(~F.coalesce(in_scan, F.lit(False)), "an acquisition lies outside its scan").when(~F.coalesce(on_grid, F.lit(False)), "a pixel lies off the grid").when(F.col("times") > 1, "a scan has a pixel twice")
    frp = number_or_null(F.col("FRP"))
    checked = F.when(fault.isNotNull(), F.raise_error(fault).cast("long")).otherwise(F.col("acquired_s"))
    return rows.select("scan_s", checked.alias("acquired_s"), F.col("ABS_LINE").alias("row"), F.col("ABS_SAMP").alias("col"), F.col("LONGITUDE").alias("lon"), F.col("LATITUDE").alias("lat"), F.when(frp >= 0, frp).alias("frp"), F.col("FIRE_CONFIDENCE").alias("confidence"), F.col("PIXEL_SIZE").alias("pixel"))


def quality_calendar(flags: DataFrame, cells: DataFrame, start_s: int, end_s: int, step_s: int = 600, latency_s: int = 2700) -> DataFrame:
    """cells (row, col) at every scan time with their flag; a scan that is missing has flag 255. available_s is the
    later of the file's creation and the scan's time plus latency."""
    grid = cells.withColumn("scan_s", F.explode(F.sequence(F.lit(start_s), F.lit(end_s - step_s), F.lit(step_s))))
    out = grid.join(flags.select("row", "col", F.col("scan_s").cast("int").alias("scan_s"), "flag", "created_s"), ["row", "col", "scan_s"], "left")
    return out.select("row", "col", "scan_s", F.coalesce("flag", F.lit(255)).alias("flag"), F.greatest("created_s", F.col("scan_s") + latency_s).alias("available_s"))


def weather_at(issues: DataFrame, weather: DataFrame, lead_s: int = 64800) -> DataFrame:
    """issues (issue_s, valid_s, loc) with the weather of the hour of valid_s; it must be forecast no later than issue_s.

    weather: loc, hour_s, speed, direction, ... Wind comes FROM its direction. A missing hour, or one issued later, is an
    error rather than a null.
    """
    hour = (F.floor(F.col("valid_s") / 3600) * 3600).cast("long")
    j = issues.withColumn("hour_s", hour).join(weather, ["loc", "hour_s"], "left")
    bad = F.col("speed").isNull() | (F.col("valid_s") - lead_s > F.col("issue_s"))
    d = F.radians("direction")
    speed = F.when(bad, F.raise_error(F.lit("weather that was not there at the time of issue")).cast("double")).otherwise(F.col("speed"))
    return j.withColumns({"wind_east": -speed * F.sin(d), "wind_north": -speed * F.cos(d)})


def in_range(value: Column, low: float, high: float) -> Column:
    """(value or 0, 1 if it was physical else 0)."""
    ok = F.coalesce(value.between(low, high) & ~F.isnan(value), F.lit(False))
    return F.struct(F.when(ok, value).otherwise(0.0).alias("value"), ok.cast("int").alias("valid"))


def forecast_faults(forecasts: DataFrame, side: int = 64, horizons: int = 3) -> DataFrame:
    """forecasts (id, rows, cols, horizons: array of arrays of probabilities) with the names of the rules each breaks."""
    h = F.col("horizons")
    rules = {
        "grid": (F.col("rows") != side) | (F.col("cols") != side),
        "horizons": F.size(h) != horizons,
        "cells": F.exists(h, lambda p: F.size(p) != side * side),
        "range": F.exists(h, lambda p: F.exists(p, lambda x: x.isNull() | F.isnan(x) | (x < 0) | (x > 1))),
        "monotone": F.exists(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(h) - 1)), lambda i: F.exists(F.zip_with(F.get(h, i - 1), F.get(h, i), lambda a, b: a > b), lambda x: x)),
    }
    broken = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    return forecasts.select("id", broken.alias("faults"))


LEDGER = "seq long, cursor_s long, fingerprint string, pocket string, payload string"


def read_ledger(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(entries, one row: unreadable lines). A torn or wrongly typed line is counted, not guessed at."""
    raw = spark.read.text(path).withColumn("e", F.from_json("value", LEDGER, {"mode": "PERMISSIVE"}))
    ok = F.col("e.seq").isNotNull() & F.col("e.cursor_s").isNotNull() & F.col("e.fingerprint").isNotNull() & F.col("e.pocket").isNotNull()
    return raw.filter(ok).select("e.*"), raw.agg(F.count_if(~ok & (F.trim("value") != "")).alias("unreadable"))


def append_ledger(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").json(path)


def write_new(df: DataFrame, path: str) -> None:
    """Parquet in a folder that must not exist: output never mixes with what an earlier run left."""
    df.write.mode("errorifexists").option("compression", "zstd").parquet(path)


def digest(df: DataFrame, *columns: str) -> DataFrame:
    """df with the SHA-256 of the named columns (all, if none are named) as JSON in order of name."""
    return df.withColumn("sha256", F.sha2(F.to_json(F.struct(*sorted(columns or df.columns))), 256))
