"""From what a source sent to typed rows: what it did not supply is null, never a plausible value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberglass.constants import CONFIDENCE, lookup


def number_or_null(text: Column) -> Column:
    """A finite number; blanks, words, NaN and infinities are null."""
    n = F.trim(text).try_cast("double")
    return F.when(~F.isnan(n) & (F.abs(n) < float("inf")), n)


def first_non_blank(*texts: Column) -> Column:
    """The first text that has more than spaces, as it is."""
    return F.coalesce(*[F.when(F.trim(t) != "", t) for t in texts])


def confidence(word: Column) -> Column:
    """The word's number; unknown words are null, not the least."""
    return lookup(CONFIDENCE, F.upper(F.trim(word)))


def zoned_epoch_s(text: Column) -> Column:
    """Seconds of a time that states its zone; a time without one is null, not UTC."""
    t = F.try_to_timestamp(F.when(text.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), text))
    return F.unix_seconds(t)


def point(coordinates: Column) -> Column:
    """(lat, lon) of [lon, lat], both finite, else null."""
    lon, lat = F.get(coordinates, 0), F.get(coordinates, 1)
    ok = lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon) & (F.abs(lat) < float("inf")) & (F.abs(lon) < float("inf"))
    return F.when(ok, F.struct(lat.alias("lat"), lon.alias("lon")))


def ring(positions: Column) -> Column:
    """Points of a closed ring of at least four finite positions, else null."""
    points = F.transform(positions, point)
    closed = F.element_at(points, 1) == F.element_at(points, -1)
    return F.when((F.size(positions) >= 4) & F.forall(points, lambda p: p.isNotNull()) & closed, points)


def perimeter_parts(rows: DataFrame, polygons: str, keys: list[str]) -> DataFrame:
    """One row per part with a sound outer ring: part_index and part_count count those that survive.

    polygons: an array of polygons, each an array of rings of [lon, lat].
    """
    parts = rows.select(*keys, F.posexplode(F.transform(polygons, lambda p: ring(F.element_at(p, 1)))).alias("raw_index", "polygon")).filter("polygon is not null")
    w = Window.partitionBy(*keys)
    return parts.withColumns({"part_index": F.row_number().over(w.orderBy("raw_index")) - 1, "part_count": F.count("*").over(w)}).drop("raw_index")


def bbox(points: Column) -> Column:
    lat, lon = F.transform(points, lambda p: p["lat"]), F.transform(points, lambda p: p["lon"])
    return F.struct(F.array_min(lon).alias("west"), F.array_min(lat).alias("south"), F.array_max(lon).alias("east"), F.array_max(lat).alias("north"))


def hotspots(raw: DataFrame) -> DataFrame:
    """Typed detections of raw features (id, props map, coordinates). Such without a place are left out; count them with
    rejected()."""
    p = lambda k: F.col("props").getItem(k)
    return raw.select(
        first_non_blank(p("id"), F.col("id"), F.lit("")).alias("id"), point(F.col("coordinates")).alias("position"), number_or_null(p("fire_radiative_power")).alias("frp"),
        confidence(p("confidence")).alias("confidence"), zoned_epoch_s(p("observed_at")).alias("at_s"), zoned_epoch_s(p("available_at")).alias("recorded_s"),
        first_non_blank(p("source")).alias("source"), first_non_blank(p("cluster_id")).alias("cluster_id"),
    ).filter("position is not null")


def rejected(raw: DataFrame) -> DataFrame:
    """One row: how many features have no place."""
    return raw.agg(F.count_if(point(F.col("coordinates")).isNull()).alias("rejected"), F.count("*").alias("total"))


def clusters(named: DataFrame, det: DataFrame) -> DataFrame:
    """Every named cluster with its members' ids, null-aware power sum and box; such without members survive."""
    of = det.groupBy("cluster_id").agg(F.array_sort(F.collect_list("id")).alias("hotspot_ids"), F.sum("frp").alias("total_frp"), F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lon").alias("west"), F.max("lon").alias("east"))
    return named.join(of, "cluster_id", "left").withColumn("hotspot_ids", F.coalesce("hotspot_ids", F.array().cast("array<bigint>")))


def latest_part(perimeters: DataFrame) -> DataFrame:
    """Of each cluster the newest perimeter's first part; unknown times are oldest."""
    w = Window.partitionBy("cluster_id").orderBy(F.desc_nulls_last("observed_s"), "part_index")
    return perimeters.withColumn("nth", F.row_number().over(w)).filter("nth = 1").drop("nth")
