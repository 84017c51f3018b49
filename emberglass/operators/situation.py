"""The situation of a fire in one row, and what to look at first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberglass.constants import CATEGORY_WEIGHT, lookup
from emberglass.operators.spatial import SEVERITY


def priority(ring: Column, in_corridor: Column, has_perimeter: Column) -> Column:
    inside = ring == "inside"
    return (
        F.when(inside & ~has_perimeter, F.when(in_corridor, 1).otherwise(2))
        .when(inside | ((ring == "5km") & in_corridor), 1)
        .when((ring == "5km") | ((ring == "10km") & in_corridor), 2)
        .otherwise(3)
    )


def recommendations(threats: DataFrame) -> DataFrame:
    """threats with priority and nth within the fire: by priority, ring, corridor, category, distance, id."""
    t = threats.withColumn("priority", priority(F.col("ring"), F.col("in_corridor"), F.col("has_perimeter")))
    order = ["priority", lookup(SEVERITY, F.col("ring")), F.desc("in_corridor"), lookup(CATEGORY_WEIGHT, F.col("category"), 3), "distance_km", "asset_id"]
    return t.withColumn("nth", F.row_number().over(Window.partitionBy("fire_id").orderBy(*order)))


def packet(clusters: DataFrame, threats: DataFrame, spread: DataFrame, now_s: int) -> DataFrame:
    """One row per fire: its snapshot, threat counts, nearest asset, and whether spread is ahead, expired or unavailable.

    clusters: fire_id, n, total_frp, last_s; threats: fire_id, asset_id, ring, distance_km, in_corridor; spread: fire_id,
    valid_s. Fires without threats or spread keep their row.
    """
    t = threats.groupBy("fire_id").agg(F.count("*").alias("threats"), F.count_if(F.col("in_corridor")).alias("in_corridor"), F.min(F.struct("distance_km", "asset_id")).alias("m"))
    s = spread.groupBy("fire_id").agg(F.max("valid_s").alias("valid_s"))
    out = clusters.join(t, "fire_id", "left").join(s, "fire_id", "left")
    status = F.when(F.col("valid_s").isNull(), "unavailable").when(F.col("valid_s") > now_s, "future").otherwise("expired")
    return out.select("fire_id", "n", "total_frp", (F.lit(now_s) - F.col("last_s")).alias("age_s"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("threats", "in_corridor")], F.col("m.asset_id").alias("nearest_asset"), F.col("m.distance_km").alias("nearest_km"), status.alias("spread_status"))


def facts(packets: DataFrame) -> DataFrame:
    """packets with text: one sentence for each known fact, none for the unknown."""
    return packets.withColumn("text", F.concat_ws(" ", F.format_string("%d detections.", "n"), F.when(F.col("total_frp").isNotNull(), F.format_string("%.1f MW in all.", "total_frp")), F.when(F.col("threats") > 0, F.format_string("%d assets near, %d in the path.", "threats", "in_corridor")), F.when(F.col("spread_status") == "expired", F.lit("The forecast has expired."))))
