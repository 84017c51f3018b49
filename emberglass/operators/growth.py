"""Where detections move to: weighted centroids and motion between the halves of an evidence window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberglass.functions.geo import bearing_deg, haversine_km


def weight() -> Column:
    """Radiative power where it is above 0, else 1: a missing measurement weighs as one."""
    return F.when(F.col("frp") > 0, F.col("frp")).otherwise(1.0)


def weighted_centroid(det: DataFrame, keys: list[str]) -> DataFrame:
    w = weight()
    return det.groupBy(*keys).agg(*[(F.sum(w * F.col(c)) / F.sum(w)).alias(name) for c, name in (("lat", "lat"), ("lon", "lon"), ("at_s", "mean_s"))])


def source_mix(det: DataFrame) -> DataFrame:
    n = det.groupBy("cluster_id", F.coalesce("source", F.lit("unknown")).alias("source")).agg(F.count("*").alias("n"))
    return n.groupBy("cluster_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "n")))).alias("source_mix"))


def hours_since_last(det: DataFrame, now_s: int) -> DataFrame:
    return det.groupBy("cluster_id").agg(F.greatest(F.lit(0.0), (F.lit(now_s) - F.max("at_s")) / 3600).alias("hours"))


def observed(det: DataFrame, now_s: int, window_s: int = 21600, least: int = 4, least_span_s: int = 1800, least_km: float = 0.1) -> DataFrame:
    """Bearing and rate of each cluster's centroid from the earlier to the later half (by time) of its evidence.

    Null if the centroids are nearer than least_km or their times than least_span_s; clusters of fewer than least
    detections, or of a shorter span, are left out. Two aggregations: the halves meet in one row without a join.
    """
    e = det.filter(F.col("at_s").between(now_s - window_s, now_s))
    span = e.groupBy("cluster_id").agg(F.min("at_s").alias("a"), F.max("at_s").alias("b"), F.count("*").alias("detections"))
    e = e.join(span, "cluster_id").withColumn("early", F.col("at_s") <= (F.col("a") + F.col("b")) / 2)
    w = weight()

    def mean(c: str, early: bool) -> Column:
        part = F.when(F.col("early") == early, w)
        return F.sum(part * F.col(c)) / F.sum(part)

    halves = e.groupBy("cluster_id").agg(F.first("detections").alias("detections"), F.first(F.col("b") - F.col("a")).alias("span"), *[mean(c, k).alias(f"{c}{int(k)}") for c in ("lat", "lon", "at_s") for k in (True, False)])
    at = [F.col(c) for c in ("lat1", "lon1", "lat0", "lon0")]
    km, hours = haversine_km(*at), (F.col("at_s0") - F.col("at_s1")) / 3600
    moved = (km >= least_km) & (hours >= least_span_s / 3600)
    return halves.filter((F.col("detections") >= least) & (F.col("span") >= least_span_s)).select("cluster_id", "detections", F.when(moved, bearing_deg(*at)).alias("bearing"), F.when(moved, km / hours).alias("rate_kmh"))


def motion(states: DataFrame, most_gap: float, least: int = 3) -> DataFrame:
    """states (fire, t in hours, ord, lat, lon) with bearing and rate_kmh from the state before; null for a first state, or
    if that one is of the same time or over most_gap hours ago. Fires of fewer than least dated states are left out."""
    w = Window.partitionBy("fire")
    o = w.orderBy("t", "ord")
    rows = states.filter("t is not null").withColumns({"n_": F.count("*").over(w), "t_": F.lag("t").over(o), "lat_": F.lag("lat").over(o), "lon_": F.lag("lon").over(o)})
    dt = F.col("t") - F.col("t_")
    at = [F.col(c) for c in ("lat_", "lon_", "lat", "lon")]
    ok = (dt > 0) & (dt <= most_gap)
    return rows.filter(F.col("n_") >= least).select(*states.columns, F.when(ok, bearing_deg(*at)).alias("bearing"), F.when(ok, haversine_km(*at) / dt).alias("rate_kmh"))


def baselines(vectors: DataFrame, corpus_rate_kmh: float) -> DataFrame:
    """Three predictors per cluster: as observed, persistence, and persistence of bearing at the corpus' mean rate."""
    kinds = F.explode(F.array(*[F.lit(k) for k in ("observed", "persistence", "constant_rate")]))
    rows = vectors.withColumn("predictor", kinds)
    return rows.withColumn("rate_kmh", F.when(F.col("predictor") == "constant_rate", F.lit(corpus_rate_kmh)).otherwise(F.col("rate_kmh")))
