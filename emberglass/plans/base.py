"""Registration of queries, and the adapter that lets the driver's events play detections."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: 2024-01-01T00:00:00Z, the origin of cursors in seconds.
ORIGIN_S = 1704067200

DET_SQL = f"""det AS (SELECT event_id AS id, user_id AS cluster_id, ts AS observed_at,
  CASE event_type WHEN 'click' THEN 'MTG_I1' WHEN 'view' THEN 'VIIRS_SNPP_NRT' WHEN 'purchase' THEN 'MODIS_NRT'
                  WHEN 'signup' THEN 'SENTINEL_3A' ELSE 'UNKNOWN_SRC' END AS source,
  CASE WHEN value < 5 THEN NULL ELSE value END AS frp,
  37e0 + (user_id % 50) / 500e0 AS lat, -2e0 + (event_id % 97) / 485e0 AS lon,
  CAST(floor((epoch_us(ts) - {ORIGIN_S}000000) / 1000000) AS BIGINT) AS at_s FROM events),
lat AS (SELECT *, CASE source WHEN 'MTG_I1' THEN 1020 WHEN 'SENTINEL_3A' THEN 21600 ELSE 10800 END AS latency_s FROM det),
vis AS (SELECT *, at_s + latency_s AS available_s FROM lat)"""


class Tables:
    """table(name) is a driver table, table.stream(name) the stream of its files."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def stream(self, name: str) -> DataFrame:
        return self.spark.readStream.schema(self(name).schema).parquet(f"{self.sf_dir}/{name}.parquet*")


class Book:
    """Queries by name with their DuckDB SQL."""

    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None, det: bool = False):
        """Registers a function (spark, table) -> DataFrame under its name; table(name) reads a driver table."""

        def register(f):
            name = f.__name__
            self.queries[name] = lambda spark, sf_dir: f(spark, Tables(spark, sf_dir))
            if sql:
                text = sql.strip()
                self.sql[name] = (f"WITH {DET_SQL}, {text[5:]}" if text[:5].upper() == "WITH " else f"WITH {DET_SQL} {text}") if det else text
            return f

        return register


def detections(table) -> DataFrame:
    """Events as detections: id, cluster_id, at_s, source, frp, lat, lon, latency_s, available_s."""
    from emberglass.operators.causal import with_availability

    ev = table("events")
    source = F.when(F.col("event_type") == "click", "MTG_I1").when(F.col("event_type") == "view", "VIIRS_SNPP_NRT").when(F.col("event_type") == "purchase", "MODIS_NRT").when(F.col("event_type") == "signup", "SENTINEL_3A").otherwise("UNKNOWN_SRC")
    at = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).cast("long") - ORIGIN_S
    det = ev.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("cluster_id"), at.alias("at_s"), source.alias("source"),
        F.when(F.col("value") >= 5, F.col("value")).alias("frp"),
        (F.lit(37.0) + F.col("user_id") % 50 / F.lit(500.0)).alias("lat"), (F.lit(-2.0) + F.col("event_id") % 97 / F.lit(485.0)).alias("lon"),
    )
    return with_availability(det)
