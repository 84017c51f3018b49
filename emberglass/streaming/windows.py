"""Windows and state over detections as they arrive. The same functions take a batch and a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_event_time(det: DataFrame, lateness: str = "6 hours") -> DataFrame:
    """Adds event_time; of a stream, rows later than the slowest source's latency are let go."""
    out = det.withColumn("event_time", F.timestamp_seconds("at_s"))
    return out.withWatermark("event_time", lateness) if det.isStreaming else out


def sessions(det: DataFrame, gap_s: int) -> DataFrame:
    """Per cluster, runs of detections that no gap of more than gap_s parts."""
    rows = with_event_time(det)
    s = rows.groupBy(F.session_window("event_time", f"{gap_s} seconds"), "cluster_id").agg(F.min("at_s").alias("start_s"), F.max("at_s").alias("end_s"), F.count("*").alias("n"))
    return s.select("cluster_id", "start_s", "end_s", "n")


def tumbling(det: DataFrame, width: str = "30 minutes", slide: str | None = None) -> DataFrame:
    rows = with_event_time(det)
    w = F.window("event_time", width, slide) if slide else F.window("event_time", width)
    b = rows.groupBy(w.alias("w"), "cluster_id").agg(F.count("*").alias("n"), F.sum("frp").alias("total_frp"))
    return b.select("cluster_id", F.unix_seconds("w.start").alias("bin_s"), "n", "total_frp")


def record(stream: DataFrame, path: str, checkpoint: str):
    """Appends each micro-batch as a frame with the batch's number; a batch that runs again replaces its own frame."""

    def frame(batch: DataFrame, n: int) -> None:
        batch.withColumn("frame", F.lit(n)).write.mode("overwrite").parquet(f"{path}/batch={n}")

    return stream.writeStream.foreachBatch(frame).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
