"""What else a cursor may show beside detections: perimeters, spread, names; and picks of events. Times are in seconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberglass.operators.causal import snapshot


def visible_perimeters(perimeters: DataFrame, cursor_s: int) -> DataFrame:
    """Those whose later of computed_s and watermark_s has passed. What lacks either can't be shown to have been there."""
    known = F.col("computed_s").isNotNull() & F.col("watermark_s").isNotNull()
    return perimeters.filter(known & (F.greatest("computed_s", "watermark_s") <= cursor_s))


def visible_spread(spread: DataFrame, cursor_s: int) -> DataFrame:
    """Steps (issued_s, valid_s, horizon_h) issued by the cursor: a present one (horizon 0) must be valid by then, a
    later one not before its issue."""
    h = F.col("horizon_h").cast("double")
    finite = h.isNotNull() & ~F.isnan(h) & (h >= 0) & (h < float("inf"))
    in_time = F.when(h == 0, F.col("valid_s") <= cursor_s).otherwise(F.col("valid_s") >= F.col("issued_s"))
    return spread.filter((F.col("issued_s") <= cursor_s) & F.col("valid_s").isNotNull() & finite & in_time)


def with_names(clusters: DataFrame, labels: DataFrame) -> DataFrame:
    """clusters with name and label of labels (cluster_id, name, label; of several the least name). Names are labels of
    the source and not evidence, so they may come from any time; a cluster without one stays."""
    one = labels.groupBy("cluster_id").agg(F.min(F.struct("name", "label")).alias("l"))
    return clusters.join(one, "cluster_id", "left").select(*clusters.columns, F.col("l.name").alias("name"), F.col("l.label").alias("label"))


def causal_response(det: DataFrame, perimeters: DataFrame, spread: DataFrame, labels: DataFrame, cursor_s: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(clusters rebuilt from the detections at hand, perimeters, spread) as they could be known at the cursor."""
    return with_names(snapshot(det, cursor_s), labels), visible_perimeters(perimeters, cursor_s), visible_spread(spread, cursor_s)


def future_steps(spread: DataFrame, clock: Column) -> DataFrame:
    """Steps that lie ahead of the evidence: horizon above 0, a ring of four points or more, valid after clock."""
    return spread.filter((F.col("horizon_h") > 0) & (F.size("ring") >= 4) & (F.col("valid_s") > clock))


def any_observed(det: DataFrame, cursor_s: int) -> DataFrame:
    """One row: whether any detection had been delivered by the cursor."""
    return det.agg(F.coalesce(F.bool_or(F.col("available_s") <= cursor_s), F.lit(False)).alias("observed"))


def detections_of(det: DataFrame, clusters: DataFrame) -> DataFrame:
    """(cluster_id, id) of each cluster's detections: those that name it or, where none does, those that it lists.

    clusters: cluster_id, hotspot_ids (array)."""
    own = det.join(clusters.select("cluster_id"), "cluster_id").select("cluster_id", "id")
    rest = clusters.join(own, "cluster_id", "left_anti").select("cluster_id", F.explode("hotspot_ids").alias("id"))
    return own.union(rest.join(det.select("id"), "id").select("cluster_id", "id"))


def pick_event(events: DataFrame, start_s: int, end_s: int) -> DataFrame:
    """The event (ord, first_s, last_s, detections, ...) with most detections among those that overlap the window, among
    all if none does; the first in order on ties. No event gives no row."""
    overlaps = F.coalesce((F.col("first_s") <= end_s) & (F.col("last_s") >= start_s), F.lit(False))
    best = events.agg(F.max(F.struct(overlaps.alias("o"), F.col("detections").alias("d"), (-F.col("ord")).alias("k"), F.struct("*").alias("row"))).alias("b"))
    return best.filter("b is not null").select("b.row.*")


def event_order(events: DataFrame) -> DataFrame:
    return events.orderBy(F.desc("detections"), "ord")
