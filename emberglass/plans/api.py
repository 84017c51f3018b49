"""What a caller asks for, one function each; all answer with DataFrames. at_s is the cursor in seconds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberglass.constants import sweep_configs
from emberglass.operators import alerts, causal, coverage, egress, evacuation, growth, messages, polygons, situation, spatial
from emberglass.storage import Scratch

MOST_S = 253402300799


def cursor(text: str | None) -> int | None:
    """A cursor of digits only, not beyond the year 9999."""
    if text is None:
        return None
    if not text.isascii() or not text.isdigit() or int(text) > MOST_S:
        raise ValueError("at must be whole seconds")
    return int(text)


def fires(det: DataFrame, at_s: int) -> dict[str, DataFrame]:
    """Clusters and detections as they could be known at the cursor, and the capture's timeline."""
    return {"clusters": causal.snapshot(det, at_s), "hotspots": det.filter(F.col("available_s") <= at_s), "timeline": causal.timeline(det)}


def growth_of(det: DataFrame, at_s: int, corpus_rate_kmh: float) -> DataFrame:
    """Observed motion and its two baselines."""
    return growth.baselines(growth.observed(det.filter(F.col("available_s") <= at_s), at_s), corpus_rate_kmh)


def situation_of(det: DataFrame, threats: DataFrame, spread: DataFrame, at_s: int) -> DataFrame:
    clusters = causal.snapshot(det, at_s).withColumnRenamed("cluster_id", "fire_id")
    return situation.facts(situation.packet(clusters, threats, spread, at_s))


def cuts_of(segments: DataFrame, det: DataFrame, heat: DataFrame | None = None) -> DataFrame:
    """The cut field of segments or nodes (seg_id, lat1, lon1, lat2, lon2) with the latency of each cut's first evidence.
    heat: rings of known sources, whose detections count in one configuration alone."""
    flagged = spatial.flag_heat(det, heat) if heat is not None else det.withColumn("static_heat", F.lit(False))
    near = spatial.near_segments(segments, flagged, 2000.0, carry=spatial.CARRIED)
    return evacuation.with_latency(spatial.cut_field(near, flagged, sweep_configs(det.sparkSession)), det)


def cut_segments(segments: DataFrame, det: DataFrame, at_s: int, heat: DataFrame | None = None) -> DataFrame:
    """Bands of the segments that are cut under any configuration, from detections delivered by the cursor."""
    return spatial.band(cuts_of(segments, det.filter(F.col("available_s") <= at_s), heat))


def evacuate(det: DataFrame, edges: DataFrame, nodes: DataFrame, places: DataFrame, pockets: DataFrame, at_s: int | None = None, heat: DataFrame | None = None) -> dict[str, DataFrame]:
    """Routes, verdicts and segments at the cursor (the window's end, an hour after the last detection, if none is given).

    edges: edge, src, dst, highway, metres, travel_s, lat1, lon1, lat2, lon2; nodes: node_id, lat, lon; places: sid, name,
    population, lat, lon, each put on its nearest node; pockets: sid. Cuts come from all detections and count once their
    first evidence could have been delivered.
    """
    scratch = Scratch(det.sparkSession, "evacuate")
    last, first_seen = det.agg(F.max("at_s"), F.min("available_s")).first()
    end = 0 if last is None else last + 3600
    cursor_s = end if at_s is None else at_s
    ends = ["lat1", "lon1", "lat2", "lon2"]
    cut = scratch.save(cuts_of(edges.select(F.col("edge").alias("seg_id"), *ends), det, heat), "cuts")
    points = nodes.select(F.col("node_id").alias("seg_id"), *[F.col(c[:3]).alias(c) for c in ends])
    burnt = scratch.save(cuts_of(points, det, heat), "burnt")
    near = spatial.nearest_node(places.select(F.col("sid").alias("point_id"), F.col("lat").alias("plat"), F.col("lon").alias("plon")), nodes, scratch)
    put = places.join(near.select(F.col("point_id").alias("sid"), F.col("node_id").alias("node")), "sid", "left").select("sid", "name", "population", "node")
    field = ["config", "cut_s", "latency_s"]
    observed = first_seen is not None and first_seen <= cursor_s
    routes, verdicts = evacuation.evacuation(edges, cut.select(F.col("seg_id").alias("edge"), *field), burnt.select(F.col("seg_id").alias("node"), *field), put, pockets, cursor_s, end, observed, scratch)
    return {"routes": routes, "verdicts": verdicts, "segments": evacuation.segments(edges, cut)}


def departures_of(edges: DataFrame, keys: list[str]) -> DataFrame:
    return egress.departures(edges, keys, Scratch(edges.sparkSession, "departures"))


def ledger(entries: DataFrame, limit: int | None) -> DataFrame:
    return entries.orderBy("seq") if limit is None else alerts.tail(entries, limit)


def threats_of(assets: DataFrame, lines: DataFrame, fires: DataFrame, perimeters: DataFrame, spread: DataFrame) -> DataFrame:
    """What each fire threatens, the most severe first."""
    found = polygons.threatened(assets, lines, fires, perimeters, spread, Scratch(assets.sparkSession, "threats"))
    rank = F.element_at(F.create_map(*[x for k, v in spatial.SEVERITY.items() for x in (F.lit(k), F.lit(v))]), F.col("ring"))
    return found.orderBy("fire_id", rank, "distance_km", "asset_id")


def reach_of(cells: DataFrame, settlements: DataFrame, threatened: DataFrame, region: dict[str, float]) -> dict[str, DataFrame]:
    return coverage.reach_answer(cells, settlements, threatened, region, Scratch(cells.sparkSession, "reach"))


def messages_of(answer: dict[str, DataFrame], places: DataFrame, ways: DataFrame, cursor_s: int, window_end_s: int, sent: str, inputs: dict) -> dict[str, DataFrame]:
    """Packages, rejected sentences, documents and ledger entries of an answer of evacuate(). places and ways: as of
    messages.recommended(); inputs: what the recommendation rests on, for its fingerprint."""
    rows = Scratch(places.sparkSession, "messages").save(messages.recommended(answer["routes"], answer["verdicts"], places, ways, cursor_s, window_end_s))
    packages, rejected = messages.spoken(rows, places, ways)
    return {"packages": packages, "rejected": rejected, "documents": messages.documents(packages, sent), "entries": messages.entries(rows, cursor_s, messages.fingerprint_of(inputs))}
