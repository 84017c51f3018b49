"""What a mobile network's cells reach, assembled: footprints, people alerted without need, and what could not be judged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberglass.functions.geo import haversine_km
from emberglass.operators import audits, routes, spatial
from emberglass.storage import Scratch


def survey_scope(region: dict[str, float]) -> str:
    """What a low count of cells means."""
    south, west, north, east = (f"{region[c]:.3f}" for c in ("south", "west", "north", "east"))
    return f"Cells that stand between {south},{west} and {north},{east}. Those outside that reach in were not asked for: few cells here means few surveyed, not few that serve."


def _refuse(faults: DataFrame, what: str) -> None:
    some = [str(r[0]) for r in faults.limit(5).collect()]
    if some:
        raise ValueError(f"{what}: {', '.join(some)}")


def reach_answer(cells: DataFrame, settlements: DataFrame, threatened: DataFrame, region: dict[str, float], scratch: Scratch) -> dict[str, DataFrame]:
    """rows (sid, population, threatened, covering_cells, measured_cells, over_alerted), unusable (id, reason: cells without
    a footprint), unusable_settlements (sid, reason), unknown_population (sid), and summary, one row: cells, over_alerted,
    measured_fraction, scope. A settlement counts once, by however many cells it is covered; threatened or uncovered it
    counts 0, and null if its size is not known: the sum is a floor.

    cells: as of footprints(); settlements: sid, lat, lon, population (null or negative: unknown); threatened: sid. A figure
    is refused, by ValueError, where it would be zero for lack of anything to count: without settlements, with one named
    twice, with a threatened one that is not among them, or without a usable cell.
    """
    if settlements.isEmpty():
        raise ValueError("there are no settlements, so nothing can be said of them")
    faults = audits.known_once(settlements.select("sid"), settlements, "sid")
    _refuse(faults.select("sid"), "settlements come more than once")
    _refuse(threatened.select("sid").distinct().join(settlements, "sid", "left_anti").select("sid"), "threatened settlements are not among the settlements")
    served, refused = routes.footprints(cells)
    served, refused = scratch.save(served, "served"), scratch.save(refused, "refused")
    if served.isEmpty():
        raise ValueError("no cell is usable, so no footprint can be drawn")
    fault = F.when(F.col("lat").isNull() | F.col("lon").isNull(), "position is missing").when(F.isnan("lat") | F.isnan("lon") | (F.abs("lat") > 90) | (F.abs("lon") > 180), "position is no place")
    judged = settlements.withColumn("reason", fault)
    placed = judged.filter("reason is null").drop("reason")
    discs = served.select(F.col("lat").alias("dlat"), F.col("lon").alias("dlon"), (F.col("range_m") / 1000).alias("reach_km"), "range_m", "measured")
    km = haversine_km(F.col("lat"), F.col("lon"), F.col("dlat"), F.col("dlon"))
    met = spatial.within(placed.select("sid", "lat", "lon"), discs, km).filter(km * 1000 <= F.col("range_m"))
    per = met.groupBy("sid").agg(F.count("*").alias("covering_cells"), F.count_if("measured").alias("measured_cells"))
    hit = threatened.select("sid").distinct().withColumn("threatened", F.lit(True))
    rows = placed.select("sid", F.when(F.col("population") >= 0, F.col("population")).alias("population")).join(per, "sid", "left").join(hit, "sid", "left")
    none = F.lit(0).cast("long")
    rows = rows.withColumns({"threatened": F.coalesce("threatened", F.lit(False)), "covering_cells": F.coalesce("covering_cells", none), "measured_cells": F.coalesce("measured_cells", none)})
    rows = scratch.save(rows.withColumn("over_alerted", F.when(F.col("threatened") | (F.col("covering_cells") == 0), none).otherwise(F.col("population"))), "reach")
    unknown = rows.filter("over_alerted is null").select("sid")
    share = served.agg(F.count("*").alias("cells"), F.avg(F.col("measured").cast("double")).alias("measured_fraction"))
    total = rows.agg(F.coalesce(F.sum("over_alerted"), none).alias("over_alerted"))
    summary = share.crossJoin(total).select("cells", "over_alerted", "measured_fraction", F.lit(survey_scope(region)).alias("scope"))  # one row each
    return {"rows": rows, "unusable": refused, "unusable_settlements": judged.filter("reason is not null").select("sid", "reason"), "unknown_population": unknown, "summary": summary}
