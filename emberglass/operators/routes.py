"""From departures to what is said of a route: ways, bands, clearance, choice, names, areas, and the cells that serve it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberglass.constants import CAPACITY_VPH, DEFAULT_CAPACITY_VPH, PROFILES, lookup
from emberglass.operators.alerts import resolve
from emberglass.operators.egress import latest_departure, route

#: Roads that lead through; a placeholder's half width in degrees; a range that stands for one that was not measured.
THROUGH, BOX_DEG, FALLBACK_RANGE_M = ("motorway", "trunk", "primary", "secondary", "tertiary", "unclassified"), 0.004, 1000.0
INF = float("inf")


def routes(graph: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, source, depart_s, km, spare_s, edges): the shortest way in time from each source at its latest departure.

    graph: keys, kind (edge, source, destination), edge, src, dst, travel_s, metres, cut_s. A source stands in src, a
    destination in dst with its cut_s. Unbounded times are null; a source without a way has no row. Each group is one
    solve: profiles, configurations and destinations are separate groups.
    """
    schema = ", ".join(f"{k} {graph.schema[k].dataType.simpleString()}" for k in keys) + ", source long, depart_s double, km double, spare_s double, edges array<long>"

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        road, ends = pdf[pdf["kind"] == "edge"], pdf[pdf["kind"] == "destination"]
        rows = list(zip(road["edge"].astype("int64"), road["src"].astype("int64"), road["dst"].astype("int64"), road["travel_s"].astype(float), road["metres"].astype(float)))
        cut = {int(e): float(c) for e, c in zip(road["edge"], road["cut_s"]) if pd.notna(c)}
        seeds = {int(d): (float(c) if pd.notna(c) else INF) for d, c in zip(ends["dst"], ends["cut_s"])}
        best = latest_departure([r[:4] for r in rows], cut, seeds)
        out = []
        for s in sorted({int(x) for x in pdf.loc[pdf["kind"] == "source", "src"]}):
            leave = best if best.get(s) != INF else {n: (0.0 if n == s else g) for n, g in best.items()}  # no bound: any time will do
            found = route(rows, cut, leave, s, set(seeds))
            if found:
                way, metres, spare = found
                out.append({**{k: pdf[k].iloc[0] for k in keys}, "source": s, "depart_s": None if best[s] == INF else best[s], "km": metres / 1000, "spare_s": None if spare == INF else spare, "edges": way})
        return pd.DataFrame(out, columns=[*keys, "source", "depart_s", "km", "spare_s", "edges"])

    return graph.groupBy(*keys).applyInPandas(solve, schema)


def bands(departures: DataFrame, window_end_s: int) -> DataFrame:
    """(route, earliest_s, earliest_combo, latest_s, latest_combo, combos) over whole solves (route, ord, combo, depart_s;
    null is unbounded): an unbounded earliest is the window's end, an unbounded latest is null; first in order on ties."""
    d = F.coalesce("depart_s", F.lit(INF))
    lo, hi = F.min(F.struct(d.alias("d"), "ord", "combo")), F.min(F.struct((-d).alias("d"), "ord", "combo"))
    g = departures.groupBy("route").agg(lo.alias("lo"), hi.alias("hi"), F.count("*").alias("combos"))
    late = -F.col("hi.d")
    return g.select("route", F.least(F.col("lo.d"), F.lit(float(window_end_s))).alias("earliest_s"), F.col("lo.combo").alias("earliest_combo"), F.when(late < INF, late).alias("latest_s"), F.col("hi.combo").alias("latest_combo"), "combos")


def clearance_range(route_edges: DataFrame, populations: DataFrame) -> DataFrame:
    """(route, worst_min, best_min, worst_profile, best_profile, edge): minutes until a route's people are through its
    tightest road, by profile. route_edges: route, ord, edge, highway; populations: route, population (null: unknown,
    no row; 0: 0 minutes). The edge is the worst profile's."""
    # who has people meets his roads by capacity: the tightest holds up most, but of no people the first road counts
    n = int(route_edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    people = populations.filter("population is not null").repartition(n, "route").groupBy("route").agg(F.max("population").alias("population"))
    capacity = lookup(CAPACITY_VPH, F.col("highway"), DEFAULT_CAPACITY_VPH).cast("double")
    roads = route_edges.select("route", "ord", "edge", capacity.alias("capacity")).repartition(n, "route").join(people, "route")
    tight = F.when(F.col("population") > 0, F.col("capacity")).when(F.col("population") < 0, -F.col("capacity")).otherwise(0.0)
    # numbers alone are aggregated, by hashing: structs would be sorted, all of a task's rows at once
    by = roads.groupBy("route", "population", tight.alias("tight"), "ord").agg(F.max("edge").alias("edge"))
    by = by.groupBy("route", "population", "tight").agg(F.min_by("edge", "ord").alias("edge"))
    by = by.groupBy("route", "population").agg(F.min("tight").alias("tight"), F.min_by("edge", "tight").alias("edge"))
    minutes = []
    for k, (profile, mobile, _, occupancy, _, scale) in enumerate(PROFILES):
        cars = F.col("population") * mobile / occupancy / scale
        m = cars / F.when(F.col("tight") == 0, 1.0).otherwise(F.abs("tight")) * 60
        minutes.append((m, F.lit(k), F.lit(profile)))
    worst = F.array_max(F.array(*[F.struct(m.alias("m"), (-k).alias("k"), p.alias("profile")) for m, k, p in minutes])).alias("w")
    best = F.array_min(F.array(*[F.struct(m.alias("m"), k.alias("k"), p.alias("profile")) for m, k, p in minutes])).alias("b")
    return by.select("route", "edge", worst, best).select("route", F.round("w.m", 1).alias("worst_min"), F.round("b.m", 1).alias("best_min"), F.col("w.profile").alias("worst_profile"), F.col("b.profile").alias("best_profile"), "edge")


def chosen(gated: DataFrame, by: str) -> DataFrame:
    """Of each group's usable routes that with the latest earliest departure; the first by destination on ties."""
    w = Window.partitionBy(by).orderBy(F.desc("earliest_s"), "destination")
    return gated.filter("usable").withColumn("nth_", F.row_number().over(w)).filter("nth_ = 1").drop("nth_")


def threatened(settlements: DataFrame, nearest: DataFrame, node_cuts: DataFrame) -> DataFrame:
    """(sid, cut_s) of settlements whose nearest node is cut in the nominal configuration. nearest: sid, node."""
    return settlements.join(nearest, "sid").join(node_cuts, "node").filter("cut_s is not null").select("sid", "cut_s")


def road_name(route_edges: DataFrame) -> DataFrame:
    """(route, name): a route's first named road that leads through, else its first named one, else the empty text.
    route_edges: route, ord, name, highway."""
    named = F.col("name").isNotNull() & (F.col("name") != "")
    first = F.min(F.when(named, F.struct((~F.coalesce(F.col("highway").isin(*THROUGH), F.lit(False))).alias("last"), "ord", "name")))
    return route_edges.groupBy("route").agg(first.alias("f")).select("route", F.coalesce("f.name", F.lit("")).alias("name"))


def settlement_area(outline: Column, lat: Column, lon: Column) -> Column:
    """The outline if it has four points, else a closed box about the place, as a placeholder."""
    p = lambda a, b: F.struct((lat + a).alias("lat"), (lon + b).alias("lon"))
    d = BOX_DEG
    return F.when(F.size(outline) >= 4, outline).otherwise(F.array(p(-d, -d), p(-d, d), p(d, d), p(d, -d), p(-d, -d)))


def severity(reaches: Column) -> Column:
    """Of the hazard, not of our knowledge; where it isn't known whether the fire reaches, it does."""
    return F.when(F.coalesce(reaches, F.lit(True)), "Extreme").otherwise("Severe")


def verified(names: DataFrame, places: DataFrame, ways: DataFrame, route_edges: DataFrame) -> DataFrame:
    """(sentence, reason, name): why a sentence can't be said, and its first name at fault; null if it can.

    names: sentence, ord, name; ways: id, name, edge; route_edges: sentence, edge. A name must be that of a place or way
    (unresolved_name), and a way must be on the sentence's route if it has one (not_passable). Unresolved ones come first.
    """
    found = resolve(names.select("name").distinct().withColumn("cid", F.monotonically_increasing_id()), places, ways.select("id", "name")).select("name", "kind")
    key = F.lower(F.trim("name"))
    on = route_edges.join(ways.select("edge", key.alias("key")), "edge").select("sentence", "key").distinct().withColumn("on_route", F.lit(True))
    with_route = route_edges.select("sentence").distinct().withColumn("routed", F.lit(True))
    j = names.withColumn("key", key).join(found, "name", "left").join(on, ["sentence", "key"], "left").join(with_route, "sentence", "left")
    rank = F.when(F.col("kind").isNull(), 0).when((F.col("kind") == "way") & F.col("routed") & F.col("on_route").isNull(), 1)
    worst = F.min(F.when(rank.isNotNull(), F.struct(rank.alias("rank"), "ord", "name")))
    g = j.groupBy("sentence").agg(worst.alias("w"))
    return g.select("sentence", F.when(F.col("w.rank") == 0, "unresolved_name").when(F.col("w.rank") == 1, "not_passable").alias("reason"), F.col("w.name").alias("name"))


def footprints(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(served: id, lat, lon, range_m, measured; refused: id, reason) from cells (ord, mcc, mnc, lac, cellid, lat, lon,
    range_m). A cell without any network number is told by its place in the table."""
    raw = F.concat_ws("-", *[F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in ("mcc", "mnc", "lac", "cellid")])
    ident = F.when(raw == "?-?-?-?", F.concat(raw, F.lit("#"), F.col("ord").cast("string"))).otherwise(raw)
    finite = lambda c: ~F.isnan(c) & (F.abs(F.col(c)) < INF)
    fault = (
        F.when(F.col("lat").isNull() | F.col("lon").isNull(), "position is missing")
        .when(~finite("lat") | ~finite("lon"), "position is not finite")
        .when(~F.coalesce(finite("range_m") & (F.col("range_m") > 0), F.lit(False)), "range is not a positive number")
    )
    rows = cells.withColumns({"id": ident, "reason": fault})
    served = rows.filter("reason is null").select("id", "lat", "lon", "range_m", (F.col("range_m") != FALLBACK_RANGE_M).alias("measured"))
    return served, rows.filter("reason is not null").select("id", "reason")


def reach_totals(per_cell: DataFrame) -> DataFrame:
    """One row: people alerted without need (unknown counts as none), and the share of cells with a measured range."""
    return per_cell.agg(F.coalesce(F.sum("over_alerted"), F.lit(0)).alias("over_alerted"), F.avg(F.col("measured").cast("double")).alias("measured_fraction"))


def building_counts(settlements: DataFrame, pockets: DataFrame) -> DataFrame:
    """settlements (sid, buildings, ...) with the surveyed count of pockets (sid, buildings) where there is one."""
    p = pockets.groupBy("sid").agg(F.max("buildings").alias("surveyed"))
    return settlements.join(p, "sid", "left").withColumn("buildings", F.coalesce("surveyed", "buildings")).drop("surveyed")
