"""Latest departures on a road graph that fire cuts in time, routes, bands and the gate.

A departure is found by a max-min search from the destinations backwards. Searches for different profiles, configurations
and destinations are lanes of one table: they take their steps together, over one table of edges.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberglass.constants import CAPACITY_VPH, DEFAULT_CAPACITY_VPH, GATE_DELAY_S, SPEED_KMH, lookup
from emberglass.operators.components import connected_components
from emberglass.operators.spatial import in_chunks
from emberglass.storage import Scratch

INF = float("inf")


def latest_departure(edges: list[tuple], cut: dict, seeds: dict) -> dict:
    """{node: latest second at which one may leave it and still arrive}, for nodes from which one can.

    edges: (id, from, to, travel_s); cut: {edge id: second from which it can't be used}; seeds: {destination: second
    until which one may arrive}, infinite if it is never cut.
    """
    into: dict = {}
    for e, a, b, s in edges:
        into.setdefault(b, []).append((e, a, s))
    best = dict(seeds)
    heap = [(-g, n) for n, g in seeds.items()]
    heapq.heapify(heap)
    done = set()
    while heap:
        g, n = heapq.heappop(heap)
        if n in done:
            continue
        done.add(n)
        for e, a, s in into.get(n, []):
            leave = min(cut.get(e, INF), -g) - s
            if a not in done and leave > best.get(a, -INF):
                best[a] = leave
                heapq.heappush(heap, (-leave, a))
    return best


def route(edges: list[tuple], cut: dict, departure: dict, source, destinations: set) -> tuple[list, float, float] | None:
    """(edge ids, metres, least seconds to spare) of the shortest way that leaves source at its latest departure and is
    in time everywhere. edges: (id, from, to, travel_s, metres)."""
    if source not in departure:
        return None
    out: dict = {}
    for e, a, b, s, m in edges:
        out.setdefault(a, []).append((e, b, s, m))
    heap, done, came = [(0.0, source, departure[source], INF, None, None)], set(), {}
    while heap:
        m, n, t, spare, before, e = heapq.heappop(heap)
        if n in done:
            continue
        done.add(n)
        came[n] = (before, e)
        if n in destinations and n != source:
            way = []
            while came[n][1] is not None:
                n, e = came[n]
                way.append(e)
            return way[::-1], m, spare
        for e, b, s, length in out.get(n, []):
            until = cut.get(e, INF)
            if b not in done and b in departure and t + s <= min(until, departure[b]):
                heapq.heappush(heap, (m + length, b, t + s, min(spare, until - t), n, e))
    return None


#: Hops that one written round of a search takes.
HOPS = 8


def relaxed(edges: DataFrame, seeds: DataFrame, scratch: Scratch, on: list[str], lane: list[str], values: dict[str, tuple[Column, Column]], max_rounds: int = 100_000) -> DataFrame:
    """(on, lane, node, values): the latest second at which one may leave a node and still be in time, for every lane, in
    a column for each of values; null: one can't.

    edges: on, src, dst, and what values are made of: for each an until (the second from which an edge can't be used, null
    if never) and a travel (seconds, not negative). Both may also use the lane's columns, so one table of edges serves all
    profiles and configurations. seeds: on, lane, node, values (infinite: never cut), the destinations.

    A label-correcting search over all lanes at once. A hop joins the nodes' values with the edges that arrive there and
    keeps the greatest offer by lane and node; a node whose values have not risen offers nothing but them, by a loop of
    its own, so old values and new offers meet in one aggregate. HOPS of them are one job; its result is written, and the
    search ends when nothing rose in its last hop. A hop moves its rows once, by node: the offers of parallel edges become
    one before that, and the aggregate leaves its rows where the next join takes them. Several values in a row save
    the moving of names and keys. A node with many ways in is one task's, which streams them.
    """
    names = list(values)
    loops = edges.select(*on, F.explode(F.array("src", "dst")).alias("node")).union(seeds.select(*on, "node")).distinct()
    ways = edges.withColumn("loop", F.lit(False)).unionByName(loops.select(*on, F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(True).alias("loop")), allowMissingColumns=True)
    parts, at = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), [*on, "node"]
    ways = scratch.save(ways.withColumnRenamed("dst", "node"), "ways").repartition(parts, *at)
    now = seeds.groupBy(*on, *lane, "node").agg(*[F.max(g).alias(g) for g in names]).withColumn("fresh", F.lit(True))
    seen = None
    for _ in range(max_rounds):
        now = now.repartition(parts, *at)
        for _ in range(HOPS):
            met = now.join(ways, at).filter(F.col("loop") | F.col("fresh"))
            offers = [F.when(F.col("loop"), F.col(g)).when(F.col(g).isNotNull(), F.least(until, g) - travel).alias(g) for g, (until, travel) in values.items()]
            met = met.select(*on, *lane, "node", "src", "loop", *offers)
            met = met.groupBy(*on, *lane, "node", "src", "loop").agg(*[F.max(g).alias(g) for g in names])
            met = met.drop("node").withColumnRenamed("src", "node").repartition(parts, *at)
            best = met.groupBy(*on, *lane, "node").agg(*[F.max(g).alias(g) for g in names], *[F.max(F.when(F.col("loop"), F.col(g))).alias(f"own_{g}") for g in names])
            rose = F.lit(False)
            for g in names:
                rose = rose | F.coalesce(F.col(g) > F.coalesce(F.col(f"own_{g}"), F.lit(-INF)), F.lit(False))
            now = best.select(*on, *lane, "node", *names, rose.alias("fresh"))
        now = scratch.save(now, "values")
        if seen is not None:
            scratch.drop(seen)
        seen = now
        if now.filter("fresh").isEmpty():
            return now.drop("fresh")
    raise RuntimeError(f"values still rise after {max_rounds * HOPS} hops")


def departures(edges: DataFrame, keys: list[str], scratch: Scratch) -> DataFrame:
    """(keys, node, depart_s) for edges (keys, edge, src, dst, travel_s, cut_s null if never, and the destinations as
    rows with edge null: dst, cut_s). A departure without any bound is null. Each group of keys is a graph of its own;
    all are searched together."""
    never = F.lit(INF)
    ends = edges.filter("edge is null").select(*keys, F.col("dst").alias("node"), F.coalesce("cut_s", never).cast("double").alias("depart_s"))
    roads = edges.filter("edge is not null").select(*keys, "src", "dst", "travel_s", "cut_s")
    found = relaxed(roads, ends, scratch, keys, [], {"depart_s": (F.col("cut_s"), F.col("travel_s"))})
    return found.filter("depart_s is not null").select(*keys, "node", F.when(F.col("depart_s") < INF, F.col("depart_s")).alias("depart_s"))


#: Lanes that go in one row of a search.
WIDTH = 6


def spread(combos: list[tuple[str, str]]) -> tuple[list[str], list[str]]:
    """Names of profiles and of configurations, in the order of numbered()."""
    return sorted({p for p, _ in combos}), sorted({c for _, c in combos})


def numbered(edges: DataFrame, combos: list[tuple[str, str]]) -> DataFrame:
    """edges with the maps travel and cut as arrays of seconds, in the order of the names that combos have."""
    profiles, configs = spread(combos)
    travel = F.array(*[F.element_at("travel", F.lit(p)).cast("double") for p in profiles])
    return edges.withColumns({"travel": travel, "cut": F.array(*[F.try_element_at("cut", F.lit(c)).cast("double") for c in configs])})


def lanes_by_part(edges: DataFrame, ends: DataFrame, combos: list[tuple[str, str]], scratch: Scratch) -> DataFrame:
    """(destination, part, node, g_0, g_1, ...): departure_lanes() with WIDTH of combos (profile, config) in a row, in their
    order; null if one can't get there, infinite if unbounded. edges: src, dst, travel, cut, as numbered() gives them."""
    profiles, configs = spread(combos)
    parts = [combos[k : k + WIDTH] for k in range(0, len(combos), WIDTH)]
    pick = lambda array, places: F.get(F.col(array), F.get(F.array(*[F.lit(k).cast("int") for k in places]), F.col("part")))
    values, own = {}, []
    for i in range(len(parts[0])):
        mine = [part[i] if i < len(part) else None for part in parts]  # the last part may be short
        values[f"g_{i}"] = (pick("cut", [x and configs.index(x[1]) for x in mine]), pick("travel", [x and profiles.index(x[0]) for x in mine]))
        seconds = [F.coalesce(F.try_element_at("cut", F.lit(x[1])), F.lit(INF)).cast("double") if x else F.lit(None).cast("double") for x in mine]
        own.append(F.get(F.array(*seconds), F.col("part")).alias(f"g_{i}"))
    seeds = ends.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(len(parts) - 1)))).select("destination", "part", "node", *own)
    return relaxed(edges.select("src", "dst", "travel", "cut"), seeds, scratch, [], ["destination", "part"], values)


def in_rows(found: DataFrame, combos: list[tuple[str, str]]) -> DataFrame:
    """lanes_by_part() with rows (profile, config, ..., depart_s; null if unbounded) in place of its columns."""
    names = [c for c in found.columns if c.startswith("g_")]
    lit = F.array(*[F.struct(F.lit(p).alias("profile"), F.lit(c).alias("config")) for p, c in combos])
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(g).alias("g")) for i, g in enumerate(names)])).alias("l")
    rest = [c for c in found.columns if c not in names and c != "part"]
    rows = found.select(*rest, "part", each).filter("l.g is not null").withColumn("of", F.get(lit, F.col("part") * WIDTH + F.col("l.i")))
    return rows.select("of.profile", "of.config", *rest, F.when(F.col("l.g") < INF, F.col("l.g")).alias("depart_s"))


def departure_lanes(edges: DataFrame, ends: DataFrame, lanes: DataFrame, scratch: Scratch) -> DataFrame:
    """(profile, config, destination, node, depart_s; null if unbounded) for every lane and destination.

    edges: src, dst, travel (map of profile to seconds), cut (map of config to the second of the cut, no entry if none).
    ends: destination, node, cut (the node's own, likewise). lanes: profile, config, at least one; the driver names them.
    """
    combos = sorted((r["profile"], r["config"]) for r in lanes.select("profile", "config").distinct().collect())
    return in_rows(lanes_by_part(numbered(edges.select("src", "dst", "travel", "cut"), combos), ends, combos, scratch), combos)


def scaled_travel(travel_s: Column, highway: Column, scale: Column) -> Column:
    """Seconds at a profile's speed, 1 at least; classes without a speed keep theirs."""
    speed = lookup(SPEED_KMH, highway)
    swept = F.greatest(F.lit(1), F.round(speed * scale))
    return F.when(speed.isNull(), travel_s).otherwise(F.greatest(F.lit(1.0), F.round(travel_s * speed / swept)))


def bottleneck(route_edges: DataFrame, vehicles: str = "vehicles") -> DataFrame:
    """Per route the edge that takes longest to clear: minutes = vehicles / capacity * 60, ties to the first edge."""
    minutes = F.col(vehicles) / lookup(CAPACITY_VPH, F.col("highway"), DEFAULT_CAPACITY_VPH) * 60
    worst = F.max(F.struct(minutes.alias("m"), (-F.col("ord")).alias("o"), F.col("edge")))
    return route_edges.groupBy("route").agg(worst.alias("w")).select("route", F.col("w.edge").alias("edge"), F.col("w.m").alias("clearance_min"))


def gate(routes: DataFrame, cursor_s: int, observed: bool = True) -> DataFrame:
    """routes (route, earliest_s, latest_s, clearance_min) with usable and reason: the earliest departure less the
    slowest clearance and the longest delay must not be before the cursor. What is unknown blocks."""
    slack = F.col("earliest_s") - F.col("clearance_min") * 60 - GATE_DELAY_S
    reason = F.when(F.lit(not observed), "nothing observed yet").when(F.col("earliest_s").isNull(), "no way out").when(F.col("clearance_min").isNull(), "clearance unknown").when(slack < cursor_s, "too late").otherwise("open")
    return routes.withColumn("reason", reason).withColumn("usable", F.col("reason") == "open")


def verdict(gated: DataFrame, keys: list[str], observed: bool = True) -> DataFrame:
    v = F.when(F.lit(not observed), "not_yet_observed").when(F.bool_or("usable"), "routes_open").otherwise("no_verified_action")
    return gated.groupBy(*keys).agg(v.alias("verdict"))


def topology(edges: DataFrame, nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """One row: components, the largest one's nodes, and nodes without an edge (undirected)."""
    c = connected_components(edges, scratch)
    size = c.groupBy("component").agg(F.count("*").alias("n"))
    alone = nodes.join(c, nodes["node"] == c["node"], "left_anti").agg(F.count("*").alias("isolated"))
    return size.agg(F.count("*").alias("components"), F.max("n").alias("largest")).crossJoin(alone)  # one row each


def spots_of(points: DataFrame) -> DataFrame:
    """(id, x, y, n): the places of points (id, x, y), each with the least id there and how many there are."""
    return points.filter("abs(x) < double('infinity') and abs(y) < double('infinity')").groupBy("x", "y").agg(F.min("id").alias("id"), F.count("*").alias("n"))


def _near(spots: DataFrame, eps: float) -> DataFrame:
    """(src, dst), src < dst, of spots (id, x, y) within eps, by grid cells of that size."""
    cell = lambda c: F.floor(F.col(c) / eps).cast("long")
    a = spots.select(F.col("id").alias("src"), F.col("x").alias("ax"), F.col("y").alias("ay"), cell("x").alias("r"), cell("y").alias("c"))
    o = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    b = spots.withColumn("o", o).select(F.col("id").alias("dst"), F.col("x").alias("bx"), F.col("y").alias("by"), (cell("x") + F.col("o.i")).alias("r"), (cell("y") + F.col("o.j")).alias("c"))
    # the join makes far more rows than it reads, so its partitions must not be merged for the little they read
    n = int(spots.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = a.repartition(n, "r", "c").join(b.repartition(n, "r", "c"), ["r", "c"])
    return met.filter((F.col("src") < F.col("dst")) & (F.pow(F.col("ax") - F.col("bx"), 2) + F.pow(F.col("ay") - F.col("by"), 2) <= eps * eps)).select("src", "dst")


def epsilon_links(points: DataFrame, eps: float) -> DataFrame:
    """(src, dst), src < dst, of points (id, x, y) within eps. Places meet; their pairs are dealt out anew, then expanded."""
    spots = spots_of(points)
    members = in_chunks(points, ["x", "y"], "id").join(spots.select("x", "y", F.col("id").alias("spot")), ["x", "y"]).select("spot", "ids")
    pairs = _near(spots, eps).union(spots.select("id", "id"))
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = pairs.join(members.select(F.col("spot").alias("src"), F.col("ids").alias("of_src")), "src")
    met = met.repartition(n, "dst").join(members.select(F.col("spot").alias("dst"), F.col("ids").alias("of_dst")).repartition(n, "dst"), "dst")
    each = met.select((F.col("src") == F.col("dst")).alias("own"), F.explode("of_src").alias("a"), "of_dst").select("own", "a", F.explode("of_dst").alias("b"))
    each = each.filter(~F.col("own") | (F.col("a") < F.col("b")))
    return each.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))


def dbscan(points: DataFrame, eps: float, least: int, scratch: Scratch) -> DataFrame:
    """points (id, x, y) with kind (core, border, noise) and label: the least core of the cluster; a border point takes
    the least label of the cores in reach, noise -1. A point counts itself. Points at one place are one spot with their
    number: they share their kind and label."""
    spots = scratch.save(spots_of(points), "spots")
    links = scratch.save(_near(spots, eps), "links")
    both = links.union(links.select("dst", "src")).toDF("id", "other")
    around = both.join(spots.select(F.col("id").alias("other"), "n"), "other").groupBy("id").agg(F.sum("n").alias("around"))
    core = scratch.save(spots.join(around, "id", "left").filter(F.col("n") + F.coalesce("around", F.lit(0)) >= least).select("id"), "core")
    inner = links.join(core.select(F.col("id").alias("src")), "src").join(core.select(F.col("id").alias("dst")), "dst")
    label = core.join(connected_components(inner, scratch), F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("label"))
    border = both.join(label.select(F.col("id").alias("other"), "label"), "other").groupBy("id").agg(F.min("label").alias("near"))
    told = spots.join(label, "id", "left").join(border, "id", "left").select("x", "y", "label", "near", F.lit(True).alias("known"))
    out = points.join(told, ["x", "y"], "left")
    alone = F.when(F.lit(least <= 1) & F.col("known").isNull(), F.col("id"))  # a point without a place reaches itself alone
    out = out.withColumn("label", F.coalesce("label", alone))
    kind = F.when(F.col("label").isNotNull(), "core").when(F.col("near").isNotNull(), "border").otherwise("noise")
    return out.select("id", kind.alias("kind"), F.coalesce("label", "near", F.lit(-1).cast("long")).alias("label"))
