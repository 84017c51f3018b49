"""Ways out of places that a fire threatens, from the cut field to the verdict.

Every combination of profile and configuration is a lane: its departures are found together with all others'. A route's
band is the envelope of whole lanes, its way that of the first lane in order which has one, so a pessimistic profile comes
first. What is not known by the cursor does not count, and what is unknown blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberglass.constants import DEFAULT_LATENCY_S, GATE_DELAY_S, LATENCY_S, PROFILES, SWEEP, lookup
from emberglass.operators.causal import known_cut
from emberglass.operators.egress import HOPS, INF, WIDTH, in_rows, lanes_by_part, numbered, scaled_travel, spread
from emberglass.operators.routes import bands, clearance_range
from emberglass.storage import Scratch

#: Roads, worst last.
RANK = ["motorway", "motorway_link", "trunk", "trunk_link", "primary", "primary_link", "secondary", "secondary_link", "tertiary", "tertiary_link", "unclassified", "residential", "living_street", "service", "track", "road"]
NOMINAL_CONFIG = SWEEP[0][1]


def with_latency(cuts: DataFrame, det: DataFrame) -> DataFrame:
    """cuts (seg_id, evidence, ...), as of cut_field(), with latency_s: that of the first detection at the cut. It is the
    configuration's own: another may owe its cut to a slower sensor."""
    source = det.select(F.col("id").alias("_id"), F.col("source").alias("_source"))
    met = cuts.withColumn("_id", F.get("evidence", F.lit(0))).join(source, "_id", "left").drop("_id")
    return met.withColumn("latency_s", lookup(LATENCY_S, F.col("_source"), DEFAULT_LATENCY_S)).drop("_source")


def segments(edges: DataFrame, cuts: DataFrame) -> DataFrame:
    """(edge, cut_s, earliest_s, latest_s, basis, evidence) of every edge: when the nominal configuration cuts it, the band
    over those that do, and what says so. Nulls: not within the window. cuts: config_ord, config, seg_id, cut_s, evidence."""
    lo, hi = F.min(F.struct("cut_s", "config_ord", "config")), F.min(F.struct((-F.col("cut_s")).alias("cut_s"), F.col("config_ord"), F.col("config")))
    nominal = F.col("config") == NOMINAL_CONFIG
    g = cuts.groupBy(F.col("seg_id").alias("edge")).agg(lo.alias("lo"), hi.alias("hi"), F.count("*").alias("n"), F.max(F.when(nominal, F.col("cut_s"))).alias("cut_s"), F.first(F.when(nominal, F.col("evidence")), ignorenulls=True).alias("evidence"))
    basis = _basis(F.col("lo.config"), F.col("hi.config"), F.col("n"), F.lit(len(SWEEP)), "configurations", "never cut it")
    rows = g.select("edge", "cut_s", F.col("lo.cut_s").alias("earliest_s"), (-F.col("hi.cut_s")).alias("latest_s"), basis.alias("basis"), "evidence")
    return edges.select("edge").join(rows, "edge", "left")


def _basis(lo: Column, hi: Column, n: Column, total: Column, what: str, rest: str) -> Column:
    scope = F.when(n >= total, F.format_string(f"all %d {what}", total)).otherwise(F.format_string(f"%d of %d {what}; the other %d {rest}", n, total, total - n))
    return F.when(lo == hi, F.concat(F.lit("one value by "), lo, F.lit(", "), scope)).otherwise(F.concat(F.lit("earliest by "), lo, F.lit(", latest by "), hi, F.lit(", "), scope))


def _known(cuts: DataFrame, key: str, cursor_s: int) -> DataFrame:
    """(key, cut): of each edge or node the cuts known by the cursor, by configuration."""
    known = cuts.select(key, "config", known_cut(F.col("cut_s"), F.col("latency_s"), cursor_s).cast("double").alias("c")).filter("c is not null")
    return known.groupBy(key).agg(F.map_from_entries(F.collect_set(F.struct("config", "c"))).alias("cut"))  # twelve entries


def _place(names: list[str], name: Column) -> Column:
    """Where a name stands in a fixed list, from 0."""
    return (F.array_position(F.array(*[F.lit(x) for x in names]), name) - 1).cast("int")


def ways(found: DataFrame, combos: list[tuple[str, str]], edges: DataFrame, asked: DataFrame, scratch: Scratch, max_rounds: int = 100_000) -> DataFrame:
    """(route, ord, edge, spare_s): the edges, in order, of the shortest way of each route that leaves at its latest
    departure and is in time at every step; spare_s is the time between an edge's far end and its cut (null: never cut).

    asked: route, profile, config, destination, source, target, depart_s; found: as of lanes_by_part() of combos, the same
    lanes; edges: edge, src, dst, metres (above 0), travel and cut as there. Departures without a bound are null in asked:
    then only edges that are never cut are in time. Routes without a way have no rows.

    All routes are searched together. A hop offers each node's label to the ends of its edges and keeps the shortest by
    route and node; labels are made anew from those of the hop before, as a shorter way may arrive too late for what a
    longer one could still pass. What is longer than a route's way to its target of the round before takes no part, as
    metres only add up; a round that finds another way there goes by that one. A round thus joins its routes only with the
    edges that its hops can come to from the labels at its start. When a round changes none, the ways are followed back, a
    hop for all routes at a time.
    """
    profiles, configs = spread(combos)
    k = _place([f"{p}/{c}" for p, c in combos], F.concat_ws("/", "profile", "config"))
    lanes = asked.select("route", "destination", "source", "target", F.col("depart_s").isNull().alias("unbound"), F.floor(k / WIDTH).cast("int").alias("part"), (k % WIDTH).alias("i"), _place(profiles, F.col("profile")).alias("p"), _place(configs, F.col("config")).alias("c"))
    lanes = scratch.save(lanes, "lanes")
    g = F.get(F.array(*[c for c in found.columns if c.startswith("g_")]), F.col("i"))
    # a loop keeps each node among those that its hops come to
    pairs = scratch.save(edges.select("src", F.explode(F.array_distinct(F.array("src", "dst"))).alias("dst")).distinct(), "pairs")
    none = F.lit(None).cast("long")
    start = asked.select("route", F.col("source").alias("node"), F.lit(0.0).alias("m"), none.alias("prev"), none.alias("edge"), F.coalesce("depart_s", F.lit(0.0)).cast("double").alias("t"), F.lit(None).cast("double").alias("spare"))
    start = scratch.save(start, "start")
    now, most, sign = start, None, None
    for _ in range(max_rounds):
        ball = now.select("node").distinct()
        for _ in range(HOPS - 1):
            ball = ball.join(pairs, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        near = edges.join(ball.withColumnRenamed("node", "src"), "src", "left_semi")
        near = scratch.save(near.select("src", "dst", "edge", "metres", "travel", "cut"), "near")
        goes = found.withColumnRenamed("node", "dst").join(near.select("dst").distinct(), "dst", "left_semi").join(lanes, ["destination", "part"])
        goes = goes.select("route", "dst", "source", "target", "unbound", "p", "c", g.alias("g")).filter("g is not null and dst <> source")
        goes = goes.withColumn("most", F.lit(INF)) if most is None else goes.join(most, "route", "left").withColumn("most", F.coalesce("most", F.lit(INF)))
        net = goes.join(near, "dst").filter("src <> target").withColumn("until", F.coalesce(F.get("cut", F.col("c")), F.lit(INF)))
        net = net.select("route", "unbound", "most", "src", "dst", "edge", "metres", F.get("travel", F.col("p")).alias("s"), "until", F.least("until", "g").alias("deadline"))
        net = scratch.save(net.filter("not unbound or deadline = double('inf')"), "net")
        for _ in range(HOPS):
            met = now.select("route", F.col("node").alias("src"), "m", "t").join(net, ["route", "src"])
            at = F.col("t") + F.col("s")
            met = met.filter((F.col("unbound") | (at <= F.col("deadline"))) & (F.col("m") + F.col("metres") <= F.col("most")))
            label = F.struct((F.col("m") + F.col("metres")).alias("m"), F.col("m").alias("before"), F.col("src").alias("prev"), F.col("edge").alias("edge"), at.alias("t"), F.when(F.col("until") < INF, F.col("until") - at).alias("spare"))
            best = met.groupBy("route", F.col("dst").alias("node")).agg(F.min(label).alias("b"))
            now = best.select("route", "node", "b.m", "b.prev", "b.edge", "b.t", "b.spare").union(start)
        now = scratch.save(now, "labels")
        most = scratch.save(now.join(lanes.select("route", F.col("target").alias("node")), ["route", "node"]).select("route", F.col("m").alias("most")), "most")
        now = now.join(most, "route", "left").filter("most is null or m <= most").drop("most")
        new = now.agg(F.count("*"), F.sum(F.xxhash64("route", "node", "m", "prev", "edge").cast("decimal(38,0)"))).first()
        if new == sign:
            break
        sign = new
    else:
        raise RuntimeError(f"ways still change after {max_rounds * HOPS} hops")
    steps = now.filter("edge is not null").select("route", "node", "prev", "edge", "spare")
    here, back, k = asked.select("route", F.col("target").alias("node")), None, 0
    while True:
        part = None
        for _ in range(HOPS):
            k += 1
            met = here.join(steps, ["route", "node"]).select("route", F.lit(-k).alias("k"), "prev", "edge", "spare")
            part = met if part is None else part.union(met)
            here = met.select("route", F.col("prev").alias("node"))
        part = scratch.save(part, "back")
        back = part if back is None else back.union(part)
        here = part.filter(F.col("k") == -k).select("route", F.col("prev").alias("node"))
        if here.isEmpty():
            break
    nth = F.col("k") - F.col("first")
    first = back.groupBy("route").agg(F.min("k").alias("first"))
    return back.join(first, "route").select("route", nth.cast("int").alias("ord"), "edge", F.col("spare").alias("spare_s"))


def evacuation(edges: DataFrame, edge_cuts: DataFrame, node_cuts: DataFrame, places: DataFrame, pockets: DataFrame, cursor_s: int, window_end_s: int, observed: bool, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(routes, verdicts): from each pocket to every other place on the roads, at the cursor.

    edges: edge, src, dst, highway, metres, travel_s; edge_cuts: edge, config, cut_s, latency_s; node_cuts: node, ...
    likewise; places: sid, name, population (null: unknown), node (null: on no road); pockets: sid. observed: whether any
    detection has arrived by the cursor.

    routes: route, pocket, sid, destination, edges, km, travel_min, slowest, profile, earliest_s, latest_s (null: never
    closed), basis, open_s (earliest_s, null where the route is cut already), worst_min, best_min, bottleneck, usable,
    reason. verdicts: pocket, verdict, earliest_s, the latest of its usable routes' earliest departures.
    """
    speed = F.create_map(*[x for name, *_, scale, _ in PROFILES for x in (F.lit(name), scaled_travel(F.col("travel_s"), F.col("highway"), F.lit(scale)).cast("double"))])
    order = [(p[0], c[1], i * len(SWEEP) + k) for i, p in enumerate(PROFILES) for k, c in enumerate(SWEEP)]
    pairs = [(p, c) for p, c, _ in order]
    laid = edges.select("edge", "src", "dst", "highway", "metres", "travel_s", speed.alias("travel")).join(_known(edge_cuts, "edge", cursor_s), "edge", "left")
    none = F.create_map().cast("map<string,double>")
    laid = scratch.save(numbered(laid.withColumn("cut", F.coalesce("cut", none)), pairs), "roads")
    on_road = places.filter("node is not null").select("sid", "name", "population", "node")
    ends = on_road.select(F.col("sid").alias("destination"), "node").join(_known(node_cuts, "node", cursor_s), "node", "left").withColumn("cut", F.coalesce("cut", none))
    spark = edges.sparkSession
    lanes = spark.createDataFrame(order, "profile string, config string, ord int")
    found = lanes_by_part(laid, ends, pairs, scratch)
    homes = pockets.join(on_road, "sid").select(F.col("sid").alias("pocket"), F.col("node").alias("source"), "population")
    others = on_road.select(F.col("sid").alias("destination"), "name", F.col("node").alias("target"))
    combos = in_rows(found.join(homes, F.col("node") == F.col("source")).join(others, "destination").filter("source <> target"), pairs)
    route = F.struct("pocket", F.col("destination").alias("sid")).alias("route")
    combos = combos.join(F.broadcast(lanes), ["profile", "config"]).select(route, "ord", "profile", "config", "destination", "source", "target", F.concat_ws("/", "profile", "config").alias("combo"), "depart_s")
    combos = scratch.save(combos, "combos")
    first = combos.groupBy("route").agg(F.min(F.struct("ord", "profile", "config", "destination", "source", "target", "depart_s")).alias("f")).select("route", "f.*")
    steps = scratch.save(ways(found, pairs, laid, first, scratch), "ways")
    along = steps.join(laid.select("edge", "highway", "metres", "travel"), "edge").join(first.select("route", "profile"), "route")
    rank = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in RANK]), F.col("highway")), F.lit(0))
    way = along.groupBy("route").agg(
        F.array_sort(F.collect_list(F.struct("ord", "edge"))).alias("es"), F.round(F.sum("metres") / 1000, 2).alias("km"),
        F.round(F.sum(F.get("travel", _place(spread(pairs)[0], F.col("profile")))) / 60).cast("long").alias("travel_min"), F.max_by("highway", F.struct(rank, -F.col("ord"))).alias("slowest"),
    )
    band = bands(combos, window_end_s)
    people = homes.join(others).filter("source <> target").select(F.struct("pocket", F.col("destination").alias("sid")).alias("route"), "population")
    clear = clearance_range(along.select("route", "ord", "edge", "highway"), people)
    out = way.join(first.select("route", "profile"), "route").join(band, "route").join(clear, "route", "left").join(people, "route")
    bound = F.format_string("no combination of %d closes it within the window; earliest is the window's end", F.lit(len(order)))
    basis = F.when(F.col("unbound") == F.col("combos"), bound).otherwise(_basis(F.col("earliest_combo"), F.col("latest_combo"), F.col("combos"), F.lit(len(order)), "combinations", "found no way"))
    unbound = combos.groupBy("route").agg(F.count_if(F.col("depart_s").isNull()).cast("int").alias("unbound"))
    out = out.join(unbound, "route").withColumn("basis", basis)
    open_ = F.when(F.coalesce("latest_s", F.lit(INF)) >= cursor_s, F.col("earliest_s"))
    start_by = open_ - F.col("worst_min") * 60 - GATE_DELAY_S
    late = F.format_string("the decision had to be made %d minutes ago", F.round((cursor_s - start_by) / 60).cast("long"))
    reason = F.when(F.lit(not observed), "nothing has been observed yet").when(open_.isNull(), "already cut").when(F.col("population").isNull(), "population unknown, so clearance is").when(start_by < cursor_s, late)
    names = others.select(F.col("destination").alias("sid"), "name")
    out = out.withColumns({"open_s": open_, "reason": reason, "pocket": F.col("route.pocket"), "sid": F.col("route.sid")}).join(names, "sid")
    routes = out.select(
        F.concat_ws("-", "pocket", "sid").alias("route"), "pocket", "sid", F.col("name").alias("destination"), F.transform("es", lambda e: e["edge"]).alias("edges"), "km", "travel_min", "slowest", "profile",
        "earliest_s", "latest_s", "basis", "open_s", "worst_min", "best_min", F.col("edge").alias("bottleneck"), F.col("reason").isNull().alias("usable"), "reason",
    )
    routes = scratch.save(routes, "routes")
    some = routes.groupBy("pocket").agg(F.bool_or("usable").alias("any"), F.max(F.when(F.col("usable"), F.col("earliest_s"))).alias("earliest_s"))
    verdict = F.when(F.lit(not observed), "not_yet_observed").when(F.coalesce("any", F.lit(False)), "routes_open").otherwise("no_verified_action")
    verdicts = pockets.select(F.col("sid").alias("pocket")).join(some, "pocket", "left").select("pocket", verdict.alias("verdict"), "earliest_s")
    return routes, verdicts
