"""Joins by distance and containment. Grid cells turn them into equality joins; exact distances decide."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberglass.constants import DEFAULT_FOOTPRINT_M, FAMILIES, FAMILY, FOOTPRINT_M, GEOSTATIONARY, lookup
from emberglass.functions.geo import haversine_km, in_ring, metres_per_degree, point_segment_m
from emberglass.storage import Scratch

#: Metres of a degree in the index, of latitude the fewest that there are.
INDEX_LAT_M, INDEX_LON_M = 110500.0, 111320.0


def cells_of_box(south: Column, west: Column, north: Column, east: Column, size_deg: float) -> Column:
    rows = F.sequence(F.floor(south / size_deg).cast("long"), F.floor(north / size_deg).cast("long"))
    cols = F.sequence(F.floor(west / size_deg).cast("long"), F.floor(east / size_deg).cast("long"))
    return F.flatten(F.transform(rows, lambda r: F.transform(cols, lambda c: F.struct(r.alias("r"), c.alias("c")))))


def near_segments(segments: DataFrame, det: DataFrame, radius_m: float, most_lat: float = 60.0, one_piece: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """(seg_id, id, distance_m) of all pairs within radius_m, each once, with the columns of det that carry names.

    segments: seg_id, lat1, lon1, lat2, lon2 (a node is a segment of no length; rows of one seg_id are one line; if every
    seg_id has one_piece, pairs need no further shuffle), det: id, lat, lon. Segments are listed in every cell, half a radius wide, of their box and radius_m around it; detections look
    into their own cell. most_lat bounds the latitudes for which the index's metres hold; beyond it the call is refused
    rather than pairs lost.
    """
    size = radius_m / 2 / INDEX_LON_M
    south, north = F.least("lat1", "lat2") - radius_m / INDEX_LAT_M, F.greatest("lat1", "lat2") + radius_m / INDEX_LAT_M
    far = radius_m / INDEX_LON_M / F.cos(F.radians(F.least(F.lit(89.0), F.greatest(F.abs(south), F.abs(north))))) * 1.01
    box = cells_of_box(south, F.least("lon1", "lon2") - far, north, F.greatest("lon1", "lon2") + far, size)
    s = segments.withColumn("cell", F.explode(box)).select("seg_id", "lat1", "lon1", "lat2", "lon2", F.col("cell.r").alias("r"), F.col("cell.c").alias("c"))
    ok = F.abs(F.col("lat")) <= most_lat
    guarded = det.select("id", "lat", "lon", *carry).withColumn("lat", F.when(ok, F.col("lat")).otherwise(F.raise_error(F.lit(f"a detection lies beyond {most_lat} degrees")).cast("double")))
    of_lat, of_lon = metres_per_degree(F.col("lat"))
    d = guarded.withColumns({"of_lat": of_lat, "of_lon": of_lon, "r": F.floor(F.col("lat") / size).cast("long"), "c": F.floor(F.col("lon") / size).cast("long")})
    metres = point_segment_m(F.col("lat"), F.col("lon"), F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"), (F.col("of_lat"), F.col("of_lon")))
    # a generated column is computed once, where a projected one is put into every expression that uses it
    # the join makes far more rows than it reads, so its partitions must not be merged for the little they read
    n = int(det.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = s.repartition(n, "r", "c").join(d.repartition(n, "r", "c"), ["r", "c"]).select("seg_id", "id", *carry, F.explode(F.array(metres)).alias("distance_m"))
    pairs = met.filter(F.col("distance_m") <= radius_m)
    if one_piece:
        return pairs.select("seg_id", "id", "distance_m", *carry)
    return pairs.groupBy("seg_id", "id").agg(F.min("distance_m").alias("distance_m"), *[F.first(c).alias(c) for c in carry])


#: Pairs that a task of pairs_by_place() makes, tasks at most, segments of a place that are collected in one row, segments
#: that go in turn (a multiple of eight, as files pack values by eight), and the pairs that a place and a shape must stand
#: for on average, or classes are not worth their tables.
TASK_PAIRS, MOST_TASKS, NEAR_IDS, TURN, WORTH = 1 << 25, 4096, 4096, 128, 8


def pairs_by_place(segments: DataFrame, det: DataFrame, radius_m: float, scratch: Scratch, digits: int, task_pairs: int = TASK_PAIRS) -> DataFrame:
    """(seg_id, id, distance_m) of near_segments() for segments of one piece each, distances rounded to digits.

    Places and shapes meet once; each place has its segments as short lists, and all of its detections go through one list
    before the next. So a detection's pairs follow each other and those of the next one repeat their order, which columnar
    files keep in a small part of the room that pairs take in the order of a join. There are as many tasks as the pairs ask
    for; a place with more pairs than a task's share is dealt out by its detections. Where places and shapes hardly repeat,
    all rows meet.
    """
    spots = det.filter("lat is not null and lon is not null").groupBy("lat", "lon").agg(F.min("id").alias("id"), F.count("*").alias("seen"))
    spots = scratch.save(spots, "spots")
    shapes = scratch.save(segments.groupBy(*ENDS).agg(F.min("seg_id").alias("seg_id"), F.count("*").alias("lines")), "shapes")
    often, many = (t.agg(F.coalesce(F.avg(c), F.lit(1.0))).first()[0] for t, c in ((spots, "seen"), (shapes, "lines")))
    if often * many < WORTH:
        return near_segments(segments, det, radius_m, one_piece=True).withColumn("distance_m", F.round("distance_m", digits))
    found = near_segments(shapes, spots, radius_m, one_piece=True).withColumn("distance_m", F.round("distance_m", digits))
    found = scratch.save(found.withColumnsRenamed({"seg_id": "shape", "id": "spot"}), "found")
    ids = in_chunks(segments, ENDS, "seg_id").join(shapes.withColumnRenamed("seg_id", "shape"), ENDS).select("shape", "ids")
    lines = found.join(shapes.select(F.col("seg_id").alias("shape"), "lines"), "shape").groupBy("spot").agg(F.sum("lines").alias("lines"))
    places = scratch.save(lines.join(spots.withColumnRenamed("id", "spot"), "spot").withColumn("pairs", F.col("lines") * F.col("seen")), "places")
    total = places.agg(F.coalesce(F.sum("pairs"), F.lit(0))).first()[0]
    n = max(int(det.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_TASKS, math.ceil(total / task_pairs)))
    places = places.withColumn("parts", F.ceil(F.col("pairs") * n / max(total, 1)))
    near = found.join(places.select("spot", "lines", "parts"), "spot").join(ids, "shape")
    row = F.pmod(F.xxhash64("shape", F.get("ids", F.lit(0))), F.ceil(F.col("lines") / NEAR_IDS))
    near = near.select("spot", F.explode(F.sequence(F.lit(1).cast("long"), "parts")).alias("part"), row.alias("row"), F.struct("distance_m", "ids").alias("near"))
    near = near.repartition(n, "spot", "part").groupBy("spot", "part", "row").agg(F.collect_list("near").alias("near"))
    flat = F.flatten(F.transform("near", lambda x: F.transform(x["ids"], lambda k: F.struct(k.alias("seg_id"), x["distance_m"].alias("distance_m")))))
    turns = F.transform(F.sequence(F.lit(1), F.size("near"), F.lit(TURN)), lambda k: F.slice("near", k, TURN))
    near = near.withColumn("near", flat).select("spot", "part", F.explode(turns).alias("near"))
    part = F.pmod(F.xxhash64("id"), F.col("parts")) + 1
    dealt = det.select("id", "lat", "lon").join(places.select("lat", "lon", "spot", "parts"), ["lat", "lon"]).select("id", "spot", part.alias("part"))
    met = near.hint("merge").join(dealt.repartition(n, "spot", "part"), ["spot", "part"])
    return met.select("id", F.explode("near").alias("near")).select("near.seg_id", "id", "near.distance_m")


def radius_m(source: Column, scale: Column, fixed: Column) -> Column:
    return F.coalesce(fixed, lookup(FOOTPRINT_M, source, DEFAULT_FOOTPRINT_M) * scale)


def allows(sources: Column, min_conf: Column, source: Column, conf: Column) -> Column:
    """Does a configuration take a detection? A floor turns away null confidences."""
    geo = source.isin(GEOSTATIONARY)
    of = F.when(sources == "geo", geo).when(sources == "polar", ~geo).otherwise(True)
    return of & (min_conf.isNull() | F.coalesce(conf >= min_conf, F.lit(False)))


CARRIED = ("at_s", "source", "confidence", "static_heat")


def cut_field(pairs: DataFrame, det: DataFrame, configs: DataFrame) -> DataFrame:
    """(config_ord, config, seg_id, cut_s, evidence): first time of a detection within the configuration's radius, and
    the sorted ids of all at that time. The twelve configurations are a broadcast table.

    det may say in a column static_heat which detections lie at a known source of heat (see flag_heat()): only
    configurations with static_kept take those. Of a segment's pairs only the earliest of each kind of detection and each
    of the configurations' radii meets the configurations; evidence is collected for the pairs at the cuts alone. Pairs
    that carry the columns CARRIED of det are not joined with it again.
    """
    if "static_heat" not in det.columns:
        det = det.withColumn("static_heat", F.lit(False))
    circles = sorted({(r["scale"], r["fixed_m"]) for r in configs.select("scale", "fixed_m").collect()}, key=str)  # twelve rows
    radii = F.array(*[radius_m(F.col("source"), F.lit(scale), F.lit(fixed).cast("double")) for scale, fixed in circles])
    near = pairs if set(CARRIED) <= set(pairs.columns) else pairs.select("seg_id", "id", "distance_m").join(det.select("id", *CARRIED), "id")
    # the least radius that holds the pair stands for its distance
    near = near.withColumn("reach_m", F.array_min(F.filter(radii, lambda r: r >= F.col("distance_m")))).filter("reach_m is not null")
    takes = allows(F.col("sources"), F.col("min_conf"), F.col("source"), F.col("confidence")) & (F.col("static_kept") | ~F.col("static_heat"))

    def met(rows: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(configs), takes).filter(F.col("reach_m") <= radius_m(F.col("source"), F.col("scale"), F.col("fixed_m")))

    near = Scratch(pairs.sparkSession, "sweep").save(near.select("seg_id", "id", "reach_m", *CARRIED), "near")
    earliest = near.groupBy("seg_id", "source", "confidence", "static_heat", "reach_m").agg(F.min("at_s").alias("at_s"))
    first = met(earliest).groupBy("config_ord", "config", "seg_id").agg(F.min("at_s").alias("cut_s"))
    at_cut = near.join(first.select("seg_id", F.col("cut_s").alias("at_s")).distinct(), ["seg_id", "at_s"], "left_semi")
    evidence = met(at_cut).select("config_ord", "seg_id", F.col("at_s").alias("cut_s"), "id")
    found = first.join(evidence, ["config_ord", "seg_id", "cut_s"]).groupBy("config_ord", "config", "seg_id", "cut_s")
    return found.agg(F.array_sort(F.collect_set("id")).alias("evidence"))


ENDS = ["lat1", "lon1", "lat2", "lon2"]
_KIND = ["lat", "lon", "source", "confidence"]


def sweep(segments: DataFrame, det: DataFrame, configs: DataFrame, scratch: Scratch, rings: DataFrame | None = None, reach_m: float = 2000.0) -> tuple[DataFrame, DataFrame]:
    """(cuts, members): cut_field() of segments that are one piece each, by shape instead of by segment, and (seg_id,
    shape), the segments of each shape that is cut.

    Detections of one place, source and confidence are met by the same segments and configurations, so the earliest of
    them stands for all (a satellite sees the same pixels scan after scan), as one shape does for all segments that have
    it. Pairs thus grow with places and shapes, not with how often each is seen; evidence names every detection that is as
    early. rings: known sources of heat, see flag_heat().
    """
    first = F.min(F.struct("at_s", "id"))
    spots = det.groupBy(*_KIND).agg(first.alias("f")).select("f.id", "f.at_s", *_KIND)
    spots = scratch.save(spots.withColumn("static_heat", F.lit(False)) if rings is None else flag_heat(spots, rings), "spots")
    shapes = scratch.save(segments.groupBy(*ENDS).agg(F.min("seg_id").alias("shape")), "shapes")
    met = near_segments(shapes.withColumnRenamed("shape", "seg_id"), spots, reach_m, one_piece=True, carry=CARRIED)
    cuts = scratch.save(cut_field(met, spots, configs).withColumnRenamed("seg_id", "shape"), "cuts")
    used = cuts.select(F.explode("evidence").alias("id")).distinct().join(spots, "id")
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"u.{c}")) for c in [*_KIND, "at_s"]]
    equal = same[0]
    for c in same[1:]:
        equal = equal & c
    everyone = det.alias("d").join(used.alias("u"), equal).select(F.col("u.id").alias("spot"), F.col("d.id").alias("id"))
    named = cuts.select("config_ord", "config", "shape", "cut_s", F.explode("evidence").alias("spot")).join(everyone, "spot")
    named = named.groupBy("config_ord", "config", "shape", "cut_s").agg(F.array_sort(F.collect_set("id")).alias("evidence"))
    members = segments.select("seg_id", *ENDS).distinct().join(shapes, ENDS).select("seg_id", "shape")
    return scratch.save(named, "named"), members


def flag_heat(det: DataFrame, rings: DataFrame) -> DataFrame:
    """det with static_heat: whether it lies in one of the rings."""
    kept, removed = without_heat(det, rings)
    return kept.withColumn("static_heat", F.lit(False)).unionByName(removed.withColumn("static_heat", F.lit(True)))


def band(cuts: DataFrame, nominal: str = "all-1x") -> DataFrame:
    """Per segment the earliest and latest cut over the configurations, the first configuration that has each, how many
    cut it at all, and the nominal cut."""
    lo, hi = F.min(F.struct("cut_s", "config_ord", "config")), F.min(F.struct(-F.col("cut_s"), F.col("config_ord"), F.col("config")))
    out = cuts.groupBy("seg_id").agg(lo.alias("lo"), hi.alias("hi"), F.count("*").alias("contributors"), F.max(F.when(F.col("config") == nominal, F.col("cut_s"))).alias("nominal_s"))
    return out.select("seg_id", F.col("lo.cut_s").alias("earliest_s"), F.col("lo.config").alias("earliest_config"), (-F.col("hi.col1")).alias("latest_s"), F.col("hi.config").alias("latest_config"), "contributors", "nominal_s")


def family(source: Column) -> Column:
    return lookup(FAMILY, source, source)


def family_rows(det: DataFrame, cuts: DataFrame, config: str = "all-1x", members: DataFrame | None = None) -> DataFrame:
    """Per sensor family: detections, those that cut a segment first, and segments that it cut. Known families always
    have a row. cuts are by seg_id, or by shape where members (seg_id, shape) tells the segments of each (see sweep())."""
    spark = det.sparkSession
    of = "seg_id" if members is None else "shape"
    seen = det.groupBy(family(F.col("source")).alias("family")).agg(F.count("*").alias("detections"))
    used = cuts.filter(F.col("config") == config).select(of, F.explode("evidence").alias("id")).join(det.select("id", "source"), "id")
    used = used.select(of, "id", family(F.col("source")).alias("family"))
    cut = used.select("family", of).distinct()
    cut = (cut if members is None else cut.join(members, of)).groupBy("family").agg(F.countDistinct("seg_id").alias("cut_segments"))
    used = used.groupBy("family").agg(F.countDistinct("id").alias("used")).join(cut, "family")
    known = spark.createDataFrame([(f,) for f in FAMILIES], "family string")
    out = known.join(seen, "family", "full").join(used, "family", "left")
    return out.select("family", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("detections", "used", "cut_segments")])


def without_heat(det: DataFrame, rings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, removed): detections outside all rings, and inside one. rings: ring (array of lat, lon), listed by cell of
    their boxes so that each detection meets only the rings around it."""
    size = 0.05
    lat, lon = F.transform("ring", lambda p: p["lat"]), F.transform("ring", lambda p: p["lon"])
    r = rings.withColumn("cell", F.explode(cells_of_box(F.array_min(lat), F.array_min(lon), F.array_max(lat), F.array_max(lon), size)))
    d = det.withColumn("cell", F.struct(F.floor(F.col("lat") / size).cast("long").alias("r"), F.floor(F.col("lon") / size).cast("long").alias("c")))
    hit = (d["cell"] == r["cell"]) & in_ring(d["lat"], d["lon"], r["ring"])
    return d.join(r, hit, "left_anti").drop("cell"), d.join(r, hit, "left_semi").drop("cell")


#: Places of nodes in a cell of the first round, on average.
CROWD = 8


def nearest_node(points: DataFrame, nodes: DataFrame, scratch: Scratch, size_deg: float = 0.02) -> DataFrame:
    """points (point_id, plat, plon) with the nearest node (node_id, lat, lon) by cosine-scaled degrees, first id on ties.

    Looks into the rings of cells around the point, growing until a node is nearer than any cell not yet looked into:
    each round only takes the points that are still open, and is written before the next. After four rounds cells are
    made larger instead of more, until one round covers the globe; only points and cells meet, never all of both. Without
    nodes there are no rows. Nodes at one place are one, and so are points; the first cells are made as small as keeps
    CROWD nodes in one.
    """
    cos2 = F.pow(F.cos(F.radians("plat")), 2)
    d2 = F.pow(F.col("lat") - F.col("plat"), 2) + cos2 * F.pow(F.col("lon") - F.col("plon"), 2)
    nodes = scratch.save(nodes.groupBy("lat", "lon").agg(F.min("node_id").alias("node_id")), "nodes")
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for _ in range(4):
        here = nodes.groupBy(*[F.floor(F.col(c) / size_deg).cast("long").alias(c) for c in ("lat", "lon")]).count()
        most = here.agg(F.sum(F.col("count") * F.col("count")) / F.sum("count")).first()[0]  # nodes in the cell of a node, on average
        if most is None or most <= CROWD:
            break
        size_deg /= 2
    open_, found, reach = scratch.save(points.select("plat", "plon").distinct(), "open"), None, 1
    while True:
        last = size_deg >= 360
        cell = lambda c: F.floor(F.col(c) / size_deg).cast("long")
        n = nodes.select("node_id", "lat", "lon", cell("lat").alias("r"), cell("lon").alias("c"))
        span = F.sequence(F.lit(-reach), F.lit(reach))
        cells = F.flatten(F.transform(span, lambda a: F.transform(span, lambda b: F.struct((cell("plat") + a).alias("r"), (cell("plon") + b).alias("c")))))
        around = open_.withColumn("cell", F.explode(cells)).select("plat", "plon", "cell.r", "cell.c")
        # as in near_segments(): the join makes more rows than it reads
        met = around.repartition(parts, "r", "c").join(n.repartition(parts, "r", "c"), ["r", "c"])
        best = met.groupBy("plat", "plon").agg(F.min(F.struct(d2.alias("d2"), "node_id")).alias("b"))
        sure = best if last else best.filter(F.sqrt("b.d2") <= F.lit(reach * size_deg) * F.cos(F.radians("plat")))
        sure = scratch.save(sure.select("plat", "plon", F.col("b.node_id").alias("node_id"), F.col("b.d2").alias("d2")), "nearest")
        found = sure if found is None else found.union(sure)
        open_ = scratch.save(open_.join(sure, ["plat", "plon"], "left_anti"), "open")
        if last or open_.isEmpty():
            each = points.select("point_id", "plat", "plon").join(found, ["plat", "plon"]).groupBy("point_id").agg(F.min(F.struct("d2", "node_id")).alias("b"))
            return each.select("point_id", "b.node_id", "b.d2")
        reach, size_deg = (reach * 2, size_deg) if reach < 8 else (reach, size_deg * 4)


def ring_of(distance_km: Column, inside: Column) -> Column:
    return F.when(inside, "inside").when(distance_km <= 5, "5km").when(distance_km <= 10, "10km").when(distance_km <= 20, "20km")


SEVERITY = {"inside": 0, "5km": 1, "10km": 2, "20km": 3}


def _columns(row: Column, size_deg: Column) -> Column:
    """Into how many columns a row of cells is cut, so that they are about size_deg of arc wide."""
    return F.greatest(F.lit(1), F.floor(360 * F.cos(F.radians(F.least(F.lit(90.0), F.abs(row + 0.5) * size_deg))) / size_deg)).cast("long")


def celled(points: DataFrame, discs: DataFrame, least_deg: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """points (lat, lon, ...) and discs (dlat, dlon, reach_km, ...) with cells (size, r, c): each point in whose reach a disc
    may have it shares one cell with it, and no other.

    A disc is listed in every cell of its box, in a grid of cells a quarter to half as large as its reach; a point looks
    into its own cell of each grid that there is (some twenty at most), so a pair meets once. Rows of cells are cut into
    fewer columns towards the poles and close at 180 degrees. No cell is smaller than least_deg, a power of two.
    """
    reach = F.greatest(F.col("reach_km"), F.lit(0.001)) / 110.0
    step = F.least(F.lit(90.0), F.greatest(F.lit(least_deg), F.pow(F.lit(2.0), F.floor(F.log2(reach)) - 1)))
    known = discs.filter("dlat is not null and dlon is not null and reach_km is not null").withColumn("size", step)
    lat, size = F.col("dlat"), F.col("size")
    rows = F.sequence(F.floor((lat - reach) / size).cast("long"), F.floor((lat + reach) / size).cast("long"))
    turn = F.when(F.abs(lat) + reach >= 89.9, 180.0).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.radians(reach)) / F.cos(F.radians(lat))))))
    d = known.withColumn("turn", turn + 1e-9).withColumn("r", F.explode(rows)).withColumn("n", _columns(F.col("r"), size))
    column = lambda lon: F.floor((lon + 180) / 360 * F.col("n")).cast("long")
    low, high = column(F.col("dlon") - F.col("turn")), column(F.col("dlon") + F.col("turn"))
    d = d.withColumn("c", F.explode(F.sequence(low, F.least(high, low + F.col("n") - 1)))).withColumn("c", F.pmod("c", "n")).drop("turn", "n")
    p = points.join(F.broadcast(known.select("size").distinct()))  # powers of two up to 90
    p = p.withColumn("r", F.floor(F.col("lat") / size).cast("long")).withColumn("n", _columns(F.col("r"), size))
    return p.withColumn("c", F.pmod(column(F.col("lon")), F.col("n"))).drop("n"), d


def within(points: DataFrame, discs: DataFrame, km: Column, keep_as: str | None = None, by_disc: bool = False) -> DataFrame:
    """points (lat, lon, ...) with the discs (dlat, dlon, reach_km, ...) in whose reach they are, through celled(); km is
    the distance, kept in a column if keep_as names one. by_disc: all points of a disc and cell follow each other."""
    p, d = celled(points, discs)
    close = F.abs(F.col("lat") - F.col("dlat")) * 110 <= F.col("reach_km")
    # as in near_segments(): the join makes more rows than it reads
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a join on a double shuffles again, into partitions that are merged, so sizes (powers of two, or 90) are whole numbers
    cell = ["z", "r", "c"]
    p, d = (rows.withColumn("z", (F.col("size") * (1 << 20)).cast("long")).drop("size").repartition(parts, *cell) for rows in (p, d))
    met = d.hint("merge").join(p, cell) if by_disc else p.join(d, cell)
    met = met.filter(close).drop(*cell)
    met = met.select("*", F.explode(F.array(km)).alias("km_")).filter(F.col("km_") <= F.col("reach_km"))  # computed once, as there
    return met.withColumnRenamed("km_", keep_as) if keep_as else met.drop("km_")


def threats(assets: DataFrame, fires: DataFrame, most_km: float = 20.0, carry: tuple[str, ...] = ()) -> DataFrame:
    """Assets (asset_id, lat, lon) within most_km of a fire (fire_id, flat, flon, radius_km), or inside it, with ring and the
    columns of assets that carry names."""
    f = fires.select("fire_id", F.col("flat").alias("dlat"), F.col("flon").alias("dlon"), "radius_km", (F.col("radius_km") + most_km).alias("reach_km"))
    km = haversine_km(F.col("lat"), F.col("lon"), F.col("dlat"), F.col("dlon"))
    edge = F.greatest(F.lit(0.0), F.col("km") - F.col("radius_km"))
    out = within(assets.select("asset_id", "lat", "lon", *carry), f, km, "km", by_disc=True).filter(ring_of(edge, F.col("km") <= F.col("radius_km")).isNotNull())
    return out.select("fire_id", "asset_id", ring_of(edge, F.col("km") <= F.col("radius_km")).alias("ring"), edge.alias("distance_km"), *carry)


#: Ids of one class that go in one row.
CHUNK = 256


def in_chunks(rows: DataFrame, keys: list[str], id_col: str, chunk: int = CHUNK) -> DataFrame:
    """(keys, ids): the ids of each class of equal keys, about chunk of them a row, so that no class has to fit one."""
    n = rows.groupBy(*keys).agg(F.ceil(F.count("*") / chunk).alias("chunks_"))
    part = F.pmod(F.xxhash64(id_col), F.col("chunks_"))
    return rows.select(id_col, *keys).join(n, keys).groupBy(*keys, part.alias("chunk_")).agg(F.collect_list(id_col).alias("ids")).drop("chunk_")


def expanded(found: DataFrame, members: DataFrame, by: str, id_col: str, *columns: str) -> DataFrame:
    """found (by, ...) with a row for every id of members (by, ids). No merged tasks: far more rows leave than come in."""
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = found.repartition(parts, by).join(members.repartition(parts, by), by)
    return met.select(F.explode("ids").alias(id_col), *columns)


def line_samples(lines: DataFrame, step_km: float = 0.5) -> DataFrame:
    """Points every step_km or less along each segment (line_id, lat1, lon1, lat2, lon2), both ends included."""
    km = haversine_km(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    n = F.greatest(F.lit(1), F.ceil(km / step_km).cast("int"))
    rows = lines.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n"))))
    t = F.col("k") / F.col("n")
    return rows.select("line_id", "k", (F.col("lat1") + (F.col("lat2") - F.col("lat1")) * t).alias("lat"), (F.col("lon1") + (F.col("lon2") - F.col("lon1")) * t).alias("lon"))


def reach(cells: DataFrame, settlements: DataFrame, threatened: DataFrame) -> DataFrame:
    """Per cell of a mobile network: settlements and people it covers, and the people alerted without being threatened.

    cells: cell_id, clat, clon, range_m (null or not above 0: unusable, left out); settlements: sid, lat, lon, population
    (negative: unknown); threatened: sid. An unknown population counts as none in the sum and is counted on its own.
    Settlements at one place are added up before they meet the cells, and cells of one place and range are one.
    """
    usable = cells.filter("range_m > 0 and clat is not null and clon is not null")
    s = settlements.join(threatened.select("sid", F.lit(True).alias("t")), "sid", "left")
    pop, safe = F.when(F.col("population") >= 0, F.col("population")), F.col("t").isNull()
    per_place = [F.count("*").alias("covered"), F.sum(F.when(safe, F.coalesce(pop, F.lit(0))).otherwise(0)).alias("over_alerted"), F.count_if(safe & pop.isNull()).alias("unknown")]
    s = s.filter("lat is not null and lon is not null").groupBy("lat", "lon").agg(*per_place)
    discs = usable.select(F.col("clat").alias("dlat"), F.col("clon").alias("dlon"), (F.col("range_m") / 1000).alias("reach_km"), "range_m").distinct()
    km = haversine_km(F.col("lat"), F.col("lon"), F.col("dlat"), F.col("dlon"))
    met = within(s, discs, km).filter(km * 1000 <= F.col("range_m"))
    sums = ["covered", "over_alerted", "unknown"]
    per = met.groupBy(F.col("dlat").alias("clat"), F.col("dlon").alias("clon"), "range_m").agg(*[F.sum(c).alias(c) for c in sums])
    per = usable.join(per, ["clat", "clon", "range_m"], "left")
    return per.select("cell_id", (F.col("range_m") != 1000).alias("measured"), *[F.coalesce(c, F.lit(0)).alias(c) for c in sums])


def tile_bounds(bounds: DataFrame, rows: int, cols: int) -> DataFrame:
    """(row, col, south, west, north, east) tiles of each box (south, west, north, east)."""
    t = bounds.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(rows - 1)))).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(cols - 1))))
    h, w = (F.col("north") - F.col("south")) / rows, (F.col("east") - F.col("west")) / cols
    return t.select("row", "col", (F.col("south") + h * F.col("row")).alias("south"), (F.col("west") + w * F.col("col")).alias("west"), (F.col("south") + h * (F.col("row") + 1)).alias("north"), (F.col("west") + w * (F.col("col") + 1)).alias("east"))


#: Metres in a degree of latitude, and of longitude at the equator, as cell surveys measure them.
SURVEY_LAT_M, SURVEY_LON_M = 110977.0, 111320.0


def survey_tiles(bounds: DataFrame, most_m2: float = 4e6) -> DataFrame:
    """bounds' columns (south, west, north, east, ...) with row, col, area_m2 and each box's tiles in place of its edges: as
    few equal rows and columns as keep a side within that of a square of most_m2 on the ground at the box's middle. A box
    without height or width is one tile of it; one that lacks an edge has none."""
    side = math.sqrt(most_m2)
    of_lon = lambda lat: F.greatest(F.lit(1.0), SURVEY_LON_M * F.cos(F.radians(lat)))
    high, wide = F.col("north") - F.col("south"), F.col("east") - F.col("west")
    count = lambda span, m: F.greatest(F.lit(1), F.ceil(span / (F.lit(side) / m))).cast("int")
    rows, cols = count(high, F.lit(SURVEY_LAT_M)), count(wide, of_lon((F.col("south") + F.col("north")) / 2))
    t = bounds.filter("south is not null and west is not null and north is not null and east is not null").withColumns({"n_": rows, "m_": cols})
    t = t.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("n_") - 1))).withColumn("col", F.explode(F.sequence(F.lit(0), F.col("m_") - 1)))
    at = lambda low, span, k, n: F.col(low) + k * span / F.col(n)
    r, c = F.col("row"), F.col("col")
    t = t.withColumns({"south": at("south", high, r, "n_"), "north": at("south", high, r + 1, "n_"), "west": at("west", wide, c, "m_"), "east": at("west", wide, c + 1, "m_")})
    area = high * SURVEY_LAT_M * wide * of_lon((F.col("south") + F.col("north")) / 2)
    return t.withColumn("area_m2", area).drop("n_", "m_")


def coverage_at(lat: Column, lon: Column, boxes: dict[str, tuple[float, float, float, float]]) -> Column:
    """The name of the first box (south, west, north, east; edges included) that holds a place; null if none does. Boxes
    are configuration, a handful, and become part of the expression."""
    hits = [F.when(lat.between(s, n) & lon.between(w, e), F.lit(name)) for name, (s, w, n, e) in boxes.items()]
    return F.coalesce(*hits, F.lit(None).cast("string"))


def local_observations(events: DataFrame, observations: DataFrame, size: int = 64) -> DataFrame:
    """(event_id, id) of the observations (id, row, col) in each event's size x size patch about its seed cell (seed_row,
    seed_col): from size / 2 before it to size / 2 - 1 after. They meet in buckets of that size, of which a patch touches
    four at most."""
    bucket = lambda c: F.floor(c / size).cast("long")
    r0, c0 = F.col("seed_row") - size // 2, F.col("seed_col") - size // 2
    e = events.select("event_id", r0.alias("r0"), c0.alias("c0"))
    e = e.withColumn("br", F.explode(F.sequence(bucket(F.col("r0")), bucket(F.col("r0") + size - 1)))).withColumn("bc", F.explode(F.sequence(bucket(F.col("c0")), bucket(F.col("c0") + size - 1))))
    o = observations.select("id", "row", "col", bucket(F.col("row")).alias("br"), bucket(F.col("col")).alias("bc"))
    inside = F.col("row").between(F.col("r0"), F.col("r0") + size - 1) & F.col("col").between(F.col("c0"), F.col("c0") + size - 1)
    return e.join(o, ["br", "bc"]).filter(inside).select("event_id", "id")


def components_of_pixels(pixels: DataFrame, components: DataFrame) -> DataFrame:
    """pixels (row, col, ...) with component; null where components (row, col, component) has none. A cell that it has more
    than once is an error, whether a pixel asks for it or not."""
    one = components.groupBy("row", "col").agg(F.count("*").alias("n"), F.first("component").alias("component"))
    sound = F.when(F.col("n") == 1, F.col("component")).otherwise(F.raise_error(F.lit("a cell is in more than one component")).cast(components.schema["component"].dataType))
    # the check is part of what is joined, so every cell meets it before the join
    return pixels.join(one.select("row", "col", sound.alias("component")), ["row", "col"], "left")


def placed(rows: DataFrame, by: str, *order: Column | str) -> DataFrame:
    """rows with nth, the place in the order within each group."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
