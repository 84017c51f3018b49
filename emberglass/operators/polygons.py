"""Points against polygons: containment by crossings and distance by the nearest edge, through an index of edges.

A polygon is (pid, rings): any number of closed or open rings of (lat, lon), holes and separate parts alike, by the even-odd
rule. Edges are straight in latitude and longitude. Longitudes count from the polygon's first point, so that one across the
date line is like any other; one that spans 180 degrees or more from there, as around a pole, is refused.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, ByteType, DoubleType, StructField, StructType

from emberglass.constants import EARTH_KM
from emberglass.functions.geo import haversine_km, metres_per_degree, point_segment_m
from emberglass.operators.spatial import INDEX_LAT_M, INDEX_LON_M, SEVERITY, celled, in_chunks, ring_of, within
from emberglass.storage import Scratch

#: Radii, as shares of the farthest distance asked for, at which edges are looked for one after the other.
REACHES = (1 / 16, 1 / 4, 1)
#: Polygons of no more edges are met whole.
FEW = 64
#: Points and polygons of one cell that meet in one call, on average.
CALL = (4096, 256)
#: Degrees that such a cell measures at least: a call costs some milliseconds, however little it is given.
CELL_DEG = 0.25


def turned(degrees: Column) -> Column:
    """A difference of longitudes, -180 or more and below 180."""
    return F.pmod(degrees + 180.0, F.lit(360.0)) - 180.0


def edges_of(polygons: DataFrame) -> DataFrame:
    """(pid, lon0, lat1, x1, lat2, x2): every ring's edges, x from the first point's longitude lon0. Open rings are closed;
    rings of fewer than three points, null ones and points without a place are left out."""
    point = lambda p: p.isNotNull() & p["lat"].isNotNull() & p["lon"].isNotNull()
    rings = F.filter(F.transform("rings", lambda r: F.filter(r, point)), lambda r: r.isNotNull() & (F.size(r) >= 3))
    rows = polygons.select("pid", rings.alias("rings")).filter(F.size("rings") > 0)
    rows = rows.select("pid", F.element_at(F.element_at("rings", 1), 1)["lon"].alias("lon0"), F.explode("rings").alias("ring"))
    rows = rows.withColumn("ring", F.concat("ring", F.array(F.element_at("ring", 1))))
    pairs = F.transform(F.sequence(F.lit(1), F.size("ring") - 1), lambda i: F.struct(F.element_at("ring", i).alias("p"), F.element_at("ring", i + 1).alias("q")))
    one = rows.select("pid", "lon0", F.explode(pairs).alias("e"))
    x1 = turned(F.col("e.p.lon") - F.col("lon0"))
    x2 = x1 + turned(F.col("e.q.lon") - F.col("e.p.lon"))
    sound = F.when(F.abs(x2) < 180, x2).otherwise(F.raise_error(F.lit("a polygon spans half the globe")).cast("double"))
    kept = one.select("pid", "lon0", F.col("e.p.lat").alias("lat1"), x1.alias("x1"), F.col("e.q.lat").alias("lat2"), sound.alias("x2"))
    return kept.filter("lat1 <> lat2 or x1 <> x2")


def outlines(edges: DataFrame) -> DataFrame:
    """(pid, lon0, south, north, west, east, n_edges): a polygon's box, x as in edges_of(), and how many edges it has."""
    x, lat = F.array("x1", "x2"), F.array("lat1", "lat2")
    return edges.groupBy("pid").agg(
        F.first("lon0").alias("lon0"), F.min(F.array_min(lat)).alias("south"), F.max(F.array_max(lat)).alias("north"),
        F.min(F.array_min(x)).alias("west"), F.max(F.array_max(x)).alias("east"), F.count("*").alias("n_edges"),
    )


def located(points: DataFrame, polygons: DataFrame, keys: list[str], most_km: float, scratch: Scratch) -> DataFrame:
    """(keys, lat, lon, pid, inside, distance_km) of the points that lie in a polygon or within most_km of its edges.

    points: keys, which tell points apart, lat, lon. distance_km is 0 inside, else that to the nearest edge, on the plane at
    the point. A point on an edge may count as inside or not. Points and polygons without a place are left out.

    Candidates come from the circles about the polygons' boxes. Polygons of no more than FEW edges meet them whole, see
    _met(). With a larger one a candidate meets the edges in its own column of the polygon, of which there are as many as
    the root of its number of edges, and crossings to the north are added up. Those outside look for edges in cells of
    growing size: who finds one within a cell's reach takes no part in the next round. Edges are cut to the length of a
    cell, so none is listed in many. All are equality joins and aggregates, by polygon and place, and no large polygon's
    edges meet in one row or one task.
    """
    edges = scratch.save(edges_of(polygons), "edges")
    boxes = scratch.save(outlines(edges), "boxes")
    mid_lat, mid_x = (F.col("south") + F.col("north")) / 2, (F.col("west") + F.col("east")) / 2
    corner = lambda lat: haversine_km(mid_lat, mid_x, lat, F.col("east"))
    reach = F.greatest(corner(F.col("south")), corner(F.col("north"))) * 1.01 + 0.001 + most_km
    discs = boxes.select("*", mid_lat.alias("dlat"), turned(F.col("lon0") + mid_x).alias("dlon"), reach.alias("reach_km"))
    given = scratch.save(points.select(*keys, "lat", "lon").filter("lat is not null and lon is not null"), "given")
    few = F.col("n_edges") <= FEW
    listed = edges.join(boxes.filter(few).select("pid"), "pid", "left_semi").groupBy("pid").agg(F.flatten(F.collect_list(F.array("lat1", "x1", "lat2", "x2"))).alias("edges"))
    whole = _met(given, scratch.save(discs.filter(few).join(listed, "pid"), "small"), keys, most_km)
    discs = discs.filter(~few)
    if discs.isEmpty():
        return whole
    near = within(given, discs, haversine_km(F.col("lat"), F.col("lon"), F.col("dlat"), F.col("dlon")))
    near = near.withColumn("x", turned(F.col("lon") - F.col("lon0"))).drop("dlat", "dlon", "reach_km")
    near = scratch.save(near.select("pid", *keys, "lat", "lon", "x", "south", "north", "west", "east", "n_edges"), "near")

    columns = F.ceil(F.sqrt("n_edges")).cast("int")
    column = lambda x: F.least(columns - 1, F.floor((x - F.col("west")) / (F.col("east") - F.col("west")) * columns)).cast("int")
    boxed = near.filter("lat >= south and lat <= north and x >= west and x <= east and west < east").select("pid", *keys, "lat", "x", column(F.col("x")).alias("col"))
    listed = edges.drop("lon0").join(boxes.select("pid", "west", "east", "n_edges"), "pid").filter("west < east")
    listed = listed.withColumn("col", F.explode(F.sequence(column(F.least("x1", "x2")), column(F.greatest("x1", "x2"))))).drop("west", "east", "n_edges")
    north = F.col("lat1") + (F.col("lat2") - F.col("lat1")) * F.try_divide(F.col("x") - F.col("x1"), F.col("x2") - F.col("x1"))
    crosses = ((F.col("x1") > F.col("x")) != (F.col("x2") > F.col("x"))) & (F.col("lat") < north)
    inside = boxed.join(listed, ["pid", "col"]).filter(crosses).groupBy("pid", *keys).agg(F.count("*").alias("k")).filter("k % 2 = 1").select("pid", *keys)
    inside = scratch.save(inside, "inside")
    out = near.select(*keys, "lat", "lon", "pid").join(inside, ["pid", *keys]).withColumns({"inside": F.lit(True), "distance_km": F.lit(0.0)})
    if most_km > 0:
        open_ = near.join(inside, ["pid", *keys], "left_anti")
        for share in REACHES:
            met = scratch.save(_nearest(open_, edges, boxes, keys, most_km * share), "met")
            out = out.unionByName(met)
            if share < 1:
                open_ = open_.join(met.select("pid", *keys), ["pid", *keys], "left_anti")
    return whole.unionByName(out.select(*keys, "lat", "lon", "pid", "inside", "distance_km"))


def _met(given: DataFrame, shapes: DataFrame, keys: list[str], most_km: float) -> DataFrame:
    """located() for polygons of few edges: shapes (pid, lon0, south, north, west, east, edges, dlat, dlon, reach_km), edges
    with four numbers for each. Points and polygons meet by cell, and a cell that has many of them is dealt out over more
    calls, so that each takes few; a call goes through its polygons and takes all points and edges of one at once."""
    cell = ["size", "r", "c"]
    p, d = celled(given, shapes.drop("n_edges"), CELL_DEG)
    deal = lambda rows, n, name: rows.groupBy(*cell).agg(F.ceil(F.count("*") / n).cast("int").alias(name))
    pieces = deal(p, CALL[0], "n_a").join(deal(d, CALL[1], "n_b"), cell)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    p = p.join(pieces, cell).withColumns({"a": F.pmod(F.xxhash64(*keys), F.col("n_a")).cast("int"), "b": each("n_b")})
    d = d.join(pieces, cell).withColumns({"b": F.pmod(F.xxhash64("pid"), F.col("n_b")).cast("int"), "a": each("n_a")})
    schema = StructType([*given.schema, shapes.schema["pid"], StructField("inside", BooleanType()), StructField("distance_km", DoubleType())])

    def meet(points: pa.Table, polygons: pa.Table) -> pa.Table:
        lat, lon = (points[c].to_numpy() for c in ("lat", "lon"))
        rad = np.radians(lat)
        ky = 111132.92 - 559.82 * np.cos(2 * rad) + 1.175 * np.cos(4 * rad) - 0.0023 * np.cos(6 * rad)  # as metres_per_degree()
        kx = 111412.84 * np.cos(rad) - 93.5 * np.cos(3 * rad) + 0.118 * np.cos(5 * rad)
        most = most_km * 1000 + 1e-6
        found = [(np.empty(0, "i8"), np.empty(0, "i8"), np.empty(0, bool), np.empty(0))]
        boxes = [polygons[c].to_numpy() for c in ("lon0", "south", "north", "west", "east")]
        for j, (numbers, lon0, south, north, west, east) in enumerate(zip(polygons["edges"], *boxes)):
            x = np.mod(lon - lon0 + 180.0, 360.0) - 180.0
            i = np.flatnonzero(((south - lat) * ky <= most) & ((lat - north) * ky <= most) & ((west - x) * kx <= most) & ((x - east) * kx <= most))
            if not i.size:
                continue
            lat1, x1, lat2, x2 = numbers.values.to_numpy().reshape(-1, 4).T
            at, x, of_lat, of_lon = lat[i, None], x[i, None], ky[i, None], kx[i, None]
            with np.errstate(divide="ignore", invalid="ignore"):
                inside = (((x1 > x) != (x2 > x)) & (at < lat1 + (lat2 - lat1) * ((x - x1) / (x2 - x1)))).sum(1) % 2 == 1
                px, py, dx, dy = (x - x1) * of_lon, (at - lat1) * of_lat, (x2 - x1) * of_lon, (lat2 - lat1) * of_lat
                t = np.nan_to_num(np.clip((px * dx + py * dy) / (dx * dx + dy * dy), 0.0, 1.0))
            km = np.where(inside, 0.0, np.hypot(px - t * dx, py - t * dy).min(1) / 1000)
            kept = inside | ((km <= most_km) & (most_km > 0))
            found.append((i[kept], np.full(kept.sum(), j), inside[kept], km[kept]))
        i, j, inside, km = (np.concatenate(c) for c in zip(*found))
        columns = {c: points[c].take(pa.array(i)) for c in (*keys, "lat", "lon")} | {"pid": polygons["pid"].take(pa.array(j))}
        return pa.table(columns | {"inside": pa.array(inside), "distance_km": pa.array(km)})

    # as in near_segments(): far more rows leave than come in
    parts, by = int(given.sparkSession.conf.get("spark.sql.shuffle.partitions")), [*cell, "a", "b"]
    by_d = [f"{c}_" for c in by]  # both sides' cells come from the discs' sizes and would be taken for one column
    p, d = p.select(*by, *keys, "lat", "lon"), d.select(*[F.col(c).alias(f"{c}_") for c in by], "pid", "lon0", "south", "north", "west", "east", "edges")
    return p.repartition(parts, *by).groupBy(*by).cogroup(d.repartition(parts, *by_d).groupBy(*by_d)).applyInArrow(meet, schema)


def _nearest(near: DataFrame, edges: DataFrame, boxes: DataFrame, keys: list[str], reach_km: float) -> DataFrame:
    """Candidates with an edge within reach_km, and the distance to the nearest."""
    d_lat = reach_km * 1000 / INDEX_LAT_M
    widest = F.least(F.lit(89.0), F.greatest(F.abs("south"), F.abs("north")) + d_lat)
    sized = boxes.select("pid", (F.lit(reach_km * 1000 / INDEX_LON_M) / F.cos(F.radians(widest)) * 1.01).alias("d_x"))
    e = edges.drop("lon0").join(sized, "pid")
    pieces = F.ceil(F.greatest(F.abs(F.col("lat2") - F.col("lat1")) / d_lat, F.abs(F.col("x2") - F.col("x1")) / F.col("d_x"), F.lit(1.0))).cast("int")
    at = lambda a, b, k: F.col(a) + (F.col(b) - F.col(a)) * k / F.col("m")
    e = e.withColumn("m", pieces).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    e = e.select("pid", "d_x", at("lat1", "lat2", F.col("k")).alias("lat1"), at("x1", "x2", F.col("k")).alias("x1"), at("lat1", "lat2", F.col("k") + 1).alias("lat2"), at("x1", "x2", F.col("k") + 1).alias("x2"))
    row, col = lambda v: F.floor(v / d_lat).cast("long"), lambda v: F.floor(v / F.col("d_x")).cast("long")
    e = e.withColumn("r", F.explode(F.sequence(row(F.least("lat1", "lat2")) - 1, row(F.greatest("lat1", "lat2")) + 1)))
    e = e.withColumn("c", F.explode(F.sequence(col(F.least("x1", "x2")) - 1, col(F.greatest("x1", "x2")) + 1))).drop("d_x")
    p = near.join(sized, "pid").withColumns({"r": row(F.col("lat")), "c": col(F.col("x"))})
    of_lat, of_lon = metres_per_degree(F.col("lat"))
    p = p.select("pid", *keys, "lat", "lon", "x", "r", "c", of_lat.alias("of_lat"), of_lon.alias("of_lon"))
    km = point_segment_m(F.col("lat"), F.col("x"), F.col("lat1"), F.col("x1"), F.col("lat2"), F.col("x2"), (F.col("of_lat"), F.col("of_lon"))) / 1000
    met = p.join(e, ["pid", "r", "c"]).select("pid", *keys, "lat", "lon", F.explode(F.array(km)).alias("km")).filter(F.col("km") <= reach_km)
    best = met.groupBy("pid", *keys).agg(F.first("lat").alias("lat"), F.first("lon").alias("lon"), F.min("km").alias("distance_km"))
    return best.withColumn("inside", F.lit(False))


def path_samples(paths: DataFrame, step_km: float = 0.5) -> DataFrame:
    """(line_id, lat, lon): places along each path (array of lat, lon) at equal steps of step_km or less, both ends
    included; a place at a vertex may come twice. Paths of fewer than two points have none."""
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("path") - 1)), lambda i: F.struct(F.get("path", i - 1).alias("p"), F.get("path", i).alias("q")))
    km = lambda e: haversine_km(e["p"]["lat"], e["p"]["lon"], e["q"]["lat"], e["q"]["lon"])
    with_km = F.transform(pairs, lambda e: F.struct(e["p"].alias("p"), e["q"].alias("q"), km(e).alias("km")))
    whole = F.aggregate("es", F.lit(0.0), lambda s, e: s + e["km"])
    rows = paths.filter(F.size("path") >= 2).select("line_id", with_km.alias("es")).select("line_id", "es", whole.alias("total"))
    step = F.col("total") / F.greatest(F.lit(1), F.ceil(F.col("total") / step_km))
    rows = rows.select("line_id", "es", step.alias("step"), F.posexplode("es").alias("at", "e"))
    start = F.aggregate(F.slice("es", F.lit(1), F.col("at")), F.lit(0.0), lambda s, e: s + e["km"])
    rows = rows.select("line_id", "e", "step", start.alias("start")).withColumn("end", F.col("start") + F.col("e.km"))
    first, last = F.ceil(F.try_divide("start", "step") - 1e-9), F.floor(F.try_divide("end", "step") + 1e-9)
    rows = rows.withColumn("i", F.explode(F.filter(F.sequence(F.coalesce(first, F.lit(0)).cast("long"), F.greatest(F.coalesce(last, F.lit(0)), F.coalesce(first, F.lit(0))).cast("long")), lambda i: i <= F.coalesce(last, F.lit(0)))))
    t = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(F.col("i") * F.col("step") - F.col("start"), F.col("e.km")))), F.lit(0.0))
    lat, lon = (F.col(f"e.p.{c}") for c in ("lat", "lon"))
    return rows.select("line_id", (lat + (F.col("e.q.lat") - lat) * t).alias("lat"), turned(lon + turned(F.col("e.q.lon") - lon) * t).alias("lon"))


#: Kilometres within which a fire without a perimeter is at a place.
POINT_KM = 0.05
#: Samples of an asset, and kilometres from the middle of their box, up to which they go together in one row.
MOST_SAMPLES, SPAN_KM = 1024, 10.0
#: Samples and kinds of fires that meet in one call of threatened(), assets that a fire has in turn, pairs of samples and
#: fires that a task tries, and tasks at most.
THREAT_CALL, TURN, TASK_TRIES, MOST_TASKS = (4096, 512), 128, 1 << 26, 4096
#: Edges of a fire's foreseen shapes, all together, that are met whole.
FEW_AHEAD = 4 * FEW


def threatened(assets: DataFrame, lines: DataFrame, fires: DataFrame, perimeters: DataFrame, spread: DataFrame, scratch: Scratch, most_km: float = 20.0) -> DataFrame:
    """(fire_id, asset_id, ring, distance_km, in_corridor): what lies inside a fire, or within 5, 10 or 20 km of it.

    assets: asset_id, lat, lon; lines: asset_id, path (an asset may be among both: its place then tells of the corridor);
    fires: fire_id, flat, flon; perimeters: fire_id, rings, one row a fire at most; spread: fire_id, step, rings, the
    shapes foreseen. Of a fire without a perimeter the distance is to its centre, which is inside within POINT_KM. A line
    counts by its samples: the most severe ring, and the least distance within it. Distances are to a tenth of a kilometre.

    An asset's samples are one row, and fires alike in perimeter, centre and foreseen shapes are one kind. Rows and kinds
    meet by cell, see _met_kinds(), where each pair is whole: pairs are neither shuffled nor written on the way. Assets of
    more than MOST_SAMPLES samples or wider than SPAN_KM, and fires of many edges, are met by sample and by polygon.
    """
    samples = path_samples(lines.select(F.col("asset_id").alias("line_id"), "path")).select(F.col("line_id").alias("asset_id"), "lat", "lon", F.lit(True).alias("of_line"))
    places = assets.join(lines.select("asset_id"), "asset_id", "left_anti").select("asset_id", "lat", "lon", F.lit(False).alias("of_line"))
    placed = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    asked = scratch.save(places.unionByName(samples).filter(placed).distinct(), "asked")
    bare = fires.join(perimeters.select("fire_id"), "fire_id", "left_anti").select("fire_id", "flat", "flon").filter("flat is not null and flon is not null").distinct()
    shapes = spread.select(F.struct("fire_id", "step").alias("pid"), "rings")
    edges, ahead = scratch.save(edges_of(perimeters.select(F.col("fire_id").alias("pid"), "rings")), "edges"), scratch.save(edges_of(shapes), "ahead")

    large = edges.groupBy(F.col("pid").alias("fire_id")).count().filter(F.col("count") > FEW)
    large = large.union(ahead.groupBy("pid.fire_id").count().filter(F.col("count") > FEW_AHEAD)).union(bare.groupBy("fire_id").count().filter("count > 1"))
    large = scratch.save(large.select("fire_id").distinct(), "large")
    units, long = _units(asked, assets.filter(placed), scratch)
    kinds = _kinds(edges.join(large.withColumnRenamed("fire_id", "pid"), "pid", "left_anti"), ahead, bare.join(large, "fire_id", "left_anti"), most_km)
    out = _met_kinds(units, scratch.save(kinds, "kinds"), most_km, scratch)
    pairs = lambda points, which: _by_pair(points, assets, bare.join(large, "fire_id", which), perimeters.join(large, "fire_id", which), spread.join(large, "fire_id", which), scratch, most_km)
    if not large.isEmpty():
        out = out.unionByName(pairs(asked, "left_semi"))
    if not long.isEmpty():
        out = out.unionByName(pairs(asked.join(long, "asset_id", "left_semi"), "left_anti"))
    return out


def _units(asked: DataFrame, assets: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(units, long): asset_id, samples (array of lat, lon, asked, own: whether it is asked for, and is the asset's own place),
    the middle of their box as lat, lon and span, the kilometres that they are from there at most, and the asset_id of those
    too long for one row."""
    flags = lambda a, b: [F.lit(a).alias("asked"), F.lit(b).alias("own")]
    every = asked.select("asset_id", "lat", "lon", *flags(True, False)).unionByName(assets.select("asset_id", "lat", "lon", *flags(False, True)))
    every = scratch.save(every.groupBy("asset_id", "lat", "lon").agg(F.max("asked").alias("asked"), F.max("own").alias("own")), "every")
    beyond = F.pmod("lon", F.lit(360.0))  # longitudes that do not jump at the date line
    of = [F.count("*").alias("n"), F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lon").alias("w0"), F.max("lon").alias("e0"), F.min(beyond).alias("w1"), F.max(beyond).alias("e1")]
    box = every.groupBy("asset_id").agg(F.max("asked").alias("asked"), *of).filter("asked")
    straight = F.col("e0") - F.col("w0") <= F.col("e1") - F.col("w1")
    west, east = F.when(straight, F.col("w0")).otherwise(F.col("w1")), F.when(straight, F.col("e0")).otherwise(F.col("e1"))
    lat, lon = (F.col("south") + F.col("north")) / 2, (west + east) / 2
    span = F.greatest(*[haversine_km(lat, lon, F.col(c), east) for c in ("south", "north")]) * 1.01
    box = box.select("asset_id", "n", (east - west).alias("wide"), lat.alias("mid_lat"), F.when(F.col("n") == 1, F.col("w0")).otherwise(turned(lon)).alias("mid_lon"), F.when(F.col("n") == 1, 0.0).otherwise(span).alias("span"))
    box = scratch.save(box.withColumn("whole", (F.col("n") <= MOST_SAMPLES) & (F.col("wide") < 90) & (F.col("span") <= SPAN_KM - 0.001)), "assets")
    units = every.join(box.filter("whole").select("asset_id", "mid_lat", "mid_lon", "span"), "asset_id").groupBy("asset_id")
    units = units.agg(F.collect_list(F.struct("lat", "lon", "asked", "own")).alias("samples"), F.first("mid_lat").alias("lat"), F.first("mid_lon").alias("lon"), F.first("span").alias("span"))
    return scratch.save(units.withColumn("span", F.when(F.col("span") > 0, F.lit(SPAN_KM)).otherwise(0.0)), "units"), box.filter("not whole").select("asset_id")


def _kinds(edges: DataFrame, ahead: DataFrame, bare: DataFrame, most_km: float) -> DataFrame:
    """(ids, lon0, edges, ahead, dlat, dlon, reach_km): fires alike in all that tells what they threaten, some hundred ids a
    row. edges: four numbers for each of the perimeter's, none of a fire that is its centre; ahead: lon0 and edges of each
    shape foreseen. A kind is a circle that holds all it threatens."""
    four = F.array("lat1", "x1", "lat2", "x2")
    listed = lambda rows: rows.groupBy("pid").agg(F.first("lon0").alias("lon0"), F.flatten(F.array_sort(F.collect_list(four))).alias("edges"))
    mid_lat, mid_x = (F.col("south") + F.col("north")) / 2, (F.col("west") + F.col("east")) / 2
    corner = lambda lat: haversine_km(mid_lat, mid_x, lat, F.col("east"))
    reach = F.greatest(corner(F.col("south")), corner(F.col("north"))) * 1.01 + 0.001 + most_km
    rows = listed(edges).join(outlines(edges).drop("lon0"), "pid")
    rows = rows.select(F.col("pid").alias("fire_id"), "lon0", "edges", mid_lat.alias("dlat"), turned(F.col("lon0") + mid_x).alias("dlon"), reach.alias("reach_km"))
    none = F.array().cast("array<double>")
    centres = bare.select("fire_id", F.col("flon").alias("lon0"), none.alias("edges"), F.col("flat").alias("dlat"), F.col("flon").alias("dlon"), F.lit(most_km + POINT_KM).alias("reach_km"))
    seen = listed(ahead).groupBy("pid.fire_id").agg(F.array_sort(F.collect_list(F.struct("lon0", "edges"))).alias("ahead"))
    rows = rows.unionByName(centres).join(seen, "fire_id", "left")
    rows = rows.withColumn("ahead", F.coalesce("ahead", F.array().cast(seen.schema["ahead"].dataType)))
    return in_chunks(rows, ["lon0", "edges", "ahead", "dlat", "dlon", "reach_km"], "fire_id")


def _met_kinds(units: DataFrame, kinds: DataFrame, most_km: float, scratch: Scratch) -> DataFrame:
    """threatened() for _units() and _kinds(). They meet by cell as in _met(), but a call gives each kind's assets as lists
    of TURN: a fire of the kind goes through a list before the next fire does, which files keep in little room. There are as
    many tasks as what is tried asks for."""
    cell = ["span", "size", "r", "c"]
    reaching = kinds.join(F.broadcast(units.select("span").distinct())).withColumn("reach_km", F.col("reach_km") + F.col("span"))
    p, d = celled(units, reaching, CELL_DEG)
    share = lambda rows, n, what, name: rows.groupBy(*cell).agg(F.ceil(F.sum(what) / n).cast("int").alias(f"n_{name}"), F.sum(what).alias(f"k_{name}"))
    pieces = share(p, THREAT_CALL[0], F.size("samples"), "a").join(share(d, THREAT_CALL[1], F.lit(1), "b"), cell)
    pieces = scratch.save(pieces, "pieces")
    tries = pieces.agg(F.coalesce(F.sum(F.col("k_a") * F.col("k_b")), F.lit(0))).first()[0]
    parts = max(int(units.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_TASKS, -(-tries // TASK_TRIES)))
    pieces = pieces.select(*cell, "n_a", "n_b")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    p = p.join(pieces, cell).withColumns({"a": F.pmod(F.xxhash64("asset_id"), F.col("n_a")).cast("int"), "b": each("n_b")})
    d = d.join(pieces, cell).withColumns({"b": F.pmod(F.xxhash64("dlat", "dlon", "edges", "ids"), F.col("n_b")).cast("int"), "a": each("n_a")})
    found = StructType([StructField("asset_id", units.schema["asset_id"].dataType), StructField("rank", ByteType()), StructField("distance_km", DoubleType()), StructField("in_corridor", BooleanType())])
    schema = StructType([StructField("ids", kinds.schema["ids"].dataType), StructField("near", ArrayType(found))])

    def crossed(lat: np.ndarray, x: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Which of the points lie within edges (lat1, x1, lat2, x2 as rows)."""
        inside = np.zeros(lat.size, bool)
        lat1, x1, lat2, x2 = edges[:, :, None]
        i = np.flatnonzero((lat >= edges[::2].min()) & (lat <= edges[::2].max()) & (x >= edges[1::2].min()) & (x <= edges[1::2].max()))
        if i.size:
            lat, x = lat[i], x[i]
            with np.errstate(divide="ignore", invalid="ignore"):
                inside[i] = (((x1 > x) != (x2 > x)) & (lat < lat1 + (lat2 - lat1) * ((x - x1) / (x2 - x1)))).sum(0) % 2 == 1
        return inside

    def meet(points: pa.Table, polygons: pa.Table) -> pa.Table:
        samples, names = points["samples"].combine_chunks(), points["asset_id"].combine_chunks()
        unit = np.repeat(np.arange(len(names)), pc.list_value_length(samples).to_numpy())
        lat, lon, asked, own = (pc.struct_field(samples.flatten(), c).to_numpy(zero_copy_only=False) for c in ("lat", "lon", "asked", "own"))
        own = np.flatnonzero(own)
        rad = np.radians(lat)
        ky = 111132.92 - 559.82 * np.cos(2 * rad) + 1.175 * np.cos(4 * rad) - 0.0023 * np.cos(6 * rad)  # as metres_per_degree()
        kx = 111412.84 * np.cos(rad) - 93.5 * np.cos(3 * rad) + 0.118 * np.cos(5 * rad)
        cos = np.cos(rad)
        off = lambda at, lon0: (x := at - lon0) - 360.0 * np.rint(x / 360.0)
        most = most_km * 1000 + 1e-6
        least = ky.min(initial=np.inf)  # a part may have got no samples

        def near(edges: np.ndarray, lon0: float) -> tuple[np.ndarray, ...]:
            """(samples, kilometres, whether inside) of a perimeter."""
            south, north, west, east = edges[::2].min(), edges[::2].max(), edges[1::2].min(), edges[1::2].max()
            i = np.flatnonzero((lat >= south - most / least) & (lat <= north + most / least) & asked)
            x, of_lon = off(lon[i], lon0), kx[i]
            i = i[((west - x) * of_lon <= most) & ((x - east) * of_lon <= most)]
            if not i.size:
                return i, np.empty(0), np.empty(0, bool)
            x, at, of_lat, of_lon, best = off(lon[i], lon0), lat[i], ky[i] ** 2, kx[i] ** 2, np.full(i.size, np.inf)
            inside = crossed(at, x, edges)
            with np.errstate(divide="ignore", invalid="ignore"):
                for lat1, x1, lat2, x2 in edges.T:  # one edge at a time stays in the processor's cache
                    px, py, dx, dy = x - x1, at - lat1, x2 - x1, lat2 - lat1
                    t = px * (dx * of_lon)
                    t += py * (dy * of_lat)
                    t /= dx * dx * of_lon + dy * dy * of_lat
                    t = np.fmin(np.fmax(t, 0.0, out=t), 1.0, out=t)
                    px -= dx * t
                    py -= dy * t
                    px *= px
                    px *= of_lon
                    py *= py
                    py *= of_lat
                    px += py
                    np.minimum(best, px, out=best)
            return i, np.where(inside, 0.0, np.sqrt(best) / 1000), inside

        def about(dlat: float, dlon: float) -> tuple[np.ndarray, ...]:
            """The same of a centre."""
            i = np.flatnonzero(asked & (np.abs(lat - dlat) * 110 <= most_km + POINT_KM))
            at = np.radians(dlat)
            h = np.sin((at - rad[i]) / 2) ** 2 + cos[i] * np.cos(at) * np.sin(np.radians(dlon - lon[i]) / 2) ** 2  # as haversine_km()
            km = 2 * EARTH_KM * np.arcsin(np.minimum(1.0, np.sqrt(h)))
            return i, km, km <= POINT_KM

        rows, which, ends, at = [(np.empty(0, "i8"), np.empty(0, "i1"), np.empty(0), np.empty(0, bool))], [], [0], 0
        listed, shapes = polygons["edges"].combine_chunks(), polygons["ahead"].combine_chunks()
        for j, (lon0, dlat, dlon) in enumerate(zip(*[polygons[c].to_numpy() for c in ("lon0", "dlat", "dlon")])):
            numbers = listed[j].values.to_numpy()
            if numbers.size:
                i, km, inside = near(numbers.reshape(-1, 4).T, lon0)
                edge = km
            else:
                i, km, inside = about(dlat, dlon)
                edge, km = km - POINT_KM, np.where(inside, 0.0, km)
            rank = np.where(inside, 0, 1 + (edge > 5).astype("i1") + (edge > 10)).astype("i1")
            kept = inside | ((edge <= most_km) & (edge <= 20) & (most_km > 0))
            i, rank, km = i[kept], rank[kept], km[kept]
            if not i.size:
                continue
            first = np.flatnonzero(np.diff(unit[i], prepend=-1))  # a unit's samples follow each other
            # within a fire a more severe ring is never farther, so the least of both are one place's
            u, rank, km = unit[i[first]], np.minimum.reduceat(rank, first), np.minimum.reduceat(km, first)
            hit = np.zeros(len(names), bool)
            for shape in shapes[j].values if own.size else ():
                numbers = shape["edges"].values.to_numpy().reshape(-1, 4).T
                o = own[(lat[own] >= numbers[::2].min()) & (lat[own] <= numbers[::2].max())]
                hit[unit[o[crossed(lat[o], off(lon[o], shape["lon0"].as_py()), numbers)]]] = True
            tenths = km * 10
            low = np.floor(tenths)
            rows.append((u, rank, (low + (tenths - low >= 0.5)) / 10, hit[u]))
            starts = range(0, u.size, TURN)
            which += [j] * len(starts)
            ends += [at + min(k + TURN, u.size) for k in starts]
            at += u.size
        u, rank, km, hit = (np.concatenate(c) for c in zip(*rows))
        each = pa.StructArray.from_arrays([names.take(pa.array(u)), pa.array(rank), pa.array(km), pa.array(hit)], ["asset_id", "rank", "distance_km", "in_corridor"])
        lists = pa.ListArray.from_arrays(pa.array(np.array(ends, "i4")), each)
        return pa.table({"ids": polygons["ids"].take(pa.array(which, pa.int64())), "near": lists})

    by = [*cell, "a", "b"]
    by_d = [f"{c}_" for c in by]  # as in _met()
    p, d = p.select(*by, "asset_id", "samples"), d.select(*[F.col(c).alias(f"{c}_") for c in by], "ids", "lon0", "edges", "ahead", "dlat", "dlon")
    met = p.repartition(parts, *by).groupBy(*by).cogroup(d.repartition(parts, *by_d).groupBy(*by_d)).applyInArrow(meet, schema)
    each = met.select(F.explode("ids").alias("fire_id"), "near").select("fire_id", F.explode("near").alias("n"))
    return each.select("fire_id", "n.asset_id", F.get(F.array(*[F.lit(k) for k in SEVERITY]), F.col("n.rank").cast("int")).alias("ring"), "n.distance_km", "n.in_corridor")


def _by_pair(asked: DataFrame, assets: DataFrame, bare: DataFrame, perimeters: DataFrame, spread: DataFrame, scratch: Scratch, most_km: float) -> DataFrame:
    """threatened() for any assets and fires, by sample and polygon. asked: asset_id, of_line, lat, lon; bare: the fires
    without a perimeter."""
    keys = ["asset_id", "of_line", "plat", "plon"]  # a sample is told by its place
    asked = asked.withColumns({"plat": F.col("lat"), "plon": F.col("lon")})
    with_edge = located(asked, perimeters.select(F.col("fire_id").alias("pid"), "rings"), keys, most_km, scratch)
    with_edge = with_edge.select(F.col("pid").alias("fire_id"), "asset_id", ring_of(F.col("distance_km"), F.col("inside")).alias("ring"), "distance_km")
    discs = bare.select("fire_id", F.col("flat").alias("dlat"), F.col("flon").alias("dlon"), F.lit(most_km + POINT_KM).alias("reach_km"))
    km = haversine_km(F.col("lat"), F.col("lon"), F.col("dlat"), F.col("dlon"))
    at = within(asked, discs, km).withColumn("km", km).withColumn("inside", F.col("km") <= POINT_KM)
    at = at.select("fire_id", "asset_id", ring_of(F.col("km") - POINT_KM, F.col("inside")).alias("ring"), F.when(F.col("inside"), 0.0).otherwise(F.col("km")).alias("distance_km"))
    rank = F.element_at(F.create_map(*[x for k, v in SEVERITY.items() for x in (F.lit(k), F.lit(v))]), F.col("ring"))
    # within a fire a more severe ring is never farther, so the least of both are one place's
    found = with_edge.unionByName(at).filter("ring is not null").groupBy("fire_id", "asset_id").agg(F.min(rank).alias("rank"), F.min("distance_km").alias("distance_km"))
    shapes = spread.select(F.struct("fire_id", "step").alias("pid"), "rings")
    own = assets.join(asked.select("asset_id").distinct(), "asset_id", "left_semi").select("asset_id", "lat", "lon")
    hit = located(own, shapes, ["asset_id"], 0.0, scratch).select(F.col("pid.fire_id").alias("fire_id"), "asset_id").distinct()
    out = found.join(hit.withColumn("in_corridor", F.lit(True)), ["fire_id", "asset_id"], "left")
    return out.select("fire_id", "asset_id", F.get(F.array(*[F.lit(k) for k in SEVERITY]), F.col("rank")).alias("ring"), F.round("distance_km", 1).alias("distance_km"), F.coalesce("in_corridor", F.lit(False)).alias("in_corridor"))
