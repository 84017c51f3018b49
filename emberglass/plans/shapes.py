"""Queries over polygons, rasters and distances on grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberglass.functions import geo
from emberglass.operators import polygons, rasters
from emberglass.plans.base import Book
from emberglass.plans.spatial import HAV
from emberglass.storage import Scratch

book = Book()

#: A star with four points, in units of its size; its hole is a tenth as large.
STAR = [(0.0, 1.0), (0.3, 0.3), (1.0, 0.0), (0.3, -0.3), (0.0, -1.0), (-0.3, -0.3), (-1.0, 0.0), (-0.3, 0.3)]


def _star_sql(scale: str) -> str:
    points = ", ".join(f"{{'k': {k}, 'a': {a}e0 * {scale}, 'o': {o}e0 * {scale}}}" for k, (a, o) in enumerate(STAR))
    return f"[{points}]"


def turned(x: str) -> str:
    return f"((({x}) + 180e0) % 360e0 + 360e0) % 360e0 - 180e0"


PLACES_SQL = f"""asset AS (SELECT c_custkey AS asset_id, 36.5e0 + (c_custkey * 31 % 997) / 997e0 AS lat, CASE WHEN c_custkey % 10 = 0 THEN {turned("179.6e0 + (c_custkey * 17 % 991) / 991e0")} ELSE -2.5e0 + (c_custkey * 17 % 991) / 991e0 END AS lon FROM customer),
fire AS (SELECT s_suppkey AS fire_id, 36.5e0 + (s_suppkey * 37 % 1000) / 1000e0 AS flat, CASE WHEN s_suppkey % 10 = 0 THEN {turned("179.6e0 + (s_suppkey * 53 % 1000) / 1000e0")} ELSE -2.5e0 + (s_suppkey * 53 % 1000) / 1000e0 END AS flon, 0.02e0 + (s_suppkey % 7) / 100e0 AS size FROM supplier),
star AS (SELECT *, unnest({_star_sql("1e0")}) AS p FROM fire WHERE fire_id % 3 > 0), ring AS (SELECT fire_id, h, p.k AS k, flat + p.a * size * CASE WHEN h = 0 THEN 1e0 ELSE 0.1e0 END AS lat, {turned("flon + p.o * size * CASE WHEN h = 0 THEN 1e0 ELSE 0.1e0 END")} AS lon FROM star, (VALUES (0), (1)) AS v(h)),
zero AS (SELECT fire_id, lon AS lon0 FROM ring WHERE h = 0 AND k = 0),
edge AS (SELECT a.fire_id, lon0, a.lat AS lat1, {turned("a.lon - lon0")} AS x1, b.lat AS lat2, ({turned("a.lon - lon0")}) + ({turned("b.lon - a.lon")}) AS x2 FROM ring a JOIN ring b ON a.fire_id = b.fire_id AND a.h = b.h AND b.k = (a.k + 1) % 8 JOIN zero ON zero.fire_id = a.fire_id),
line AS (SELECT asset_id, lat AS la, lon AS lo, lat + 0.02e0 * (asset_id % 5) AS lb, {turned("lon + 0.01e0")} AS ld FROM asset WHERE asset_id % 4 = 3),
cut AS (SELECT *, greatest(1, CAST(ceil({HAV.format(a='la', b='lb', c='lo', d='ld')} / 0.5e0) AS INT)) AS n FROM line),
asked AS (SELECT asset_id, lat, lon FROM asset WHERE asset_id % 4 < 3 UNION ALL SELECT asset_id, la + (lb - la) * k / n, {turned(f"lo + ({turned('ld - lo')}) * k / n")} FROM (SELECT *, unnest(range(0, n + 1)) AS k FROM cut)),
plane AS (SELECT *, 111132.92e0 - 559.82e0 * cos(2 * radians(lat)) + 1.175e0 * cos(4 * radians(lat)) - 0.0023e0 * cos(6 * radians(lat)) AS ky, 111412.84e0 * cos(radians(lat)) - 93.5e0 * cos(3 * radians(lat)) + 0.118e0 * cos(5 * radians(lat)) AS kx FROM asked),
met AS (SELECT fire_id, asset_id, lat, lon, ({turned("lon - lon0")} - x1) * kx AS px, (lat - lat1) * ky AS py, (x2 - x1) * kx AS dx, (lat2 - lat1) * ky AS dy, (x1 > {turned("lon - lon0")}) <> (x2 > {turned("lon - lon0")}) AND lat < lat1 + (lat2 - lat1) * ({turned("lon - lon0")} - x1) / (x2 - x1) AS crosses FROM plane, edge),
near AS (SELECT *, greatest(0e0, least(1e0, (px * dx + py * dy) / (dx * dx + dy * dy))) AS t FROM met),
d AS (SELECT fire_id, asset_id, count(*) FILTER (WHERE crosses) % 2 = 1 AS inside, min(sqrt(pow(px - t * dx, 2) + pow(py - t * dy, 2))) / 1000 AS km FROM near GROUP BY fire_id, asset_id, lat, lon),
bare AS (SELECT fire_id, asset_id, {HAV.format(a='lat', b='flat', c='lon', d='flon')} AS km FROM asked, fire WHERE fire_id % 3 = 0),
both_ AS (SELECT fire_id, asset_id, inside, CASE WHEN inside THEN 0e0 ELSE km END AS km, CASE WHEN inside THEN 0e0 ELSE km END AS edge FROM d UNION ALL SELECT fire_id, asset_id, km <= 0.05e0, CASE WHEN km <= 0.05e0 THEN 0e0 ELSE km END, km - 0.05e0 FROM bare),
ranked AS (SELECT *, CASE WHEN inside THEN 0 WHEN edge <= 5 THEN 1 WHEN edge <= 10 THEN 2 WHEN edge <= 20 THEN 3 END AS rank FROM both_),
best AS (SELECT fire_id, asset_id, min({{'rank': rank, 'km': km}}) AS b FROM ranked WHERE rank IS NOT NULL GROUP BY ALL),
corridor AS (SELECT DISTINCT fire_id, asset_id FROM asset, fire WHERE fire_id % 2 = 0 AND ({turned("lon - flon")} BETWEEN 0.05e0 AND 0.15e0 OR {turned("lon - flon")} BETWEEN 0.2e0 AND 0.4e0) AND lat BETWEEN flat - 0.05e0 AND flat + 0.05e0)"""


def perimeters_of(table):
    """(assets, lines, fires, perimeters, spread): stars with a hole about two thirds of the suppliers, some across the date
    line, customers as places and lines, and two boxes to the east as the spread foreseen."""
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    lon = lambda v, a, m: F.when(v % 10 == 0, polygons.turned(F.lit(179.6) + v * a % m / F.lit(float(m)))).otherwise(F.lit(-2.5) + v * a % m / F.lit(float(m)))
    assets = table("customer").select(k.alias("asset_id"), (F.lit(36.5) + k * 31 % 997 / F.lit(997.0)).alias("lat"), lon(k, 17, 991).alias("lon"))
    point = lambda a, o: F.struct(a.alias("lat"), polygons.turned(o).alias("lon"))
    path = F.array(F.struct("lat", "lon"), point(F.col("lat") + F.lit(0.02) * (F.col("asset_id") % 5), F.col("lon") + 0.01))
    lines = assets.filter("asset_id % 4 = 3").select("asset_id", path.alias("path"))
    fires = table("supplier").select(s.alias("fire_id"), (F.lit(36.5) + s * 37 % 1000 / F.lit(1000.0)).alias("flat"), lon(s, 53, 1000).alias("flon"), (F.lit(0.02) + s % 7 / F.lit(100.0)).alias("size"))
    flat, flon, size = F.col("flat"), F.col("flon"), F.col("size")
    ring = lambda scale: F.array(*[point(flat + F.lit(a) * size * scale, flon + F.lit(o) * size * scale) for a, o in STAR])
    perimeters = fires.filter("fire_id % 3 > 0").select("fire_id", F.array(ring(1.0), ring(0.1)).alias("rings"))
    box = lambda w, e: F.array(F.array(*[point(flat + a, flon + o) for a, o in ((-0.05, w), (-0.05, e), (0.05, e), (0.05, w))]))
    step = F.explode(F.array(F.struct(F.lit(1).alias("step"), box(0.05, 0.15).alias("rings")), F.struct(F.lit(2).alias("step"), box(0.2, 0.4).alias("rings"))))
    spread = fires.filter("fire_id % 2 = 0").select("fire_id", step.alias("s")).select("fire_id", "s.step", "s.rings")
    return assets, lines, fires, perimeters, spread


@book.add(f"""WITH {PLACES_SQL} SELECT best.fire_id, best.asset_id, ['inside', '5km', '10km', '20km'][b.rank + 1] AS ring, round(b.km, 1) AS distance_km, corridor.asset_id IS NOT NULL AS in_corridor
FROM best LEFT JOIN corridor ON corridor.fire_id = best.fire_id AND corridor.asset_id = best.asset_id""")
def perimeter_threats(spark, table):
    return polygons.threatened(*perimeters_of(table), Scratch(spark, "threats"))


# parts are heights on a grid of 40 columns; every eleventh is unknown
GROUND_SQL = "z AS (SELECT p_partkey // 40 AS r, p_partkey % 40 AS c, p_retailprice * 1e0 AS z FROM part WHERE p_partkey % 11 > 0)"
GRID = (8, 40.0, -3.0, 0.01)


def ground(table):
    k = F.col("p_partkey")
    return table("part").filter(k % 11 > 0).select(F.floor(k / 40).alias("row"), (k % 40).alias("col"), F.col("p_retailprice").cast("double").alias("value"))


@book.add(f"""WITH {GROUND_SQL}, n AS (SELECT z.r, z.c, z.z, w.z AS w, e.z AS e, n.z AS n, s.z AS s, radians(40e0 - (z.r + 0.5e0) * 0.01e0) AS p FROM z LEFT JOIN z w ON w.r = z.r AND w.c = z.c - 1 LEFT JOIN z e ON e.r = z.r AND e.c = z.c + 1 LEFT JOIN z n ON n.c = z.c AND n.r = z.r - 1 LEFT JOIN z s ON s.c = z.c AND s.r = z.r + 1),
g AS (SELECT r, c, (coalesce(e, z) - coalesce(w, z)) / nullif(((e IS NOT NULL)::INT + (w IS NOT NULL)::INT) * 0.01e0 * (111412.84e0 * cos(p) - 93.5e0 * cos(3 * p) + 0.118e0 * cos(5 * p)), 0) AS dx,
 (coalesce(s, z) - coalesce(n, z)) / nullif(((s IS NOT NULL)::INT + (n IS NOT NULL)::INT) * 0.01e0 * (111132.92e0 - 559.82e0 * cos(2 * p) + 1.175e0 * cos(4 * p) - 0.0023e0 * cos(6 * p)), 0) AS dy FROM n)
SELECT r AS "row", c AS col, round(degrees(atan(sqrt(dx * dx + dy * dy))), 6) AS slope, round((degrees(atan2(-dx, dy)) + 360) % 360, 6) AS aspect FROM g WHERE dx IS NOT NULL AND dy IS NOT NULL""")
def slope_across_tiles(spark, table):
    side, north, _, size = GRID
    sloped = rasters.slopes(rasters.tiled(ground(table), side), side, north, size)
    out = rasters.cells(sloped, side, "slope", "aspect").filter("slope is not null")
    return out.withColumns({"slope": F.round("slope", 6), "aspect": F.round("aspect", 6)})


@book.add(f"""WITH {GROUND_SQL}, p AS (SELECT c_custkey, 40.02e0 - (c_custkey % 997) / 1500e0 AS lat, -3.02e0 + (c_custkey * 31 % 991) / 2200e0 AS lon FROM customer)
SELECT c_custkey, z.z AS value FROM p LEFT JOIN z ON z.r = CAST(floor((40e0 - lat) / 0.01e0) AS BIGINT) AND z.c = CAST(floor((lon + 3e0) / 0.01e0) AS BIGINT)""")
def ground_samples(spark, table):
    k = F.col("c_custkey")
    points = table("customer").select(k, (F.lit(40.02) - k % 997 / F.lit(1500.0)).alias("lat"), (F.lit(-3.02) + k * 31 % 991 / F.lit(2200.0)).alias("lon"))
    return rasters.sampled(points, rasters.tiled(ground(table), GRID[0]), *GRID).select("c_custkey", "value")


@book.add("""WITH z AS (SELECT ps AS layer, r, c, v FROM (SELECT 0 AS ps, p_partkey // 40 AS r, p_partkey % 40 AS c, p_size * 1e0 AS v FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT 1, p_partkey // 40, p_partkey % 40, p_size * 2e0 FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT 2, p_partkey // 40, p_partkey % 40, p_size * 3e0 FROM part WHERE p_partkey % 5 < 4))
SELECT r AS "row", c AS col, min_by(v, layer) AS value FROM z GROUP BY ALL""")
def ground_mosaic(spark, table):
    k = F.col("p_partkey")
    layers = None
    for n, kept in enumerate((k % 3 == 0, k % 2 == 0, k % 5 < 4)):
        one = rasters.tiled(table("part").filter(kept).select(F.floor(k / 40).alias("row"), (k % 40).alias("col"), (F.col("p_size") * F.lit(n + 1.0)).alias("value")), GRID[0])
        one = one.withColumn("layer", F.lit(n))
        layers = one if layers is None else layers.unionByName(one)
    return rasters.cells(rasters.mosaic(layers), GRID[0]).filter("value is not null")


BOX_SQL = "b AS (SELECT s_suppkey AS id, (s_suppkey * 37 % 101) / 7e0 AS a, (s_suppkey * 53 % 103) / 7e0 AS o, 0.3e0 + (s_suppkey % 13) / 5e0 AS h FROM supplier)"


@book.add(f"""WITH {BOX_SQL}, c AS (SELECT *, unnest(range(CAST(floor(a) AS BIGINT), CAST(floor(a + h) AS BIGINT) + 1)) AS r FROM b)
SELECT id, r AS "row", unnest(range(CAST(floor(o) AS BIGINT), CAST(floor(o + h / 2) AS BIGINT) + 1)) AS col FROM c""")
def touched_boxes(spark, table):
    s = F.col("s_suppkey")
    a, o, h = s * 37 % 101 / F.lit(7.0), s * 53 % 103 / F.lit(7.0), F.lit(0.3) + s % 13 / F.lit(5.0)
    at = lambda x, y: F.struct(x.alias("lat"), y.alias("lon"))
    ring = F.array(at(a, o), at(a, o + h / 2), at(a + h, o + h / 2), at(a + h, o))
    return rasters.rasterised(table("supplier").select(s.alias("id"), ring.alias("ring")), 1.0)


@book.add("""WITH p AS (SELECT o_orderkey, (o_orderkey * 37 % 11136 - 5567.5e0) * 1000e0 / 35786400e0 AS x, (5567.5e0 - o_custkey * 101 % 11136) * 1000e0 / 35786400e0 AS y FROM orders),
d AS (SELECT *, tan(x) AS e, tan(y) * sqrt(1 + tan(x) * tan(x)) AS n, (35786400e0 + 6378137e0) / 6378137e0 AS far, pow(6356752.31414e0 / 6378137e0, 2) AS b2 FROM p),
a AS (SELECT *, 1 + e * e + n * n / b2 AS a FROM d), u AS (SELECT *, far * far - a * (far * far - 1) AS u FROM a), t AS (SELECT *, CASE WHEN u >= 0 THEN (far - sqrt(CASE WHEN u >= 0 THEN u END)) / a END AS t FROM u)
SELECT o_orderkey, round(degrees(atan(t * n / (b2 * sqrt(pow(far - t, 2) + pow(t * e, 2))))), 6) AS lat, round(degrees(atan2(t * e, far - t)), 6) AS lon FROM t""")
def geostationary_cells(spark, table):
    lat, lon = geo.geos_cell(F.col("o_custkey") * 101 % 11136, F.col("o_orderkey") * 37 % 11136)
    return table("orders").select("o_orderkey", F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"))


@book.add("""WITH c AS (SELECT o_custkey % 7 AS g, o_orderkey % 61 AS r, o_orderkey // 61 % 83 AS c, max(CASE WHEN o_orderkey % 97 = 0 THEN 1 ELSE 0 END) AS on_ FROM orders GROUP BY ALL),
a AS (SELECT g, r, c FROM c WHERE on_ = 1) SELECT c.g, c.r AS "row", c.c AS col, round(min(sqrt(pow(c.r - a.r, 2) + pow(c.c - a.c, 2))), 9) AS distance FROM c LEFT JOIN a ON a.g = c.g GROUP BY ALL""")
def grid_distances(spark, table):
    k = F.col("o_orderkey")
    cells = table("orders").groupBy((F.col("o_custkey") % 7).alias("g"), (k % 61).alias("row"), (F.floor(k / 61) % 83).alias("col")).agg((F.max(F.when(k % 97 == 0, 1).otherwise(0)) == 1).alias("active"))
    return rasters.distances(cells, "g").withColumn("distance", F.round("distance", 9))
