"""Queries over space: geometry, distance joins, sweeps, rings, reach."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberglass.constants import sweep_configs
from emberglass.functions import geo
from emberglass.operators import situation, spatial
from emberglass.plans.base import Book, detections
from emberglass.plans.events import BEAR, HAV
from emberglass.storage import Scratch

book = Book()

MLAT = "(111132.92e0 - 559.82e0 * cos(2 * radians({p})) + 1.175e0 * cos(4 * radians({p})) - 0.0023e0 * cos(6 * radians({p})))"
MLON = "(111412.84e0 * cos(radians({p})) - 93.5e0 * cos(3 * radians({p})) + 0.118e0 * cos(5 * radians({p})))"
#: Metres from (lat, lon) to the segment of the row.
SEG_SQL = f"""seg AS (SELECT s_suppkey AS seg_id, 37e0 + (s_suppkey * 37 % 1000) / 10000e0 AS lat1, -2e0 + (s_suppkey * 53 % 1000) / 5000e0 AS lon1,
   37e0 + (s_suppkey * 37 % 1000) / 10000e0 + 0.004e0 AS lat2, -2e0 + (s_suppkey * 53 % 1000) / 5000e0 + 0.003e0 AS lon2 FROM supplier),
xy AS (SELECT seg_id, id, (lon1 - lon) * {MLON.format(p='lat')} AS ax, (lat1 - lat) * {MLAT.format(p='lat')} AS ay, (lon2 - lon) * {MLON.format(p='lat')} AS bx, (lat2 - lat) * {MLAT.format(p='lat')} AS by_ FROM seg JOIN vis ON lat BETWEEN lat1 - 0.05 AND lat2 + 0.05),
tt AS (SELECT *, greatest(0e0, least(1e0, -(ax * (bx - ax) + ay * (by_ - ay)) / ((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)))) AS t FROM xy),
pairs AS (SELECT * FROM (SELECT seg_id, id, sqrt(pow(ax + t * (bx - ax), 2) + pow(ay + t * (by_ - ay), 2)) AS distance_m FROM tt) WHERE distance_m <= 2000),
d AS (SELECT *, CASE WHEN frp >= 50 THEN 0.9e0 WHEN frp >= 10 THEN 0.65e0 END AS confidence, CASE source WHEN 'MTG_I1' THEN 600 WHEN 'VIIRS_SNPP_NRT' THEN 375 ELSE 1000 END AS foot,
   CASE source WHEN 'MTG_I1' THEN 'MTG-I1' WHEN 'VIIRS_SNPP_NRT' THEN 'VIIRS' WHEN 'MODIS_NRT' THEN 'MODIS' WHEN 'SENTINEL_3A' THEN 'Sentinel-3' ELSE source END AS family,
   EXISTS (SELECT 1 FROM (SELECT DISTINCT 37.0001e0 + (s_suppkey % 20) / 200e0 AS a, -1.9999e0 + (s_suppkey % 20) / 110e0 AS o FROM supplier) b WHERE lat > a AND lat < a + 0.003e0 AND lon > o AND lon < o + 0.006e0) AS static_heat FROM vis),
cfg AS (SELECT * FROM (VALUES (0, 'all-1x', 'all', 1e0, NULL, NULL, false), (1, 'all-0.5x', 'all', 0.5e0, NULL, NULL, false), (2, 'all-2x', 'all', 2e0, NULL, NULL, false), (3, 'geopolar-1x', 'geo+polar', 1e0, NULL, NULL, false), (4, 'geopolar-2x', 'geo+polar', 2e0, NULL, NULL, false),
  (5, 'geo-1x', 'geo', 1e0, NULL, NULL, false), (6, 'geo-2x', 'geo', 2e0, NULL, NULL, false), (7, 'polar-1x', 'polar', 1e0, NULL, NULL, false), (8, 'polar-2x', 'polar', 2e0, NULL, NULL, false), (9, 'all-1x-highconf', 'all', 1e0, 0.9e0, NULL, false), (10, 'all-1x-withstatic', 'all', 1e0, NULL, NULL, true), (11, 'all-100m', 'all', 1e0, NULL, 100e0, false)) AS t(config_ord, config, sources, scale, min_conf, fixed_m, static_kept)),
met AS (SELECT config_ord, config, seg_id, d.id, at_s, latency_s FROM pairs p JOIN d ON p.id = d.id JOIN cfg ON (sources IN ('all', 'geo+polar') OR (sources = 'geo') = (source = 'MTG_I1')) AND (min_conf IS NULL OR confidence >= min_conf) WHERE (static_kept OR NOT static_heat) AND distance_m <= coalesce(fixed_m, foot * scale)),
cut AS (SELECT config_ord, config, m.seg_id, at_s AS cut_s, list_sort(list(DISTINCT id)) AS evidence FROM met m WHERE at_s = (SELECT min(at_s) FROM met x WHERE x.config = m.config AND x.seg_id = m.seg_id) GROUP BY config_ord, config, m.seg_id, at_s)"""


def segments(table):
    k = F.col("s_suppkey")
    lat, lon = F.lit(37.0) + k * 37 % 1000 / F.lit(10000.0), F.lit(-2.0) + k * 53 % 1000 / F.lit(5000.0)
    return table("supplier").select(k.alias("seg_id"), lat.alias("lat1"), lon.alias("lon1"), (lat + 0.004).alias("lat2"), (lon + 0.003).alias("lon2"))


def heat_rings(table):
    k = (F.col("s_suppkey") % 20).alias("k")
    return table("supplier").select(k).distinct().select(_box(F.lit(37.0001) + F.col("k") / F.lit(200.0), F.lit(-1.9999) + F.col("k") / F.lit(110.0), F.lit(0.003), F.lit(0.006)).alias("ring"))


def sensed(table):
    return detections(table).withColumn("confidence", F.when(F.col("frp") >= 50, 0.9).when(F.col("frp") >= 10, 0.65))


def cuts(spark, table):
    """(cuts by shape, members: seg_id, shape)."""
    return spatial.sweep(segments(table), sensed(table), sweep_configs(spark), Scratch(spark, "sweep"), heat_rings(table))


@book.add(f"WITH {SEG_SQL} SELECT seg_id, id, round(distance_m, 4) AS distance_m FROM pairs", det=True)
def spatial_pairs(spark, table):
    return spatial.pairs_by_place(segments(table), detections(table), 2000.0, Scratch(spark, "pairs"), 4)


@book.add(f"WITH {SEG_SQL} SELECT config, seg_id, cut_s, array_to_string(evidence, ',') AS evidence FROM cut", det=True)
def cut_field(spark, table):
    found, members = cuts(spark, table)
    found = found.select("config", "shape", "cut_s", F.array_join(F.transform("evidence", lambda x: x.cast("string")), ",").alias("evidence"))
    return members.join(found, "shape").select("config", "seg_id", "cut_s", "evidence")


@book.add(f"""WITH {SEG_SQL} SELECT seg_id, min(cut_s) AS earliest_s, arg_min(config, cut_s * 100 + config_ord) AS earliest_config, max(cut_s) AS latest_s, arg_min(config, -cut_s * 100 + config_ord) AS latest_config, count(*) AS contributors, max(CASE WHEN config = 'all-1x' THEN cut_s END) AS nominal_s FROM cut GROUP BY seg_id""", det=True)
def sweep_band(spark, table):
    found, members = cuts(spark, table)
    banded = spatial.band(found.withColumnRenamed("shape", "seg_id")).withColumnRenamed("seg_id", "shape")
    return members.join(banded, "shape").drop("shape")


@book.add(f"""WITH {SEG_SQL}, fam AS (SELECT unnest(['MTG-I1', 'VIIRS', 'MODIS', 'Sentinel-3', 'UNKNOWN_SRC']) AS family), ev AS (SELECT seg_id, unnest(evidence) AS id FROM cut WHERE config = 'all-1x')
SELECT fam.family, (SELECT count(*) FROM d WHERE d.family = fam.family) AS detections, (SELECT count(DISTINCT ev.id) FROM ev JOIN d ON ev.id = d.id WHERE d.family = fam.family) AS used, (SELECT count(DISTINCT seg_id) FROM ev JOIN d ON ev.id = d.id WHERE d.family = fam.family) AS cut_segments FROM fam""", det=True)
def sensor_family_rows(spark, table):
    found, members = cuts(spark, table)
    return spatial.family_rows(sensed(table), found, members=members)


@book.add(f"""WITH c AS (SELECT c_custkey AS id, 30e0 + (c_custkey % 100) / 7e0 AS lat1, -5e0 + (c_custkey % 37) / 3e0 AS lon1, 31e0 + (c_custkey % 53) / 5e0 AS lat2, -4e0 + (c_custkey % 29) / 4e0 AS lon2 FROM customer),
b AS (SELECT *, {BEAR.format(a='lat1', b='lat2', c='lon1', d='lon2')} AS bearing FROM c)
SELECT id, round({HAV.format(a='lat1', b='lat2', c='lon1', d='lon2')}, 6) AS km, round(bearing, 6) AS bearing, ['N','NNE','NE','ENE','E','ESE','SE','SSE','S','SSW','SW','WSW','W','WNW','NW','NNW'][CAST(floor(bearing / 22.5e0 + 0.5e0) AS INT) % 16 + 1] AS compass,
 round(abs(fmod(bearing - 350e0 + 180e0 + 720e0, 360e0) - 180e0), 6) AS turn, round({MLAT.format(p='lat1')}, 4) AS m_lat, round({MLON.format(p='lat1')}, 4) AS m_lon FROM b""")
def geo_scalars(spark, table):
    k = F.col("c_custkey")
    at = [F.lit(30.0) + k % 100 / F.lit(7.0), F.lit(-5.0) + k % 37 / F.lit(3.0), F.lit(31.0) + k % 53 / F.lit(5.0), F.lit(-4.0) + k % 29 / F.lit(4.0)]
    b, (mlat, mlon) = geo.bearing_deg(*at), geo.metres_per_degree(at[0])
    return table("customer").select(k.alias("id"), F.round(geo.haversine_km(*at), 6).alias("km"), F.round(b, 6).alias("bearing"), geo.compass(b).alias("compass"), F.round(geo.circular_error(b, F.lit(350.0)), 6).alias("turn"), F.round(mlat, 4).alias("m_lat"), F.round(mlon, 4).alias("m_lon"))


@book.add('SELECT id, CAST(floor((37.2e0 - lat) / 0.02e0 + 1e-9) AS INT) AS "row", CAST(floor((lon - -2.1e0) / 0.02e0 + 1e-9) AS INT) AS col FROM vis', det=True)
def grid_cell_of(spark, table):
    row, col = geo.grid_cell(F.col("lat"), F.col("lon"), -2.1, 37.2, 0.02)
    return detections(table).select("id", row.alias("row"), col.alias("col"))


@book.add("""WITH k AS (SELECT c_custkey AS id, radians(36e0 + (c_custkey % 97) / 20e0) AS p, radians(-4e0 + (c_custkey % 89) / 40e0 + 3e0) AS dl, 0.0066943799901413165e0 AS e2, 0.006739496742276434e0 AS ep2 FROM customer),
v AS (SELECT *, 6378137e0 / sqrt(1 - e2 * pow(sin(p), 2)) AS n, pow(tan(p), 2) AS t, ep2 * pow(cos(p), 2) AS c, cos(p) * dl AS a,
 6378137e0 * ((1 - e2 / 4 - 3 * e2 * e2 / 64 - 5 * pow(e2, 3) / 256) * p - (3 * e2 / 8 + 3 * e2 * e2 / 32 + 45 * pow(e2, 3) / 1024) * sin(2 * p) + (15 * e2 * e2 / 256 + 45 * pow(e2, 3) / 1024) * sin(4 * p) - (35 * pow(e2, 3) / 3072) * sin(6 * p)) AS m FROM k)
SELECT id, round(500000e0 + 0.9996e0 * n * (a + (1 - t + c) * pow(a, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep2) * pow(a, 5) / 120), 3) AS easting,
 round(0.9996e0 * (m + n * tan(p) * (a * a / 2 + (5 - t + 9 * c + 4 * c * c) * pow(a, 4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep2) * pow(a, 6) / 720)), 3) AS northing FROM v""")
def utm30n_forward(spark, table):
    k = F.col("c_custkey")
    e, n = geo.utm30_forward(F.lit(36.0) + k % 97 / F.lit(20.0), F.lit(-4.0) + k % 89 / F.lit(40.0))
    return table("customer").select(k.alias("id"), F.round(e, 3).alias("easting"), F.round(n, 3).alias("northing"))


def _box(lat, lon, h, w):
    p = lambda a, b: F.struct(a.alias("lat"), b.alias("lon"))
    return F.array(p(lat, lon), p(lat, lon + w), p(lat + h, lon + w), p(lat + h, lon), p(lat, lon))


@book.add("""WITH r AS (SELECT s_suppkey AS id, 36e0 + (s_suppkey % 40) / 10e0 AS a, -3e0 + (s_suppkey % 30) / 10e0 AS o, 0.01e0 * (s_suppkey % 7 + 1) AS h, 0.02e0 * (s_suppkey % 5 + 1) AS w FROM supplier)
SELECT id, true AS closed, round(a + h / 2, 9) AS lat, round(o + w / 2, 9) AS lon, round(abs(radians(w) * (2 + 2 * sin(radians(a))) - radians(w) * (2 + 2 * sin(radians(a + h)))) * 6371.0088e0 * 6371.0088e0 / 2, 6) AS area_km2,
 round(w * cos(radians(a + h / 2)) * 111.32e0 * h * 110.574e0, 6) AS flat_km2 FROM r""")
def ring_area_centroid(spark, table):
    k = F.col("s_suppkey")
    ring = _box(F.lit(36.0) + k % 40 / F.lit(10.0), F.lit(-3.0) + k % 30 / F.lit(10.0), F.lit(0.01) * (k % 7 + 1), F.lit(0.02) * (k % 5 + 1))
    rows = table("supplier").select(k.alias("id"), ring.alias("ring"))
    lat, lon = geo.ring_centroid(F.col("ring"))
    return rows.select("id", geo.ring_is_closed(F.col("ring")).alias("closed"), F.round(lat, 9).alias("lat"), F.round(lon, 9).alias("lon"), F.round(geo.ring_area_km2(F.col("ring")), 6).alias("area_km2"), F.round(geo.ring_area_flat_km2(F.col("ring")), 6).alias("flat_km2"))


@book.add("""WITH r AS (SELECT s_suppkey % 20 AS k FROM supplier GROUP BY 1), b AS (SELECT 37.0001e0 + k / 200e0 AS a, -1.9999e0 + k / 110e0 AS o FROM r)
SELECT id, EXISTS (SELECT 1 FROM b WHERE lat > a AND lat < a + 0.003e0 AND lon > o AND lon < o + 0.006e0) AS removed FROM vis""", det=True)
def point_in_ring(spark, table):
    kept, removed = spatial.without_heat(detections(table), heat_rings(table))
    return kept.select("id", F.lit(False).alias("removed")).union(removed.select("id", F.lit(True).alias("removed")))


@book.add("""WITH p AS (SELECT c_custkey AS point_id, 37e0 + (c_custkey * 31 % 997) / 9970e0 AS plat, -2e0 + (c_custkey * 17 % 991) / 4955e0 AS plon FROM customer),
n AS (SELECT s_suppkey AS node_id, 37e0 + (s_suppkey * 37 % 1000) / 10000e0 AS lat, -2e0 + (s_suppkey * 53 % 1000) / 5000e0 AS lon FROM supplier),
x AS (SELECT point_id, node_id, pow(lat - plat, 2) + pow(cos(radians(plat)), 2) * pow(lon - plon, 2) AS d2 FROM p, n),
y AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY d2, node_id) AS nth FROM x)
SELECT point_id, node_id, round(d2, 12) AS d2 FROM y WHERE nth = 1""")
def nearest_node(spark, table):
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    points = table("customer").select(k.alias("point_id"), (F.lit(37.0) + k * 31 % 997 / F.lit(9970.0)).alias("plat"), (F.lit(-2.0) + k * 17 % 991 / F.lit(4955.0)).alias("plon"))
    nodes = table("supplier").select(s.alias("node_id"), (F.lit(37.0) + s * 37 % 1000 / F.lit(10000.0)).alias("lat"), (F.lit(-2.0) + s * 53 % 1000 / F.lit(5000.0)).alias("lon"))
    return spatial.nearest_node(points, nodes, Scratch(spark, "nearest")).withColumn("d2", F.round("d2", 12))


THREAT_SQL = f"""a AS (SELECT c_custkey AS asset_id, ['hospital', 'town', 'school', 'power-line'][c_custkey % 4 + 1] AS category, 36.5e0 + (c_custkey * 31 % 997) / 997e0 AS lat, -2.5e0 + (c_custkey * 17 % 991) / 991e0 AS lon FROM customer),
f AS (SELECT s_suppkey AS fire_id, 36.5e0 + (s_suppkey * 37 % 1000) / 1000e0 AS flat, -2.5e0 + (s_suppkey * 53 % 1000) / 1000e0 AS flon, (s_suppkey % 5) / 2e0 AS radius_km FROM supplier),
x AS (SELECT fire_id, asset_id, category, radius_km, {HAV.format(a='lat', b='flat', c='lon', d='flon')} AS km FROM a, f),
t AS (SELECT fire_id, asset_id, category, greatest(0e0, km - radius_km) AS distance_km, CASE WHEN km <= radius_km THEN 'inside' WHEN km - radius_km <= 5 THEN '5km' WHEN km - radius_km <= 10 THEN '10km' WHEN km - radius_km <= 20 THEN '20km' END AS ring FROM x)"""


def _assets_and_fires(table):
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    category = F.get(F.array(*[F.lit(c) for c in ("hospital", "town", "school", "power-line")]), (k % 4).cast("int"))
    assets = table("customer").select(k.alias("asset_id"), category.alias("category"), (F.lit(36.5) + k * 31 % 997 / F.lit(997.0)).alias("lat"), (F.lit(-2.5) + k * 17 % 991 / F.lit(991.0)).alias("lon"))
    fires = table("supplier").select(s.alias("fire_id"), (F.lit(36.5) + s * 37 % 1000 / F.lit(1000.0)).alias("flat"), (F.lit(-2.5) + s * 53 % 1000 / F.lit(1000.0)).alias("flon"), (s % 5 / F.lit(2.0)).alias("radius_km"))
    return assets, fires


#: What fires of one class have in common: what is true of one is true of all, so pairs are looked for, and ranked, once.
KINDS = ["flat", "flon", "radius_km"]


@book.add(f"WITH {THREAT_SQL} SELECT fire_id, asset_id, ring, round(distance_km, 1) AS distance_km FROM t WHERE ring IS NOT NULL")
def threat_rings(spark, table):
    assets, fires = _assets_and_fires(table)
    # the ids of a class go where its pairs are found, so no pair is shuffled to meet them
    found = spatial.threats(assets, spatial.in_chunks(fires, KINDS, "fire_id").withColumnRenamed("ids", "fire_id"))
    found = found.select("fire_id", "asset_id", "ring", F.explode(F.array(F.round("distance_km", 1))).alias("distance_km"))
    return found.select(F.explode("fire_id").alias("fire_id"), "asset_id", "ring", "distance_km")


@book.add(f"""WITH {THREAT_SQL}, p AS (SELECT *, asset_id % 3 = 0 AS corridor, CASE ring WHEN 'inside' THEN 0 WHEN '5km' THEN 1 WHEN '10km' THEN 2 ELSE 3 END AS sev, CASE category WHEN 'hospital' THEN 0 WHEN 'power-line' THEN 2 ELSE 1 END AS wt FROM t WHERE ring IS NOT NULL),
q AS (SELECT *, CASE WHEN ring = 'inside' OR (ring = '5km' AND corridor) THEN 1 WHEN ring = '5km' OR (ring = '10km' AND corridor) THEN 2 ELSE 3 END AS priority FROM p)
SELECT fire_id, asset_id, priority, CAST(row_number() OVER (PARTITION BY fire_id ORDER BY priority, sev, corridor DESC, wt, round(distance_km, 3), asset_id) AS INT) AS nth FROM q""")
def recommendation_order(spark, table):
    assets, fires = _assets_and_fires(table)
    classes = fires.groupBy(*KINDS).agg(F.min("fire_id").alias("fire_id"))
    members = spatial.in_chunks(fires, KINDS, "fire_id").join(classes, KINDS).select(F.col("fire_id").alias("class"), "ids")
    found = spatial.threats(assets, classes, carry=("category",))
    t = found.withColumns({"in_corridor": F.col("asset_id") % 3 == 0, "distance_km": F.round("distance_km", 3), "has_perimeter": F.lit(True)})
    ranked = situation.recommendations(t).select(F.col("fire_id").alias("class"), "asset_id", "priority", "nth")
    return spatial.expanded(ranked, members, "class", "fire_id", "asset_id", "priority", "nth")


@book.add(f"""WITH l AS (SELECT s_suppkey AS line_id, 37e0 AS lat1, -2e0 + (s_suppkey % 50) / 100e0 AS lon1, 37e0 + (s_suppkey % 11) / 300e0 AS lat2, -2e0 + (s_suppkey % 50) / 100e0 + 0.01e0 AS lon2 FROM supplier),
n AS (SELECT *, greatest(1, CAST(ceil({HAV.format(a='lat1', b='lat2', c='lon1', d='lon2')} / 0.5e0) AS INT)) AS n FROM l), k AS (SELECT *, unnest(range(0, n + 1)) AS k FROM n)
SELECT line_id, CAST(k AS INT) AS k, round(lat1 + (lat2 - lat1) * k / n, 9) AS lat, round(lon1 + (lon2 - lon1) * k / n, 9) AS lon FROM k""")
def line_samples(spark, table):
    s = F.col("s_suppkey")
    lon = F.lit(-2.0) + s % 50 / F.lit(100.0)
    lines = table("supplier").select(s.alias("line_id"), F.lit(37.0).alias("lat1"), lon.alias("lon1"), (F.lit(37.0) + s % 11 / F.lit(300.0)).alias("lat2"), (lon + 0.01).alias("lon2"))
    return spatial.line_samples(lines).withColumns({"lat": F.round("lat", 9), "lon": F.round("lon", 9)})


@book.add(f"""WITH c AS (SELECT s_suppkey AS cell_id, 36.5e0 + (s_suppkey * 37 % 1000) / 1000e0 AS clat, -2.5e0 + (s_suppkey * 53 % 1000) / 1000e0 AS clon, CASE s_suppkey % 6 WHEN 0 THEN NULL WHEN 1 THEN -5e0 WHEN 2 THEN 1000e0 ELSE 1500e0 * (s_suppkey % 6) END AS range_m FROM supplier),
s AS (SELECT c_custkey AS sid, 36.5e0 + (c_custkey * 31 % 997) / 997e0 AS lat, -2.5e0 + (c_custkey * 17 % 991) / 991e0 AS lon, CAST(floor(c_acctbal) AS BIGINT) AS population, c_custkey % 7 = 0 AS t FROM customer),
m AS (SELECT cell_id, t, CASE WHEN population >= 0 THEN population END AS pop FROM c JOIN s ON {HAV.format(a='lat', b='clat', c='lon', d='clon')} * 1000 <= range_m WHERE range_m > 0)
SELECT c.cell_id, c.range_m <> 1000 AS measured, count(t) AS covered, CAST(coalesce(sum(CASE WHEN NOT t THEN coalesce(pop, 0) END), 0) AS BIGINT) AS over_alerted, count(*) FILTER (WHERE NOT t AND pop IS NULL) AS "unknown" FROM c LEFT JOIN m ON c.cell_id = m.cell_id WHERE range_m > 0 GROUP BY c.cell_id, c.range_m""")
def reach_over_alert(spark, table):
    s, k = F.col("s_suppkey"), F.col("c_custkey")
    r = F.when(s % 6 == 0, None).when(s % 6 == 1, -5.0).when(s % 6 == 2, 1000.0).otherwise(F.lit(1500.0) * (s % 6))
    cells = table("supplier").select(s.alias("cell_id"), (F.lit(36.5) + s * 37 % 1000 / F.lit(1000.0)).alias("clat"), (F.lit(-2.5) + s * 53 % 1000 / F.lit(1000.0)).alias("clon"), r.alias("range_m"))
    places = table("customer").select(k.alias("sid"), (F.lit(36.5) + k * 31 % 997 / F.lit(997.0)).alias("lat"), (F.lit(-2.5) + k * 17 % 991 / F.lit(991.0)).alias("lon"), F.floor("c_acctbal").cast("long").alias("population"))
    return spatial.reach(cells, places, places.filter(F.col("sid") % 7 == 0))


@book.add('WITH b AS (SELECT 36e0 AS south, -3e0 AS west, 38e0 AS north, -1e0 AS east) SELECT CAST(r AS INT) AS "row", CAST(c AS INT) AS col, round(36e0 + 0.25e0 * r, 9) AS south, round(-3e0 + 0.5e0 * c, 9) AS west, round(36e0 + 0.25e0 * (r + 1), 9) AS north, round(-3e0 + 0.5e0 * (c + 1), 9) AS east FROM (SELECT unnest(range(0, 8)) AS r) x, (SELECT unnest(range(0, 4)) AS c) y')
def tile_bounds(spark, table):
    bounds = spark.createDataFrame([(36.0, -3.0, 38.0, -1.0)], "south double, west double, north double, east double")
    t = spatial.tile_bounds(bounds, 8, 4)
    return t.withColumns({c: F.round(c, 9) for c in ("south", "west", "north", "east")})


@book.add("SELECT cluster_id, round(min(lon), 9) AS west, round(min(lat), 9) AS south, round(max(lon), 9) AS east, round(max(lat), 9) AS north FROM vis GROUP BY cluster_id", det=True)
def cluster_bbox(spark, table):
    g = detections(table).groupBy("cluster_id").agg(F.min("lon").alias("west"), F.min("lat").alias("south"), F.max("lon").alias("east"), F.max("lat").alias("north"))
    return g.select("cluster_id", *[F.round(c, 9).alias(c) for c in ("west", "south", "east", "north")])
