"""Queries over measures of lines, picks of events, features of cells, and checks of ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberglass.functions import geo
from emberglass.operators import audits, causal, egress, growth, issues, normalize, routes, scoring, snapshots, spatial
from emberglass.plans.base import Book, detections
from emberglass.plans.events import BEAR, HAV
from emberglass.plans.scoring import STATE_SQL, scored, states
from emberglass.plans.spatial import MLAT, MLON
from emberglass.sources import files
from emberglass.storage import Scratch

book = Book()


def _point(lat, lon):
    return F.struct(lat.alias("lat"), lon.alias("lon"))


def _corners(table):
    """Customers' places (a, o) and the steps to a second corner."""
    k = F.col("c_custkey")
    return table("customer").select(k.alias("id"), (F.lit(36.0) + k % 97 / F.lit(20.0)).alias("a"), (F.lit(-4.0) + k % 89 / F.lit(40.0)).alias("o"), ((k % 7 + 1) / F.lit(100.0)).alias("h"), ((k % 5 - 2) / F.lit(50.0)).alias("w"))


CORNER_SQL = """c AS (SELECT c_custkey AS id, 36e0 + (c_custkey % 97) / 20e0 AS a, -4e0 + (c_custkey % 89) / 40e0 AS o, (c_custkey % 7 + 1) / 100e0 AS h, (c_custkey % 5 - 2) / 50e0 AS w FROM customer)"""


@book.add(f"WITH {CORNER_SQL}, m AS (SELECT *, {MLAT.format(p='a')} AS y, {MLON.format(p='a')} AS x FROM c) SELECT id, round(h * y + abs(w) * x, 4) AS length_m, round(w * x * h * y, 2) AS signed_m2 FROM m")
def line_lengths(spark, table):
    c = _corners(table)
    a, o, h, w = (F.col(n) for n in "aohw")
    line = F.array(_point(a, o), _point(a + h, o), _point(a + h, o + w))
    ring = F.array(_point(a, o), _point(a, o + w), _point(a + h, o + w), _point(a + h, o), _point(a, o))
    return c.select("id", F.round(geo.line_length_m(line), 4).alias("length_m"), F.round(geo.signed_area_m2(ring), 2).alias("signed_m2"))


@book.add(f"""WITH {CORNER_SQL}, m AS (SELECT *, a + 0.005e0 AS pa, o + 0.01e0 AS po FROM c), s AS (SELECT *, {MLAT.format(p='pa')} AS y, {MLON.format(p='pa')} AS x FROM m),
v AS (SELECT id, a, o, pa, po, x, y, unnest([[a, o, a + h, o], [a + h, o, a + h, o + w]]) AS g FROM s), d AS (SELECT *, (po - g[2]) * x AS px, (pa - g[1]) * y AS py, (g[4] - g[2]) * x AS dx, (g[3] - g[1]) * y AS dy FROM v),
t AS (SELECT id, px, py, dx, dy, CASE WHEN dx * dx + dy * dy = 0 THEN 0e0 ELSE greatest(0e0, least(1e0, (px * dx + py * dy) / (dx * dx + dy * dy))) END AS t FROM d)
SELECT id, round(min(sqrt(pow(px - t * dx, 2) + pow(py - t * dy, 2))), 4) AS metres FROM t GROUP BY id""")
def point_to_line(spark, table):
    c = _corners(table)
    a, o, h, w = (F.col(n) for n in "aohw")
    line = F.array(_point(a, o), _point(a + h, o), _point(a + h, o + w))
    return c.select("id", F.round(geo.point_line_m(a + 0.005, o + 0.01, line), 4).alias("metres"))


@book.add(f"""WITH {CORNER_SQL}, m AS (SELECT *, {MLAT.format(p='(a + (a + h)) / 2')} AS y, {MLON.format(p='(a + (a + h)) / 2')} AS x FROM c)
SELECT id, round(a - 500 / y, 9) AS south, round(o - 500 / x, 9) AS west, round(a + h + 500 / y, 9) AS north, round(o + abs(w) + 500 / x, 9) AS east FROM m""")
def padded_boxes(spark, table):
    a, o, h, w = (F.col(n) for n in "aohw")
    c = _corners(table).select("id", geo.padded_box(a, o, a + h, o + F.abs(w), 500.0).alias("b"))
    return c.select("id", *[F.round(f"b.{n}", 9).alias(n) for n in ("south", "west", "north", "east")])


@book.add(f"""WITH {CORNER_SQL}, p AS (SELECT id, a AS lat1, o AS lon1, CASE WHEN id % 3 = 0 THEN a ELSE a + h END AS lat2, CASE WHEN id % 3 = 0 THEN o ELSE o + w END AS lon2 FROM c), b AS (SELECT *, {BEAR.format(a='lat1', b='lat2', c='lon1', d='lon2')} AS b FROM p)
SELECT id, CASE WHEN lat1 = lat2 AND lon1 = lon2 THEN NULL WHEN round(b, 1) >= 360 THEN 0e0 ELSE round(b, 1) END AS bearing FROM b""")
def drift_bearings(spark, table):
    a, o, h, w = (F.col(n) for n in "aohw")
    still = F.col("id") % 3 == 0
    return _corners(table).select("id", geo.drift_bearing(a, o, F.when(still, a).otherwise(a + h), F.when(still, o).otherwise(o + w)).alias("bearing"))


@book.add("""WITH c AS (SELECT c_custkey AS id, (c_custkey % 21 - 10) / 10e0 AS e, (c_custkey % 17 - 8) / 10e0 AS s FROM customer)
SELECT id, round(degrees(atan(sqrt(e * e + s * s))), 6) AS slope, round(fmod(degrees(atan2(-e, s)) + 720e0, 360e0), 6) AS aspect FROM c""")
def slopes(spark, table):
    k = F.col("c_custkey")
    slope, aspect = geo.slope_aspect((k % 21 - 10) / F.lit(10.0), (k % 17 - 8) / F.lit(10.0))
    return table("customer").select(k.alias("id"), F.round(slope, 6).alias("slope"), F.round(aspect, 6).alias("aspect"))


@book.add("SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 5 > 0 AND o_orderkey % 6 >= 4 AND o_custkey > 500")
def future_spread(spark, table):
    k = F.col("o_orderkey")
    ring = F.array_repeat(F.lit(0.0), (k % 6).cast("int"))
    s = table("orders").select(k.alias("id"), (k % 5).alias("horizon_h"), ring.alias("ring"), F.col("o_custkey").alias("valid_s"))
    return snapshots.future_steps(s, F.lit(500)).select("id")


@book.add("SELECT coalesce(bool_or(available_s <= 1000000), false) AS observed FROM vis", det=True)
def any_delivered(spark, table):
    return snapshots.any_observed(detections(table), 1000000)


@book.add("""WITH k AS (SELECT CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey ELSE s_suppkey + 100000000 END AS cluster_id, s_suppkey AS i FROM supplier), own AS (SELECT k.cluster_id, id FROM k JOIN vis ON vis.cluster_id = k.cluster_id),
listed AS (SELECT cluster_id, unnest([i, i + 1, -1]) AS id FROM k WHERE cluster_id NOT IN (SELECT cluster_id FROM own)) SELECT * FROM own UNION ALL SELECT cluster_id, id FROM listed WHERE id IN (SELECT id FROM vis)""", det=True)
def cluster_detections(spark, table):
    s = F.col("s_suppkey")
    clusters = table("supplier").select(F.when(s % 2 == 0, s).otherwise(s + 100000000).alias("cluster_id"), F.array(s, s + 1, F.lit(-1).cast("long")).alias("hotspot_ids"))
    return snapshots.detections_of(detections(table), clusters)


@book.add("""WITH e AS (SELECT c_custkey AS ord, c_custkey * 100 AS first_s, c_custkey * 100 + c_custkey % 9 * 50 AS last_s, c_custkey * 37 % 101 AS detections FROM customer)
SELECT ord, detections FROM e ORDER BY (first_s <= 9000 AND last_s >= 5000) DESC, detections DESC, ord LIMIT 1""")
def window_event(spark, table):
    k = F.col("c_custkey")
    e = table("customer").select(k.alias("ord"), (k * 100).alias("first_s"), (k * 100 + k % 9 * 50).alias("last_s"), (k * 37 % 101).alias("detections"))
    return snapshots.pick_event(e, 5000, 9000).select("ord", "detections")


@book.add("""WITH c AS (SELECT c_custkey AS cluster_id, c_custkey * 60 AS a, c_custkey * 60 + c_custkey % 30 * 1000 AS b FROM customer), i AS (SELECT cluster_id, unnest(generate_series(a, b, 3600)) AS issue_s FROM c)
SELECT cluster_id, issue_s, h AS horizon_h, issue_s + h * 3600 - 1800 AS from_s, issue_s + h * 3600 + 1800 AS to_s FROM i, (VALUES (1), (3), (6), (12)) AS v(h)""")
def hourly_issues(spark, table):
    k = F.col("c_custkey")
    return issues.rolling_issues(table("customer").select(k.alias("cluster_id"), (k * 60).alias("first_s"), (k * 60 + k % 30 * 1000).alias("last_s")))


@book.add("""SELECT id, round(ln(1 + frp / 3) / 5, 9) AS frp_feature, round(sin(2 * pi() * (at_s % 86400) / 86400), 9) AS hour_sin, round(cos(2 * pi() * (at_s % 86400) / 86400), 9) AS hour_cos FROM vis""", det=True)
def detection_features(spark, table):
    d = detections(table).select("id", *issues.hour_features(F.col("at_s"), F.col("frp")))
    return d.select("id", *[F.round(c, 9).alias(c) for c in ("frp_feature", "hour_sin", "hour_cos")])


@book.add("""WITH o AS (SELECT o_orderkey AS id, o_orderpriority AS role, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS place, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders),
i AS (SELECT DISTINCT role, n, unnest(range(0, 40)) AS i FROM o), p AS (SELECT DISTINCT role, CASE WHEN n <= 40 THEN i WHEN i = 39 THEN n - 1 ELSE CAST(floor(i * ((n - 1) / 39e0)) AS BIGINT) END AS place FROM i)
SELECT o.role, o.id FROM o JOIN p ON o.role = p.role AND o.place = p.place""")
def evenly_thinned(spark, table):
    return issues.thinned(table("orders").select(F.col("o_orderpriority").alias("role"), F.col("o_orderkey").alias("id")), "role", "id", 40)


@book.add("""WITH c AS (SELECT c_custkey AS id, c_custkey // 64 AS g, -3e0 + (c_custkey % 8) / 10e0 AS lon, 37e0 + (c_custkey // 8 % 8) / 10e0 AS lat, CASE WHEN c_custkey // 64 % 4 = 0 THEN 0e0 ELSE (c_custkey % 3) * 1e0 END AS fire FROM customer),
m AS (SELECT *, sum(fire) OVER w AS n, sum(fire * lon) OVER w AS sx, sum(fire * lat) OVER w AS sy FROM c WINDOW w AS (PARTITION BY g)), e AS (SELECT id, n, (lon - sx / n) * 111.32e0 * cos(radians(lat)) / 50 AS x, (lat - sy / n) * 110.54e0 / 50 AS y FROM m)
SELECT id, CASE WHEN n > 0 THEN round(x, 6) ELSE 0 END AS east, CASE WHEN n > 0 THEN round(y, 6) ELSE 0 END AS north, CASE WHEN n > 0 THEN round(sqrt(x * x + y * y), 6) ELSE 0 END AS distance, CASE WHEN n > 0 THEN 1e0 ELSE 0e0 END AS has_fire FROM e""")
def fire_offsets(spark, table):
    k = F.col("c_custkey")
    g, r = F.floor(k / 64), F.floor(k / 8) % 8
    cells = table("customer").select(k.alias("id"), g.alias("g"), (F.lit(-3.0) + k % 8 / F.lit(10.0)).alias("lon"), (F.lit(37.0) + r / F.lit(10.0)).alias("lat"), F.when(g % 4 == 0, 0.0).otherwise((k % 3).cast("double")).alias("fire"))
    return issues.offsets(cells, "g").select("id", *[F.round(c, 6).alias(c) for c in ("east", "north", "distance")], "has_fire")


@book.add("""WITH c AS (SELECT c_custkey // 64 AS g, c_custkey // 8 % 8 AS "row", c_custkey % 8 AS col, c_custkey % 11 = 0 AND c_custkey // 64 % 3 > 0 AS active FROM customer)
SELECT c.g, c."row", c.col, round(coalesce(exp(-min(sqrt(pow(c."row" - a."row", 2) + pow(c.col - a.col, 2))) / 2), 0), 9) AS score FROM c LEFT JOIN (SELECT * FROM c WHERE active) a ON a.g = c.g GROUP BY 1, 2, 3""")
def fire_nearness(spark, table):
    k = F.col("c_custkey")
    g = F.floor(k / 64)  # grids of 8 x 8 cells
    cells = table("customer").select(g.alias("g"), (F.floor(k / 8) % 8).alias("row"), (k % 8).alias("col"), ((k % 11 == 0) & (g % 3 > 0)).alias("active"))
    return issues.nearness(cells, "g").withColumn("score", F.round("score", 9))


@book.add("""WITH o AS (SELECT o_orderkey AS id, greatest(o_orderkey % 3 - 1, o_orderkey % 5 - 3) > 0 AS known, greatest(o_orderkey % 7 - 5, o_orderkey % 11 - 9) > 0 AS past, o_orderkey % 4 AS old FROM orders)
SELECT id, known, past, known AND old = 0 AS latest_clear, known AND NOT past AS no_past_detection FROM o""")
def novelty_flags(spark, table):
    k = F.col("o_orderkey")
    cells = table("orders").select(k.alias("id"), F.array(k % 3 - 1, k % 5 - 3).alias("observable"), F.array(k % 7 - 5, k % 11 - 9).alias("fire"), (k % 4).alias("old"))
    return issues.novelty(cells).select("id", "known", "past", "latest_clear", "no_past_detection")


@book.add("SELECT o_custkey, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS roles FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1")
def shared_by_roles(spark, table):
    return audits.shared_ids(table("orders"), "o_orderstatus", "o_custkey").select("o_custkey", F.array_join("roles", ",").alias("roles"))


@book.add("""WITH n AS (SELECT o_custkey AS id, count(*) AS n FROM orders GROUP BY 1) SELECT id, 'unknown' AS fault FROM n WHERE id NOT IN (SELECT c_custkey + 10 FROM customer) UNION ALL SELECT id, 'repeated' FROM n WHERE n > 1""")
def id_faults(spark, table):
    return audits.known_once(table("orders").select(F.col("o_custkey").alias("id")), table("customer").select((F.col("c_custkey") + 10).alias("id")), "id")


@book.add("""WITH r AS (SELECT o_custkey AS sid, o_orderpriority || o_orderkey AS destination, o_orderkey % 40 * 100 AS earliest_s, o_orderkey % 3 > 0 AS usable FROM orders)
SELECT sid, destination, earliest_s FROM (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY earliest_s DESC, destination) AS nth FROM r WHERE usable) WHERE nth = 1""")
def chosen_routes(spark, table):
    k = F.col("o_orderkey")
    r = table("orders").select(F.col("o_custkey").alias("sid"), F.concat("o_orderpriority", k.cast("string")).alias("destination"), (k % 40 * 100).alias("earliest_s"), (k % 3 > 0).alias("usable"))
    return routes.chosen(r, "sid").select("sid", "destination", "earliest_s")


@book.add("""SELECT c_custkey AS sid, s_suppkey * 60 AS cut_s FROM customer JOIN supplier ON s_suppkey = c_custkey % 200 WHERE s_suppkey % 3 > 0""")
def threatened_places(spark, table):
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    cuts = table("supplier").select(s.alias("node"), F.when(s % 3 > 0, s * 60).alias("cut_s"))
    return routes.threatened(table("customer").select(k.alias("sid")), table("customer").select(k.alias("sid"), (k % 200).alias("node")), cuts)


@book.add("SELECT CAST(coalesce(sum(CASE WHEN c_custkey % 4 > 0 THEN c_custkey END), 0) AS BIGINT) AS over_alerted, round(avg(CASE WHEN c_custkey % 3 > 0 THEN 1e0 ELSE 0e0 END), 9) AS measured_fraction FROM customer")
def reach_sums(spark, table):
    k = F.col("c_custkey")
    per = table("customer").select(F.when(k % 4 > 0, k).alias("over_alerted"), (k % 3 > 0).alias("measured"))
    return routes.reach_totals(per).withColumn("measured_fraction", F.round("measured_fraction", 9))


@book.add("SELECT c_custkey AS sid, coalesce(s.n, c_custkey % 90) AS buildings FROM customer LEFT JOIN (SELECT o_custkey AS k, max(CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey END) AS n FROM orders GROUP BY 1) s ON k = c_custkey")
def surveyed_buildings(spark, table):
    k, o = F.col("c_custkey"), F.col("o_orderkey")
    surveyed = table("orders").select(F.col("o_custkey").alias("sid"), F.when(o % 2 == 0, o).alias("buildings"))
    return routes.building_counts(table("customer").select(k.alias("sid"), (k % 90).alias("buildings")), surveyed)


@book.add("SELECT c_custkey AS id, CASE WHEN c_custkey % 6 = 0 THEN 'Severe' ELSE 'Extreme' END AS severity, CASE WHEN c_custkey % 5 > 0 AND c_custkey % 5 * 100 + c_custkey % 7 * 60 <= 500 THEN c_custkey % 5 * 100 END AS cut_s, coalesce(c_acctbal BETWEEN 0 AND 5000, false)::INT AS valid, CASE WHEN c_acctbal BETWEEN 0 AND 5000 THEN c_acctbal ELSE 0 END AS value FROM customer")
def known_values(spark, table):
    k = F.col("c_custkey")
    reaches = F.when(k % 6 == 0, False).when(k % 6 > 2, True)
    ranged = files.in_range(F.col("c_acctbal"), 0.0, 5000.0)
    cut = causal.known_cut(F.when(k % 5 > 0, k % 5 * 100), k % 7 * 60, 500)
    return table("customer").select(k.alias("id"), routes.severity(reaches).alias("severity"), cut.alias("cut_s"), ranged["valid"].alias("valid"), ranged["value"].alias("value"))


@book.add("""WITH p AS (SELECT o_custkey AS cluster_id, o_orderkey AS part_index, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 10 END AS observed_s FROM orders)
SELECT cluster_id, part_index, observed_s FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY observed_s DESC NULLS LAST, part_index) AS nth FROM p) WHERE nth = 1""")
def newest_part(spark, table):
    k = F.col("o_orderkey")
    return normalize.latest_part(table("orders").select(F.col("o_custkey").alias("cluster_id"), k.alias("part_index"), F.when(k % 4 > 0, k % 10).alias("observed_s")))


@book.add("""WITH p AS (SELECT s_suppkey AS id, (s_suppkey * 37 % 101) * 1e0 AS x, (s_suppkey * 53 % 103) * 1e0 AS y FROM supplier)
SELECT a.id AS src, b.id AS dst FROM p a JOIN p b ON a.id < b.id AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 100""")
def links_in_reach(spark, table):
    s = F.col("s_suppkey")
    return egress.epsilon_links(table("supplier").select(s.alias("id"), (s * 37 % 101).cast("double").alias("x"), (s * 53 % 103).cast("double").alias("y")), 10.0)


@book.add(f"""WITH {STATE_SQL}, m AS (SELECT fire, area, area1, avg(area1) OVER (PARTITION BY fire) AS m FROM pairs), r AS (SELECT fire, 1 - sum(pow(area1 - area, 2)) / sum(pow(area1 - m, 2)) AS r2 FROM m GROUP BY fire HAVING count(*) > 1 AND sum(pow(area1 - m, 2)) > 0)
SELECT count(*) AS fires, round(median(r2), 6) AS median_r2 FROM r""")
def median_r2(spark, table):
    per = scoring.r2_mape(scoring.state_pairs(states(table), 4000), ["fire"], "area1", "area")
    return scoring.median_r2(per).withColumn("median_r2", F.round("median_r2", 6))


@book.add(f"""WITH s AS (SELECT o_custkey AS fire, o_orderkey AS ord, CASE WHEN o_orderkey % 13 > 0 THEN (o_orderkey * 31 % 4001) * 1e0 END AS t, 37e0 + (o_orderkey % 101) / 100e0 AS lat2, -3e0 + (o_orderkey % 89) / 100e0 AS lon2 FROM orders),
p AS (SELECT *, count(*) OVER (PARTITION BY fire) AS n, lag(t) OVER w AS t1, lag(lat2) OVER w AS lat1, lag(lon2) OVER w AS lon1 FROM s WHERE t IS NOT NULL WINDOW w AS (PARTITION BY fire ORDER BY t, ord)),
b AS (SELECT *, {BEAR.format(a='lat1', b='lat2', c='lon1', d='lon2')} AS b, {HAV.format(a='lat1', b='lat2', c='lon1', d='lon2')} AS km, t > t1 AND t - t1 <= 600 AS ok FROM p WHERE n >= 3)
SELECT fire, ord, CASE WHEN ok THEN round(b, 6) END AS bearing, CASE WHEN ok THEN round(km / (t - t1), 6) END AS rate_kmh FROM b""")
def state_motion(spark, table):
    k = F.col("o_orderkey")
    s = table("orders").select(F.col("o_custkey").alias("fire"), F.when(k % 13 > 0, (k * 31 % 4001).cast("double")).alias("t"), k.alias("ord"), (F.lit(37.0) + k % 101 / F.lit(100.0)).alias("lat"), (F.lit(-3.0) + k % 89 / F.lit(100.0)).alias("lon"))
    return growth.motion(s, 600.0).select("fire", "ord", F.round("bearing", 6).alias("bearing"), F.round("rate_kmh", 6).alias("rate_kmh"))


_BINS = ", ".join(f"""round(count(*) FILTER (WHERE b = {k} AND flag IN (1, 2)) / 3e0, 9) AS fire_{k}, round(count(*) FILTER (WHERE b = {k} AND flag <= 2) / 3e0, 9) AS observable_{k},
 round(ln(1 + coalesce(sum(frp) FILTER (WHERE b = {k}), 0) / 3) / 5, 9) AS frp_{k}, round(coalesce(sum(n) FILTER (WHERE b = {k}), 0) / 3e0, 9) AS measured_{k}""" for k in range(6))


@book.add(f"""WITH f AS (SELECT o_custkey % 5 AS cell, o_orderkey * 600 AS s, o_orderkey * 600 + o_orderkey % 9 * 900 AS ready, CASE WHEN o_orderkey % 37 = 0 THEN 1 WHEN o_orderkey % 50 = 0 THEN 4 ELSE 0 END AS flag, CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 40) * 1e0 END AS frp, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS n FROM orders),
i AS (SELECT unnest(range(0, 60)) * 18000 AS issue_s), a AS (SELECT cell, issue_s, s, ready, flag, CASE WHEN ready <= issue_s THEN CAST(floor((s - issue_s + 10800) / 1800) AS INT) END AS b, frp, n FROM f, i WHERE s >= issue_s - 10800 AND s < issue_s)
SELECT cell, issue_s, coalesce(arg_max(CASE WHEN flag IN (1, 2) THEN 1e0 ELSE 0e0 END, s) FILTER (WHERE ready <= issue_s AND flag <= 2), 0e0) AS recent_fire, {_BINS} FROM a GROUP BY cell, issue_s""")
def six_input_bins(spark, table):
    k = F.col("o_orderkey")
    scans = table("orders").select((F.col("o_custkey") % 5).alias("cell"), (k * 600).alias("scan_s"), (k * 600 + k % 9 * 900).alias("available_s"), F.when(k % 37 == 0, 1).when(k % 50 == 0, 4).otherwise(0).alias("flag"), F.when(k % 3 == 0, (k % 40).cast("double")).alias("frp"), F.when(k % 3 == 0, 1).otherwise(0).alias("n_frp"))
    out = issues.input_bins(scans, spark.range(60).select((F.col("id") * 18000).alias("issue_s")))
    return out.select("cell", "issue_s", "recent_fire", *[F.round(c, 9).alias(c) for c in out.columns[3:]])


@book.add(f"""WITH {STATE_SQL}, g AS (SELECT fire, avg((area1 - area) / dt) AS growth FROM pairs GROUP BY fire), o AS (SELECT fire, ((SELECT sum(growth) FROM g) - growth) / ((SELECT count(*) FROM g) - 1) AS others FROM g),
m AS (SELECT (SELECT avg(area1) FROM pairs) AS m), r AS (SELECT sum(pow(area1 - area, 2)) AS p, sum(pow(area1 - (area + others * dt), 2)) AS c, sum(pow(area1 - m, 2)) AS t FROM pairs JOIN o USING (fire), m)
SELECT (SELECT count(DISTINCT fire) FROM pairs) AS fires, (SELECT count(*) FROM pairs) AS pairs, round((SELECT min(dt) FROM pairs), 6) AS dt_min, round((SELECT median(dt) FROM pairs), 6) AS dt_median, round((SELECT max(dt) FROM pairs), 6) AS dt_max, round(1 - p / t, 6) AS r2_persistence, round(1 - c / t, 6) AS r2_constant FROM r""")
def corpus_summary(spark, table):
    pairs = scoring.state_pairs(states(table), 4000)
    rates = scoring.leave_one_out(scoring.group_rates(pairs)).select("fire", "others")
    out = scoring.corpus_summary(pairs.join(rates, "fire"))
    return out.select("fires", "pairs", *[F.round(c, 6).alias(c) for c in out.columns[2:]])


BOXES = {"andalusia": (36.0, -7.5, 38.7, -1.6), "murcia": (37.3, -2.4, 38.8, -0.6)}


@book.add(f"""WITH {CORNER_SQL} SELECT id, CASE WHEN a BETWEEN 36 AND 38.7 AND o BETWEEN -7.5 AND -1.6 THEN 'andalusia' WHEN a BETWEEN 37.3 AND 38.8 AND o BETWEEN -2.4 AND -0.6 THEN 'murcia' END AS box FROM c""")
def covered_places(spark, table):
    return _corners(table).select("id", spatial.coverage_at(F.col("a"), F.col("o"), BOXES).alias("box"))


@book.add("""WITH e AS (SELECT s_suppkey AS event_id, s_suppkey * 37 % 2001 - 32 AS r, s_suppkey * 53 % 1903 - 32 AS c FROM supplier), o AS (SELECT o_orderkey AS id, o_orderkey * 31 % 2111 AS r, o_orderkey * 17 % 1999 AS c FROM orders)
SELECT event_id, id FROM e JOIN o ON o.r BETWEEN e.r AND e.r + 63 AND o.c BETWEEN e.c AND e.c + 63""")
def patch_observations(spark, table):
    s, k = F.col("s_suppkey"), F.col("o_orderkey")
    events = table("supplier").select(s.alias("event_id"), (s * 37 % 2001).alias("seed_row"), (s * 53 % 1903).alias("seed_col"))
    return spatial.local_observations(events, table("orders").select(k.alias("id"), (k * 31 % 2111).alias("row"), (k * 17 % 1999).alias("col")))


@book.add("""SELECT o_orderkey AS id, c_custkey * 3 AS component FROM orders LEFT JOIN customer ON (c_custkey + 10) // 50 = o_custkey // 50 AND (c_custkey + 10) % 50 = o_custkey % 50""")
def pixel_components(spark, table):
    c, k = F.col("c_custkey"), F.col("o_custkey")
    components = table("customer").select(F.floor((c + 10) / 50).alias("row"), ((c + 10) % 50).alias("col"), (c * 3).alias("component"))
    pixels = table("orders").select(F.col("o_orderkey").alias("id"), F.floor(k / 50).alias("row"), (k % 50).alias("col"))
    return spatial.components_of_pixels(pixels, components).select("id", "component")


@book.add("""SELECT c_nationkey, c_custkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey % 3 > 0, c_acctbal DESC, c_custkey) AS INT) AS nth FROM customer""")
def list_order(spark, table):
    c = table("customer").select("c_nationkey", "c_custkey", "c_acctbal")
    return spatial.placed(c, "c_nationkey", F.col("c_custkey") % 3 > 0, F.desc("c_acctbal"), "c_custkey").drop("c_acctbal")


@book.add("""WITH n AS (SELECT o_custkey AS sentence, o_orderkey AS ord, CASE o_orderkey % 4 WHEN 0 THEN ' ' || upper(n_name) WHEN 1 THEN r_name WHEN 2 THEN r_name ELSE CASE WHEN o_custkey % 3 = 0 THEN 'nowhere ' || o_orderkey % 5 ELSE n_name END END AS name
  FROM orders JOIN nation ON n_nationkey = o_custkey % 25 JOIN region ON r_regionkey = o_custkey % 5),
k AS (SELECT sentence, ord, name, lower(trim(name)) AS k FROM n), p AS (SELECT DISTINCT lower(trim(n_name)) AS k FROM nation), w AS (SELECT lower(trim(r_name)) AS k, r_regionkey AS edge FROM region),
e AS (SELECT DISTINCT l_orderkey * 2 AS sentence, l_partkey % 5 AS edge FROM lineitem), f AS (SELECT sentence, ord, name, CASE WHEN k IN (SELECT k FROM p) THEN NULL WHEN k NOT IN (SELECT k FROM w) THEN 0
  WHEN sentence IN (SELECT sentence FROM e) AND NOT EXISTS (SELECT 1 FROM e JOIN w ON e.edge = w.edge WHERE e.sentence = k.sentence AND w.k = k.k) THEN 1 END AS rank FROM k),
x AS (SELECT *, row_number() OVER (PARTITION BY sentence ORDER BY rank NULLS LAST, ord) AS nth FROM f)
SELECT sentence, CASE rank WHEN 0 THEN 'unresolved_name' WHEN 1 THEN 'not_passable' END AS reason, CASE WHEN rank IS NOT NULL THEN name END AS name FROM x WHERE nth = 1""")
def sentence_faults(spark, table):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    o = table("orders").join(table("nation"), F.col("n_nationkey") == c % 25).join(table("region"), F.col("r_regionkey") == c % 5)
    name = F.when(k % 4 == 0, F.concat(F.lit(" "), F.upper("n_name"))).when(k % 4 < 3, F.col("r_name")).when(c % 3 == 0, F.concat(F.lit("nowhere "), (k % 5).cast("string"))).otherwise(F.col("n_name"))
    ways = table("region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"), F.col("r_regionkey").cast("long").alias("edge"))
    route_edges = table("lineitem").select((F.col("l_orderkey") * 2).alias("sentence"), (F.col("l_partkey") % 5).alias("edge"))
    return routes.verified(o.select(c.alias("sentence"), k.alias("ord"), name.alias("name")), table("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")), ways, route_edges)


@book.add("""WITH b AS (SELECT s_suppkey AS id, 36e0 + (s_suppkey % 20) / 10e0 AS south, -3e0 + (s_suppkey % 15) / 10e0 AS west, (s_suppkey % 7) / 40e0 AS h, (s_suppkey % 5) / 30e0 AS w FROM supplier),
n AS (SELECT *, greatest(1, CAST(ceil(h * 110977 / 2000) AS INT)) AS n, greatest(1, CAST(ceil(w * 111320 * cos(radians(south + h / 2)) / 2000) AS INT)) AS m FROM b), r AS (SELECT *, unnest(range(0, n)) AS r FROM n), t AS (SELECT *, unnest(range(0, m)) AS c FROM r)
SELECT id, CAST(r AS INT) AS "row", CAST(c AS INT) AS col, round(south + r * h / n, 9) AS south, round(west + c * w / m, 9) AS west, round(h / n * 110977 * (w / m) * 111320 * cos(radians(south + (r + 0.5) * h / n)), 3) AS area_m2 FROM t""")
def survey_tiles(spark, table):
    s = F.col("s_suppkey")
    south, west = F.lit(36.0) + s % 20 / F.lit(10.0), F.lit(-3.0) + s % 15 / F.lit(10.0)
    b = table("supplier").select(s.alias("id"), south.alias("south"), west.alias("west"), (south + s % 7 / F.lit(40.0)).alias("north"), (west + s % 5 / F.lit(30.0)).alias("east"))
    return spatial.survey_tiles(b).select("id", "row", "col", F.round("south", 9).alias("south"), F.round("west", 9).alias("west"), F.round("area_m2", 3).alias("area_m2"))


@book.add("SELECT min(at_s) AS origin_s FROM vis", det=True)
def timeline_origin(spark, table):
    return causal.timeline_origin(detections(table))


@book.add()
def calibration_fit(spark, table):
    """Newton's steps are not in SQL; a test compares the fit with one in numpy."""
    rows = Scratch(spark, "calibration").save(scored(table).withColumn("w", F.lit(1.0) + F.col("doc_id") % 3), "rows")
    lower = rows.withColumn("p", 0.6 * F.col("p") + 0.4 * F.col("y"))  # the scores tell the classes apart
    slope, intercept = scoring.fit_calibrator(lower, "y", "p", "w")
    return spark.createDataFrame([(round(slope, 6), round(intercept, 6))], "slope double, intercept double")
