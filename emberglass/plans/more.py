"""Queries over snapshots' other parts, issues, audits, routes and what serves them."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberglass.functions import geo
from emberglass.operators import audits, issues, routes, snapshots
from emberglass.plans.base import Book, detections

book = Book()


@book.add("SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 7 > 0 AND o_orderkey % 5 > 0 AND greatest(o_orderkey % 1000, o_custkey % 900) <= 600")
def visible_perimeters(spark, table):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    p = table("orders").select(k.alias("id"), F.when(k % 7 > 0, k % 1000).alias("computed_s"), F.when(k % 5 > 0, c % 900).alias("watermark_s"))
    return snapshots.visible_perimeters(p, 600).select("id")


@book.add("""WITH s AS (SELECT o_orderkey AS id, o_orderkey % 1000 AS i, CASE WHEN o_orderkey % 11 > 0 THEN o_custkey % 1200 END AS v, o_orderkey % 5 - 1 AS h FROM orders)
SELECT id FROM s WHERE i <= 600 AND v IS NOT NULL AND h >= 0 AND CASE WHEN h = 0 THEN v <= 600 ELSE v >= i END""")
def visible_spread(spark, table):
    k = F.col("o_orderkey")
    s = table("orders").select(k.alias("id"), (k % 1000).alias("issued_s"), F.when(k % 11 > 0, F.col("o_custkey") % 1200).alias("valid_s"), (k % 5 - 1).alias("horizon_h"))
    return snapshots.visible_spread(s, 600).select("id")


@book.add("""SELECT cluster_id, count(*) AS n, round(sum(frp), 6) AS total_frp, min(n_name) AS name FROM vis LEFT JOIN nation ON n_nationkey = cluster_id WHERE available_s <= 1000000 GROUP BY cluster_id""", det=True)
def named_snapshot(spark, table):
    labels = table("nation").select(F.col("n_nationkey").cast("long").alias("cluster_id"), F.col("n_name").alias("name"), F.lit(None).cast("string").alias("label"))
    none = detections(table).limit(0)
    got = snapshots.causal_response(detections(table), none.selectExpr("at_s AS computed_s", "at_s AS watermark_s"), none.selectExpr("at_s AS issued_s", "at_s AS valid_s", "0 AS horizon_h"), labels, 1000000)[0]
    return got.select("cluster_id", "n", F.round("total_frp", 6).alias("total_frp"), "name")


@book.add("""WITH e AS (SELECT c_custkey AS event_id, c_custkey * 977 AS s, c_custkey * 977 + c_custkey % 90 * 5000 AS e, c_custkey * 977 + 300000 AS a, CASE WHEN c_custkey % 3 = 0 THEN c_custkey * 977 + 9000 END AS seed FROM customer),
f AS (SELECT event_id, CAST(ceil(greatest(s + 2700, coalesce(seed, 0)) / 3600) * 3600 AS BIGINT) AS lo, least(CAST(ceil((e + 21600) / 3600) * 3600 AS BIGINT), a - 21600) AS hi FROM e),
n AS (SELECT event_id, lo, CAST(floor((hi - lo) / 3600) AS BIGINT) + 1 AS n FROM f WHERE hi >= lo), i AS (SELECT event_id, lo, n, unnest(range(0, 48)) AS i FROM n)
SELECT DISTINCT event_id, lo + 3600 * CASE WHEN n <= 48 THEN i WHEN i = 47 THEN n - 1 ELSE CAST(floor(i * ((n - 1) / 47e0)) AS BIGINT) END AS issue_s FROM i WHERE n > 48 OR i < n""")
def issue_times(spark, table):
    k = F.col("c_custkey")
    at = k * 977
    return issues.issue_times(table("customer").select(k.alias("event_id"), at.alias("start_s"), (at + k % 90 * 5000).alias("end_s"), (at + 300000).alias("archive_end_s"), F.when(k % 3 == 0, at + 9000).alias("seed_available_s")))


@book.add("""WITH f AS (SELECT o_custkey % 5 AS cell, o_orderkey * 600 AS s, CASE WHEN o_orderkey % 37 = 0 THEN 1 WHEN o_orderkey % 50 = 0 THEN 4 ELSE 0 END AS flag FROM orders),
i AS (SELECT unnest(range(0, 40)) * 36000 AS issue_s), m AS (SELECT cell, issue_s, s - issue_s AS d, flag FROM f, i WHERE s >= issue_s AND s < issue_s + 21600)
SELECT cell, issue_s, coalesce(bool_or(flag = 1) FILTER (WHERE d < 3600), false) AS fire_1, coalesce(bool_or(flag = 1) FILTER (WHERE d < 3600), false) OR count(*) FILTER (WHERE d < 3600 AND flag = 0) = 6 AS known_1, coalesce(bool_or(flag = 1) FILTER (WHERE d < 10800), false) AS fire_3,
 coalesce(bool_or(flag = 1) FILTER (WHERE d < 10800), false) OR count(*) FILTER (WHERE d < 10800 AND flag = 0) = 18 AS known_3, bool_or(flag = 1) AS fire_6, bool_or(flag = 1) OR count(*) FILTER (WHERE flag = 0) = 36 AS known_6 FROM m GROUP BY cell, issue_s""")
def horizon_labels(spark, table):
    k = F.col("o_orderkey")
    flags = table("orders").select((F.col("o_custkey") % 5).alias("cell"), (k * 600).alias("scan_s"), F.when(k % 37 == 0, 1).when(k % 50 == 0, 4).otherwise(0).alias("flag"))
    return issues.horizon_labels(flags, spark.range(40).select((F.col("id") * 36000).alias("issue_s")))


_LABELS = ", ".join(
    f"coalesce(bool_or(fire) FILTER (WHERE d < {h * 3600}), false) AS fire_{h}, "
    f"coalesce(bool_or(fire) FILTER (WHERE d < {h * 3600}), false) OR count(*) FILTER (WHERE d < {h * 3600} AND clear) = {h * 6} AS known_{h}"
    for h in issues.HORIZONS
)


@book.add(f"""WITH f AS (SELECT l_partkey % 3 AS cell, (l_orderkey * 7 + l_linenumber) % 20000 * 600 AS s, CASE WHEN l_suppkey % 61 = 0 THEN 1 WHEN l_suppkey % 47 = 0 THEN 4 ELSE 0 END AS flag FROM lineitem),
g AS (SELECT cell, s, bool_or(flag = 1) AS fire, bool_and(flag = 0) AS clear FROM f GROUP BY ALL), i AS (SELECT unnest(range(0, 333)) * 36000 AS issue_s),
m AS (SELECT cell, issue_s, s - issue_s AS d, fire, clear FROM g, i WHERE s >= issue_s AND s < issue_s + 21600) SELECT cell, issue_s, {_LABELS} FROM m GROUP BY cell, issue_s""")
def repeated_scan_labels(spark, table):
    scan = (F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 20000 * 600
    flag = F.when(F.col("l_suppkey") % 61 == 0, 1).when(F.col("l_suppkey") % 47 == 0, 4).otherwise(0)
    flags = table("lineitem").select((F.col("l_partkey") % 3).alias("cell"), scan.alias("scan_s"), flag.alias("flag"))
    return issues.horizon_labels(flags, spark.range(333).select((F.col("id") * 36000).alias("issue_s")))


@book.add("""SELECT CAST(floor((lat - 37) * 200) AS BIGINT) AS "row", CAST(floor((lon + 2) * 100) AS BIGINT) AS col, round(coalesce(sum(CASE WHEN frp > 0 THEN frp END), 0), 6) AS frp, count(*) AS detections FROM vis GROUP BY 1, 2""", det=True)
def grid_sums(spark, table):
    d = detections(table).select(F.floor((F.col("lat") - 37) * 200).alias("row"), F.floor((F.col("lon") + 2) * 100).alias("col"), "frp")
    return issues.grid_sums(d).withColumn("frp", F.round("frp", 6))


@book.add("""SELECT c_mktsegment, count(*) AS n, count(*) FILTER (WHERE c_acctbal > 0) AS positive, round(quantile_cont(c_acctbal, 0.5), 6) AS p50, round(quantile_cont(c_acctbal, 0.9), 6) AS p90, max(c_acctbal) AS largest FROM customer GROUP BY 1""")
def sample_stats(spark, table):
    return issues.sample_stats(table("customer"), "c_acctbal", "c_mktsegment").withColumns({c: F.round(c, 6) for c in ("p50", "p90")})


@book.add("""WITH e AS (SELECT c_custkey AS id, ['train', 'test', 'reserved', 'selection'][c_custkey % 4 + 1] AS role, c_custkey % 101 AS g, c_custkey * 37 % 3001 AS r, c_custkey * 53 % 2903 AS c FROM customer), x AS (SELECT * FROM e WHERE role <> 'reserved'),
p AS (SELECT DISTINCT x.role AS a, y.role AS b FROM x, x y WHERE x.role < y.role), s AS (SELECT x.role AS a, y.role AS b, count(DISTINCT x.g) AS shared_groups FROM x JOIN x y ON x.g = y.g AND x.role < y.role GROUP BY 1, 2),
o AS (SELECT x.role AS a, y.role AS b, count(DISTINCT x.id) AS "overlaps" FROM x JOIN x y ON x.role < y.role AND abs(x.r - y.r) < 64 AND abs(x.c - y.c) < 64 GROUP BY 1, 2)
SELECT p.a, p.b, coalesce(shared_groups, 0) AS shared_groups, coalesce(o."overlaps", 0) AS "overlaps" FROM p LEFT JOIN s ON p.a = s.a AND p.b = s.b LEFT JOIN o ON p.a = o.a AND p.b = o.b WHERE s.a IS NOT NULL OR o.a IS NOT NULL""")
def separation_audit(spark, table):
    k = F.col("c_custkey")
    role = F.get(F.array(*[F.lit(r) for r in ("train", "test", "reserved", "selection")]), (k % 4).cast("int"))
    return audits.separation(table("customer").select(k.alias("event_id"), role.alias("role"), (k % 101).alias("spatial_group"), (k * 37 % 3001).alias("seed_row"), (k * 53 % 2903).alias("seed_col")))


@book.add("""SELECT count(*) FILTER (WHERE h.k IS NULL) AS missing, count(*) FILTER (WHERE w.k IS NULL) AS extra, count(*) FILTER (WHERE h.n > 1) AS repeated FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) h FULL JOIN (SELECT DISTINCT c_custkey + 10 AS k FROM customer) w ON h.k = w.k""")
def coverage_equality(spark, table):
    return audits.coverage(table("orders").select(F.col("o_custkey").alias("k")), table("customer").select((F.col("c_custkey") + 10).alias("k")), "k")


@book.add("SELECT o_custkey AS k, max(o_orderkey) AS seq FROM orders GROUP BY 1")
def last_wins(spark, table):
    return audits.last_wins(table("orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("seq")), "k", "seq")


@book.add("""WITH d AS (SELECT o_custkey AS route, o_orderkey AS ord, o_orderpriority AS combo, CASE WHEN o_orderkey % 9 > 0 THEN CAST(o_orderkey % 50 * 100 AS DOUBLE) END AS d FROM orders), i AS (SELECT *, coalesce(d, 'infinity'::DOUBLE) AS x FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY route ORDER BY x, ord) AS lo, row_number() OVER (PARTITION BY route ORDER BY x DESC, ord) AS hi, count(*) OVER (PARTITION BY route) AS combos FROM i)
SELECT route, least(max(x) FILTER (WHERE lo = 1), 3000e0) AS earliest_s, max(combo) FILTER (WHERE lo = 1) AS earliest_combo, max(d) FILTER (WHERE hi = 1) AS latest_s, max(combo) FILTER (WHERE hi = 1) AS latest_combo, max(combos) AS combos FROM r GROUP BY route""")
def route_bands(spark, table):
    k = F.col("o_orderkey")
    d = table("orders").select(F.col("o_custkey").alias("route"), k.alias("ord"), F.col("o_orderpriority").alias("combo"), F.when(k % 9 > 0, (k % 50 * 100).cast("double")).alias("depart_s"))
    return routes.bands(d, 3000)


def _route_edges(table):
    k = F.col("l_partkey")
    highway = F.get(F.array(*[F.lit(h) for h in ("motorway", "primary", "tertiary", "track", "bridleway")]), (k % 5).cast("int"))
    return table("lineitem").select(F.col("l_orderkey").alias("route"), (F.col("l_linenumber") * 1000000 + k).alias("ord"), k.alias("edge"), highway.alias("highway"), F.when(k % 3 > 0, F.concat(F.lit("road "), k.cast("string"))).alias("name"))


@book.add("""WITH e AS (SELECT l_orderkey AS route, l_linenumber * 1000000 + l_partkey AS ord, l_partkey % 5 < 3 AS through, CASE WHEN l_partkey % 3 > 0 THEN 'road ' || l_partkey END AS name FROM lineitem),
r AS (SELECT route, name, row_number() OVER (PARTITION BY route ORDER BY NOT through, ord) AS nth FROM e WHERE name IS NOT NULL) SELECT o.route, coalesce(r.name, '') AS name FROM (SELECT DISTINCT route FROM e) o LEFT JOIN r ON r.route = o.route AND nth = 1""")
def road_names(spark, table):
    return routes.road_name(_route_edges(table))


@book.add("""WITH p AS (SELECT * FROM (VALUES (0, 'cautious', 0.7e0, 1.2e0, 0.6e0), (1, 'optimistic', 0.9e0, 1.6e0, 1.2e0)) AS v(k, profile, mobile, people, cap)), e AS (SELECT l_orderkey AS route, min([3600e0, 1800e0, 1200e0, 300e0, 600e0][l_partkey % 5 + 1]) AS slow FROM lineitem GROUP BY 1),
o AS (SELECT o_orderkey AS route, o_custkey % 3000 AS pop FROM orders WHERE o_orderkey % 4 > 0), c AS (SELECT e.route, k, profile, pop * mobile / people / cap / slow * 60 AS m FROM e JOIN o ON e.route = o.route, p)
SELECT route, round(max(m), 1) AS worst_min, round(min(m), 1) AS best_min, arg_max(profile, m * 1000 - k) AS worst_profile, arg_min(profile, m * 1000 + k) AS best_profile FROM c GROUP BY route""")
def clearance_range(spark, table):
    people = table("orders").select(F.col("o_orderkey").alias("route"), F.when(F.col("o_orderkey") % 4 > 0, F.col("o_custkey") % 3000).alias("population"))
    return routes.clearance_range(_route_edges(table), people).drop("edge")


@book.add("""WITH c AS (SELECT s_suppkey AS ord, CASE WHEN s_suppkey % 6 > 0 THEN s_suppkey % 3 END AS m, CASE WHEN s_suppkey % 5 > 0 THEN 37e0 END AS lat, CASE WHEN s_suppkey % 7 = 0 THEN 0e0 WHEN s_suppkey % 7 = 1 THEN 1000e0 WHEN s_suppkey % 7 > 2 THEN 500e0 END AS r FROM supplier)
SELECT CASE WHEN m IS NULL THEN '?-?-?-?#' || ord ELSE m || '-?-?-?' END AS id, count(*) AS n, CASE WHEN lat IS NULL THEN 'position is missing' WHEN r IS NULL OR r <= 0 THEN 'range is not a positive number' WHEN r = 1000 THEN 'assumed' ELSE 'measured' END AS what FROM c GROUP BY 1, 3""")
def served_footprints(spark, table):
    k, none = F.col("s_suppkey"), F.lit(None).cast("int")
    cells = table("supplier").select(k.alias("ord"), F.when(k % 6 > 0, k % 3).alias("mcc"), none.alias("mnc"), none.alias("lac"), none.alias("cellid"), F.when(k % 5 > 0, 37.0).alias("lat"), F.lit(-2.0).alias("lon"), F.when(k % 7 == 0, 0.0).when(k % 7 == 1, 1000.0).when(k % 7 > 2, 500.0).alias("range_m"))
    served, refused = routes.footprints(cells)
    both = served.select("id", F.when(F.col("measured"), "measured").otherwise("assumed").alias("what")).union(refused.select("id", F.col("reason").alias("what")))
    return both.groupBy("id", "what").agg(F.count("*").alias("n"))


@book.add("""SELECT c_custkey AS id, round(36e0 + (c_custkey % 97) / 20e0, 7) AS lat, round(-4e0 + (c_custkey % 89) / 40e0, 7) AS lon, CASE WHEN c_acctbal >= 8000 THEN 'HIGH' WHEN c_acctbal >= 5000 THEN 'NOMINAL' ELSE 'LOW' END AS label, round(least(1e0, greatest(0e0, c_acctbal / 150)), 9) AS scale FROM customer""")
def utm30n_round_trip(spark, table):
    k = F.col("c_custkey")
    e, n = geo.utm30_forward(F.lit(36.0) + k % 97 / F.lit(20.0), F.lit(-4.0) + k % 89 / F.lit(40.0))
    at = table("customer").select(k.alias("id"), e.alias("e"), n.alias("n"), "c_acctbal")
    lat, lon = geo.utm30_inverse(F.col("e"), F.col("n"))
    return at.select("id", F.round(lat, 7).alias("lat"), F.round(lon, 7).alias("lon"), geo.confidence_label(F.col("c_acctbal") / 10000).alias("label"), F.round(geo.frp_scale(F.col("c_acctbal")), 9).alias("scale"))
