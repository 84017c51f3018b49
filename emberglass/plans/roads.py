"""Queries over graphs, departures, alerts and ledgers."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberglass.constants import PROFILES, SWEEP, profiles, sweep_configs
from emberglass.operators import alerts, egress, evacuation, messages
from emberglass.plans.base import Book
from emberglass.storage import Scratch

book = Book()

# customers and suppliers are the nodes of a layered graph: each order leads on from its customer
GRAPH_SQL = """e AS (SELECT o_orderkey AS edge, o_custkey % 40 AS region, CAST(o_custkey % 7 * 10 + o_orderkey % 3 AS BIGINT) AS src, CAST((o_custkey % 7 + 1) * 10 + o_orderkey % 4 AS BIGINT) AS dst, CAST(60 + o_orderkey % 50 AS DOUBLE) AS travel_s,
  CASE WHEN o_orderkey % 4 = 0 THEN CAST(3600 + o_orderkey % 900 AS DOUBLE) END AS cut_s FROM orders WHERE o_custkey % 7 < 6)"""


def graph(table):
    o, k, c = table("orders"), F.col("o_orderkey"), F.col("o_custkey")
    return o.filter(c % 7 < 6).select(k.alias("edge"), (c % 40).alias("region"), (c % 7 * 10 + k % 3).alias("src"), ((c % 7 + 1) * 10 + k % 4).alias("dst"), (60 + k % 50).cast("double").alias("travel_s"), F.when(k % 4 == 0, (3600 + k % 900).cast("double")).alias("cut_s"))


_LAYERS = ", ".join(f"r{k} AS (SELECT e.region, e.src AS node, max(least(coalesce(e.cut_s, 1e18), r.depart_s) - travel_s) AS depart_s FROM e JOIN r{k + 1} r ON e.region = r.region AND e.dst = r.node GROUP BY e.region, e.src)" for k in range(5, -1, -1))


@book.add(f"""WITH {GRAPH_SQL}, r6 AS (SELECT region, CAST(60 + k AS BIGINT) AS node, 5000e0 + 100 * k AS depart_s FROM (SELECT DISTINCT region FROM e) r, (VALUES (0), (1)) AS v(k)), {_LAYERS}
{" UNION ALL ".join(f"SELECT * FROM r{k}" for k in range(7))}""")
def latest_departure(spark, table):
    edges = graph(table)
    ends = edges.select("region").distinct().withColumn("k", F.explode(F.array(F.lit(0), F.lit(1)))).select(F.lit(None).cast("long").alias("edge"), "region", F.lit(None).cast("long").alias("src"), (60 + F.col("k")).cast("long").alias("dst"), F.lit(None).cast("double").alias("travel_s"), (5000.0 + 100 * F.col("k")).alias("cut_s"))
    return egress.departures(edges.unionByName(ends), ["region"], Scratch(spark, "departures"))


def lanes_graph(spark, table):
    """(edges, ends, lanes): orders as roads that lead from a customer to twice or half its number, with ways round; travel
    by profile and cuts by configuration as maps; the first three customers are destinations."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    configs = [(k, name) for k, name, *_ in SWEEP]
    to = F.when(o % 3 == 0, F.greatest(F.lit(1), F.floor(c / 2))).otherwise(c * 2 + o % 2).cast("long")
    travel = F.create_map(*[x for name, *_, speed, _ in PROFILES for x in (F.lit(name), F.round((60 + o % 50) / speed))])
    cut = F.map_from_entries(F.array_compact(F.array(*[F.when((o + k) % 5 < 2, F.struct(F.lit(name).alias("k"), (2000.0 + (o * (k + 1)) % 3000).alias("v"))) for k, name in configs])))
    edges = table("orders").select(o.alias("edge"), c.alias("src"), to.alias("dst"), travel.alias("travel"), cut.alias("cut"))
    own = F.map_from_entries(F.array(*[F.struct(F.lit(name).alias("k"), F.lit(4000.0 + 100 * k).alias("v")) for k, name in configs if k % 3]))
    ends = table("customer").filter("c_custkey <= 3").select(F.col("c_custkey").alias("destination"), F.col("c_custkey").alias("node"), own.alias("cut"))
    return edges, ends, profiles(spark).select("profile").crossJoin(sweep_configs(spark).select("config"))  # 24 rows


@book.add()
def departure_lanes(spark, table):
    return egress.departure_lanes(*lanes_graph(spark, table), Scratch(spark, "lanes"))


def evacuees(spark, table):
    """What evacuation() takes: orders as roads as in lanes_graph(), with cuts of every configuration, and regions as places."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    to = F.when(o % 3 == 0, F.greatest(F.lit(1), F.floor(c / 2))).otherwise(c * 2 + o % 2).cast("long")
    edges = table("orders").select(o.alias("edge"), c.alias("src"), to.alias("dst"), _highway(o).alias("highway"), (100.0 + o % 900).alias("metres"), (60.0 + o % 50).alias("travel_s")).filter("src <> dst")
    ords = F.explode(F.sequence(F.lit(0), F.lit(len(SWEEP) - 1)))
    config = F.get(F.array(*[F.lit(x[1]) for x in SWEEP]), F.col("k")).alias("config")
    wait = (F.col("k") % 3 * 1000).cast("long").alias("latency_s")
    cuts = table("orders").select(o.alias("edge"), ords.alias("k")).filter((F.col("edge") + F.col("k")) % 5 < 2).select("edge", config, (2000 + (F.col("edge") * (F.col("k") + 1)) % 9000).cast("long").alias("cut_s"), wait)
    burnt = table("customer").select(F.col("c_custkey").alias("node"), ords.alias("k")).filter((F.col("node") * 7 + F.col("k")) % 6 == 0).select("node", config, (6000 + (F.col("node") * (F.col("k") + 3)) % 9000).cast("long").alias("cut_s"), wait)
    r = F.col("r_regionkey")
    places = table("region").select(r.cast("string").alias("sid"), F.col("r_name").alias("name"), F.when(r % 4 < 3, r * 300).cast("long").alias("population"), (r + 1).cast("long").alias("node"))
    return edges, cuts, burnt, places, places.select("sid")


@book.add()
def evacuation_routes(spark, table):
    routes, verdicts = evacuation.evacuation(*evacuees(spark, table), 4000, 20_000, True, Scratch(spark, "evacuation"))
    return routes.join(verdicts.select("pocket", "verdict"), "pocket")


@book.add("""WITH RECURSIVE g AS (SELECT s_suppkey AS a, s_suppkey - s_suppkey % 4 AS b FROM supplier WHERE s_suppkey % 4 > 0), u AS (SELECT a, b FROM g UNION SELECT b, a FROM g),
r AS (SELECT DISTINCT a AS node, a AS root FROM u UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.node), c AS (SELECT node, min(root) AS component FROM r GROUP BY node)
SELECT node, component FROM c""")
def cluster_components(spark, table):
    from emberglass.operators.components import connected_components

    s = F.col("s_suppkey")
    edges = table("supplier").filter(s % 4 > 0).select(s.alias("src"), (s - s % 4).alias("dst"))
    return connected_components(edges, Scratch(spark, "components"))


@book.add("""WITH RECURSIVE g AS (SELECT s_suppkey AS a, s_suppkey - s_suppkey % 4 AS b FROM supplier WHERE s_suppkey % 4 > 0), u AS (SELECT a, b FROM g UNION SELECT b, a FROM g),
r AS (SELECT DISTINCT a AS node, a AS root FROM u UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.node), c AS (SELECT node, min(root) AS component FROM r GROUP BY node), z AS (SELECT component, count(*) AS n FROM c GROUP BY component)
SELECT count(*) AS components, max(n) AS largest, (SELECT count(*) FROM supplier WHERE s_suppkey NOT IN (SELECT node FROM c)) AS isolated FROM z""")
def graph_topology(spark, table):
    s = F.col("s_suppkey")
    edges = table("supplier").filter(s % 4 > 0).select(s.alias("src"), (s - s % 4).alias("dst"))
    return egress.topology(edges, table("supplier").select(s.alias("node")), Scratch(spark, "topology"))


@book.add("""WITH RECURSIVE p AS (SELECT s_suppkey AS id, (s_suppkey * 37 % 101) * 1e0 AS x, (s_suppkey * 53 % 103) * 1e0 AS y FROM supplier),
l AS (SELECT a.id, b.id AS other FROM p a JOIN p b ON a.id <> b.id AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 100), core AS (SELECT id FROM l GROUP BY id HAVING count(*) + 1 >= 4),
i AS (SELECT l.id, l.other FROM l WHERE l.id IN (SELECT id FROM core) AND l.other IN (SELECT id FROM core)),
r AS (SELECT id AS node, id AS root FROM core UNION SELECT i.other, r.root FROM r JOIN i ON i.id = r.node), c AS (SELECT node, min(root) AS label FROM r GROUP BY node)
SELECT p.id, CASE WHEN c.label IS NOT NULL THEN 'core' WHEN n.near IS NOT NULL THEN 'border' ELSE 'noise' END AS kind, coalesce(c.label, n.near, -1) AS label FROM p LEFT JOIN c ON c.node = p.id LEFT JOIN (SELECT l.id, min(c.label) AS near FROM l JOIN c ON c.node = l.other GROUP BY l.id) n ON n.id = p.id""")
def dbscan_labels(spark, table):
    s = F.col("s_suppkey")
    points = table("supplier").select(s.alias("id"), (s * 37 % 101).cast("double").alias("x"), (s * 53 % 103).cast("double").alias("y"))
    return egress.dbscan(points, 10.0, 4, Scratch(spark, "dbscan"))


HIGHWAYS = ["motorway", "primary", "tertiary", "track", "bridleway"]


def _highway(c):
    return F.get(F.array(*[F.lit(h) for h in HIGHWAYS]), (c % 5).cast("int"))


@book.add("""WITH p AS (SELECT * FROM (VALUES ('cautious', 0.7e0), ('optimistic', 1.15e0)) AS v(profile, s)), e AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity * 10 AS t, [100, 80, 60, 15, NULL][l_partkey % 5 + 1] AS v FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, profile, CASE WHEN v IS NULL THEN t ELSE greatest(1e0, round(t * v / greatest(1, round(v * s)))) END AS travel_s FROM e, p""")
def highway_speed_scaling(spark, table):
    rows = table("lineitem").crossJoin(F.broadcast(profiles(spark)))  # two profiles
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "profile", egress.scaled_travel(F.col("l_quantity") * 10, _highway(F.col("l_partkey")), F.col("speed_scale")).alias("travel_s"))


@book.add("""WITH e AS (SELECT l_orderkey AS route, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS ord, l_partkey AS edge, l_quantity * 20 / [3600, 1800, 1200, 300, 600][l_partkey % 5 + 1] * 60 AS m FROM lineitem),
w AS (SELECT *, row_number() OVER (PARTITION BY route ORDER BY m DESC, ord) AS nth FROM e) SELECT route, edge, round(m, 6) AS clearance_min FROM w WHERE nth = 1""")
def route_bottleneck(spark, table):
    from pyspark.sql import Window

    ord_ = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    e = table("lineitem").select(F.col("l_orderkey").alias("route"), ord_.alias("ord"), F.col("l_partkey").alias("edge"), _highway(F.col("l_partkey")).alias("highway"), (F.col("l_quantity") * 20).alias("vehicles"))
    return egress.bottleneck(e).withColumn("clearance_min", F.round("clearance_min", 6))


@book.add("""WITH r AS (SELECT o_orderkey AS route, CASE WHEN o_orderkey % 11 > 0 THEN 3000e0 + o_orderkey % 9000 END AS e, CASE WHEN o_orderkey % 7 > 0 THEN (o_orderkey % 60) * 1e0 END AS c FROM orders),
g AS (SELECT route, CASE WHEN e IS NULL THEN 'no way out' WHEN c IS NULL THEN 'clearance unknown' WHEN e - c * 60 - 1800 < 4000 THEN 'too late' ELSE 'open' END AS reason FROM r) SELECT route, reason, reason = 'open' AS usable FROM g""")
def departure_gate(spark, table):
    k = F.col("o_orderkey")
    r = table("orders").select(k.alias("route"), F.when(k % 11 > 0, 3000.0 + k % 9000).alias("earliest_s"), F.lit(None).cast("double").alias("latest_s"), F.when(k % 7 > 0, (k % 60).cast("double")).alias("clearance_min"))
    return egress.gate(r, 4000).select("route", "reason", "usable")


@book.add("""SELECT c_custkey, replace(replace('Leave {place} by {road}, {unknown}', '{place}', c_name), '{road}', CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE '{road}' END) AS text, CASE WHEN c_custkey % 2 = 0 THEN 'unknown' ELSE 'road,unknown' END AS missing FROM customer""")
def template_fill(spark, table):
    text = alerts.fill(F.lit("Leave {place} by {road}, {unknown}"), {"place": F.col("c_name"), "road": F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment"))})
    return table("customer").select("c_custkey", text.alias("text")).withColumn("missing", F.array_join(alerts.unresolved(F.col("text")), ","))


@book.add("""WITH p AS (SELECT lower(trim(n_name)) AS k, min(n_nationkey) AS id FROM nation GROUP BY 1), w AS (SELECT lower(trim(r_name)) AS k, min(r_regionkey) AS id FROM region GROUP BY 1),
c AS (SELECT c_custkey AS cid, CASE c_custkey % 3 WHEN 0 THEN '  ' || upper(n_name) || ' ' WHEN 1 THEN lower(r_name) ELSE 'nowhere' END AS name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT cid, name, CASE WHEN p.id IS NOT NULL THEN 'place' WHEN w.id IS NOT NULL THEN 'way' END AS kind, coalesce(p.id, w.id) AS target FROM c LEFT JOIN p ON p.k = lower(trim(name)) LEFT JOIN w ON w.k = lower(trim(name))""")
def name_resolution(spark, table):
    n, r = table("nation"), table("region")
    m = F.col("c_custkey") % 3
    name = F.when(m == 0, F.concat(F.lit("  "), F.upper("n_name"), F.lit(" "))).when(m == 1, F.lower("r_name")).otherwise("nowhere")
    c = table("customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("c_custkey").alias("cid"), name.alias("name"))
    return alerts.resolve(c, n.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")), r.select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name")))


@book.add("SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')) AS digest FROM pages")
def xml_escape(spark, table):
    return table("pages").select("page_id", F.md5(alerts.xml_escape(F.col("html"))).alias("digest"))


@book.add("""SELECT c_custkey, substr(sha256('{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '","c_name":"' || c_name || '"}'), 1, 16) AS fingerprint FROM customer""")
def fingerprints(spark, table):
    return table("customer").select("c_custkey", alerts.fingerprint("c_name", "c_custkey", "c_mktsegment").alias("fingerprint"))


@book.add("""WITH e AS (SELECT o_orderkey AS seq, o_custkey % 50 AS cursor_s, o_orderstatus AS fingerprint, o_orderpriority AS pocket FROM orders), l AS (SELECT DISTINCT cursor_s, fingerprint, pocket FROM e WHERE seq % 7 = 0)
SELECT min(seq) AS seq, cursor_s, fingerprint, pocket FROM e WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.cursor_s = e.cursor_s AND l.fingerprint = e.fingerprint AND l.pocket = e.pocket) GROUP BY cursor_s, fingerprint, pocket""")
def ledger_append_dedup(spark, table):
    e = table("orders").select(F.col("o_orderkey").alias("seq"), (F.col("o_custkey") % 50).alias("cursor_s"), F.col("o_orderstatus").alias("fingerprint"), F.col("o_orderpriority").alias("pocket"))
    return alerts.append_new(e.filter(F.col("seq") % 7 == 0), e).select("seq", "cursor_s", "fingerprint", "pocket")


@book.add("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 1 THEN 'no_action' WHEN c_custkey % 3 = 0 OR e < 500 THEN 'no_verified_action' WHEN c_custkey % 5 = 3 THEN 'evacuate_alternate' ELSE 'evacuate_primary' END AS instruction,
 CASE WHEN l IS NULL THEN CASE WHEN e = 900 THEN 'Likely' ELSE 'Possible' END WHEN l - e <= 7200 THEN 'Likely' ELSE 'Possible' END AS certainty FROM (SELECT *, (c_custkey % 10) * 100e0 AS e, CASE WHEN c_custkey % 4 > 0 THEN (c_custkey % 10) * 100e0 + (c_custkey % 9) * 1000 END AS l FROM customer)""")
def alert_decisions(spark, table):
    k = F.col("c_custkey")
    e = (k % 10) * 100.0
    late = F.when(k % 4 > 0, e + (k % 9) * 1000)
    return table("customer").select("c_custkey", alerts.instruction(k % 2 == 0, k % 3 > 0, e, _highway(k), 500).alias("instruction"), alerts.certainty(e, late, 900).alias("certainty"))


@book.add("""WITH p AS (SELECT n_nationkey AS pocket, l.lang, '<info><language>' || l.lang || '</language><headline>' || n_name || ' &amp; ' || l.lang || '</headline><area><polygon>1.000000,2.000000</polygon></area></info>' AS x FROM nation, (VALUES ('es'), ('en')) AS l(lang))
SELECT pocket, '<alert xmlns="urn:oasis:names:tc:emergency:cap:1.2"><identifier>pocket-' || pocket || '-20240101T000000</identifier><sent>2024-01-01T00:00:00Z</sent>' || string_agg(x, '' ORDER BY lang) || '</alert>' AS xml FROM p GROUP BY pocket""")
def cap_documents(spark, table):
    p = table("nation").withColumn("lang", F.explode(F.array(F.lit("es"), F.lit("en"))))
    area = alerts.polygon_text(F.array(F.struct(F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon")), F.struct(F.lit(91.0).alias("lat"), F.lit(0.0).alias("lon"))))
    return alerts.cap_documents(p.select(F.col("n_nationkey").alias("pocket"), F.lit("2024-01-01T00:00:00Z").alias("sent"), "lang", F.concat("n_name", F.lit(" & "), "lang").alias("headline"), area.alias("area")))


def _said(sentence: str) -> str:
    return f"replace(replace(replace('{sentence}', '{{pocket}}', name), '{{road}}', road), '{{destination}}', coalesce(destination, ''))"


_SAID = " ".join(f"WHEN instruction = '{k}' AND language = '{lang}' THEN {_said(v[3][lang])}" for k, v in messages.SENTENCES.items() for lang in ("es", "en"))


@book.add(f"""WITH w AS (SELECT n_nationkey AS edge, CASE WHEN n_nationkey % 5 > 0 THEN 'Road ' || n_name END AS name, ['motorway', 'primary', 'tertiary', 'track', 'bridleway'][n_nationkey % 5 + 1] AS highway FROM nation),
r AS (SELECT c_custkey AS pocket, k, 1000e0 * (c_custkey % 7) + 500 * k AS t, (c_custkey + k) % 3 > 0 AS usable, (c_custkey + k) % 25 AS n, CASE WHEN c_custkey % 4 = 0 THEN 'track' ELSE 'primary' END AS slowest FROM customer, (VALUES (0), (1)) AS v(k)),
b AS (SELECT r.*, n_name AS destination, row_number() OVER (PARTITION BY pocket ORDER BY t DESC, n_name) AS nth FROM r JOIN nation ON n_nationkey = n WHERE usable),
d AS (SELECT b.*, coalesce((SELECT first(w.name ORDER BY NOT w.highway IN ('motorway', 'primary', 'tertiary'), o.ord) FROM (VALUES (0), (1)) AS o(ord) JOIN w ON w.edge = CASE WHEN o.ord = 0 THEN b.pocket % 25 ELSE b.n END WHERE w.name IS NOT NULL), '') AS road FROM b WHERE nth = 1),
p AS (SELECT c_custkey AS pocket, c_name AS name, coalesce(road, '') AS road, destination, CASE WHEN c_custkey % 11 = 0 THEN 'no_verified_action' WHEN c_custkey % 10 = 0 THEN 'no_action' WHEN d.t IS NULL OR d.t < 2000 THEN 'no_verified_action' WHEN slowest = 'track' THEN 'evacuate_alternate' ELSE 'evacuate_primary' END AS instruction FROM customer LEFT JOIN d ON d.pocket = c_custkey)
SELECT pocket, instruction, language, CASE {_SAID} END AS text FROM p, (VALUES ('es'), ('en')) AS l(language) WHERE NOT (instruction LIKE 'evacuate%' AND road = '')""")
def alert_packages(spark, table):
    c, k = F.col("c_custkey"), F.col("k")
    n = table("nation").select(F.col("n_nationkey").alias("n"), F.col("n_name").alias("destination"))
    highway = F.get(F.array(*[F.lit(h) for h in HIGHWAYS]), (F.col("n") % 5).cast("int"))
    ways = n.select(F.col("n").alias("edge"), F.when(F.col("n") % 5 > 0, F.concat(F.lit("Road "), "destination")).alias("name"), highway.alias("highway"))
    at = 1000.0 * (c % 7) + 500 * k
    r = table("customer").withColumn("k", F.explode(F.array(F.lit(0), F.lit(1)))).select(c.alias("pocket"), ((c + k) % 25).cast("int").alias("n"), F.concat_ws("-", c, k).alias("route"), F.array((c % 25).cast("int"), ((c + k) % 25).cast("int")).alias("edges"), at.alias("earliest_s"), at.alias("open_s"), ((c + k) % 3 > 0).alias("usable"), F.when(c % 4 == 0, "track").otherwise("primary").alias("slowest"))
    found = r.join(n, "n").withColumns({"km": F.lit(1.0), "travel_min": F.lit(1), "latest_s": F.lit(None).cast("double"), "basis": F.lit(""), "worst_min": F.lit(1.0)})
    point = F.lit(None).cast("array<struct<lat: double, lon: double>>")
    places = table("customer").select(c.alias("sid"), F.col("c_name").alias("name"), F.lit(37.0).alias("lat"), F.lit(-2.0).alias("lon"), point.alias("outline"), F.lit(None).cast("array<string>").alias("languages"), (c % 10 != 0).alias("reached"))
    verdicts = table("customer").select(c.alias("pocket"), F.when(c % 11 == 0, "not_yet_observed").otherwise("routes_open").alias("verdict"))
    rows = messages.recommended(found, verdicts, places, ways, 2000, 20_000)
    known = places.select("sid", "name").union(n.select(-1 - F.col("n"), "destination"))
    return messages.spoken(rows, known, ways)[0].select("pocket", "instruction", "language", "text")
