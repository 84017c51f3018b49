"""Queries over detections: causality, normalisation, growth, episodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberglass.functions import geo
from emberglass.operators import causal, episodes, growth, normalize
from emberglass.plans.base import Book, detections

book = Book()
CURSOR_S = 10 * 86400

HAV = "2 * 6371.0088e0 * asin(least(1e0, sqrt(pow(sin(radians({b} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({b})) * pow(sin(radians({d} - {c}) / 2), 2))))"
BEAR = "fmod(degrees(atan2(sin(radians({d} - {c})) * cos(radians({b})), cos(radians({a})) * sin(radians({b})) - sin(radians({a})) * cos(radians({b})) * cos(radians({d} - {c})))) + 360e0, 360e0)"


@book.add(f"SELECT cluster_id, count(*) AS n, round(sum(frp), 6) AS total_frp, round(avg(lat), 9) AS lat, round(avg(lon), 9) AS lon, min(at_s) AS first_s, max(at_s) AS last_s FROM vis WHERE available_s <= {CURSOR_S} GROUP BY cluster_id", det=True)
def causal_snapshot(spark, table):
    s = causal.snapshot(detections(table), CURSOR_S)
    return s.withColumns({"total_frp": F.round("total_frp", 6), "lat": F.round("lat", 9), "lon": F.round("lon", 9)})


@book.add("SELECT id, source, at_s, CAST(latency_s AS INT) AS latency_s, available_s FROM vis", det=True)
def availability_times(spark, table):
    return detections(table).select("id", "source", "at_s", "latency_s", "available_s")


@book.add("SELECT min(available_s) AS start_s, max(available_s) AS end_s, max(available_s) - min(available_s) AS duration_s, count(DISTINCT available_s) AS n_frames FROM vis", det=True)
def capture_timeline(spark, table):
    return causal.timeline(detections(table)).select("start_s", "end_s", "duration_s", F.size("frames").cast("long").alias("n_frames"))


@book.add("SELECT DISTINCT available_s AS frame_s FROM vis", det=True)
def capture_frames(spark, table):
    return causal.timeline_frames(detections(table))


@book.add("""WITH f AS (SELECT cluster_id, at_s AS frame_s, max(id) AS payload FROM vis WHERE source = 'MTG_I1' GROUP BY ALL),
c AS (SELECT cluster_id, available_s AS cursor_s FROM vis WHERE source <> 'MTG_I1'), k AS (SELECT DISTINCT * FROM c),
j AS (SELECT k.cluster_id, k.cursor_s, max(CASE WHEN frame_s <= cursor_s THEN frame_s END) AS t, min(frame_s) AS first FROM k JOIN f USING (cluster_id) GROUP BY ALL)
SELECT c.cluster_id, c.cursor_s, f.frame_s, f.payload FROM c JOIN j USING (cluster_id, cursor_s) JOIN f ON f.cluster_id = c.cluster_id AND f.frame_s = coalesce(t, first)""", det=True)
def frame_asof_by_cluster(spark, table):
    det = detections(table)
    frames = det.filter("source = 'MTG_I1'").select("cluster_id", F.col("at_s").alias("frame_s"), F.col("id").alias("payload"))
    return causal.asof(frames, det.filter("source <> 'MTG_I1'").select("cluster_id", F.col("available_s").alias("cursor_s")), by="cluster_id")


@book.add("""WITH f AS (SELECT at_s AS frame_s, min(id) AS payload FROM vis WHERE source = 'MTG_I1' GROUP BY at_s),
c AS (SELECT DISTINCT at_s AS cursor_s FROM vis WHERE source = 'SENTINEL_3A'),
j AS (SELECT cursor_s, (SELECT max(frame_s) FROM f WHERE frame_s <= cursor_s) AS t FROM c)
SELECT cursor_s, f.frame_s, payload FROM j JOIN f ON f.frame_s = coalesce(t, (SELECT min(frame_s) FROM f))""", det=True)
def frame_asof(spark, table):
    det = detections(table)
    frames = det.filter("source = 'MTG_I1'").groupBy(F.col("at_s").alias("frame_s")).agg(F.min("id").alias("payload"))
    return causal.asof(frames, det.filter("source = 'SENTINEL_3A'").select(F.col("at_s").alias("cursor_s")).distinct())


@book.add("""WITH c AS (SELECT unnest(range(1, 31)) * 86400 AS cursor_s)
SELECT cluster_id, CAST(cursor_s AS BIGINT) AS cursor_s, count(*) AS n, round(sum(frp), 6) AS total_frp FROM c JOIN vis ON available_s <= cursor_s GROUP BY cluster_id, cursor_s""", det=True)
def cumulative_snapshots_daily(spark, table):
    cursors = spark.range(1, 31).select((F.col("id") * 86400).alias("cursor_s"))
    return causal.cumulative_snapshots(detections(table), cursors).withColumn("total_frp", F.round("total_frp", 6)).withColumn("n", F.col("n").cast("long"))


@book.add("""WITH r AS (SELECT CAST(floor(min(at_s) / 86400) AS BIGINT) AS a, CAST(floor(max(at_s) / 86400) AS BIGINT) AS b FROM vis), d AS (SELECT unnest(range(a, b + 1)) AS day FROM r)
SELECT day * 86400 AS from_s, (day + 1) * 86400 AS to_s, count(id) AS n FROM d LEFT JOIN vis ON at_s >= day * 86400 AND at_s < (day + 1) * 86400 GROUP BY day""", det=True)
def day_windows(spark, table):
    from emberglass.sources.pages import day_windows as windows

    det = detections(table)
    days = windows(det.agg(F.min("at_s").alias("from_s"), F.max("at_s").alias("to_s")))
    n = det.groupBy((F.floor(F.col("at_s") / 86400) * 86400).cast("long").alias("from_s")).agg(F.count("*").alias("n"))
    return days.join(n, "from_s", "left").select("from_s", "to_s", F.coalesce("n", F.lit(0)).alias("n"))


@book.add("SELECT event_id, TRY_CAST(nullif(trim(raw), '') AS DOUBLE) AS number, coalesce(CASE WHEN trim(raw) <> '' THEN raw END, event_type) AS label FROM (SELECT event_id, event_type, CASE event_id % 4 WHEN 0 THEN ' ' || CAST(event_id AS VARCHAR) || ' ' WHEN 1 THEN '   ' WHEN 2 THEN 'n/a' ELSE NULL END AS raw FROM events)")
def normalize_numbers(spark, table):
    i = F.col("event_id")
    raw = F.when(i % 4 == 0, F.concat(F.lit(" "), i.cast("string"), F.lit(" "))).when(i % 4 == 1, "   ").when(i % 4 == 2, "n/a")
    rows = table("events").select("event_id", "event_type", raw.alias("raw"))
    return rows.select("event_id", normalize.number_or_null(F.col("raw")).alias("number"), normalize.first_non_blank(F.col("raw"), F.col("event_type")).alias("label"))


@book.add("SELECT event_id, CASE upper(trim(w)) WHEN 'HIGH' THEN 0.9e0 WHEN 'MEDIUM' THEN 0.65e0 WHEN 'LOW' THEN 0.3e0 END AS confidence FROM (SELECT event_id, ['high', ' Medium ', 'LOW', 'none', NULL][event_id % 5 + 1] AS w FROM events)")
def confidence_map(spark, table):
    word = F.get(F.array(*[F.lit(w) for w in ("high", " Medium ", "LOW", "none", None)]), (F.col("event_id") % 5).cast("int"))
    return table("events").select("event_id", normalize.confidence(word).alias("confidence"))


@book.add("SELECT event_id, CASE event_id % 3 WHEN 0 THEN CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) WHEN 1 THEN CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) - 7200 END AS at_s FROM events")
def iso_zone_gate(spark, table):
    text = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")
    zone = F.when(F.col("event_id") % 3 == 0, "Z").when(F.col("event_id") % 3 == 1, "+02:00").otherwise("")
    return table("events").select("event_id", normalize.zoned_epoch_s(F.concat(text, zone)).alias("at_s"))


@book.add("SELECT cluster_id, source, count(*) AS n FROM vis GROUP BY cluster_id, source", det=True)
def source_mix(spark, table):
    mix = growth.source_mix(detections(table))
    return mix.select("cluster_id", F.explode("source_mix").alias("source", "n"))


@book.add("SELECT cluster_id, round(sum(w * lat) / sum(w), 9) AS lat, round(sum(w * lon) / sum(w), 9) AS lon, round(sum(w * at_s) / sum(w), 3) AS mean_s FROM (SELECT *, CASE WHEN frp > 0 THEN frp ELSE 1e0 END AS w FROM vis) GROUP BY cluster_id", det=True)
def weighted_centroid(spark, table):
    return growth.weighted_centroid(detections(table), ["cluster_id"]).select("cluster_id", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"), F.round("mean_s", 3).alias("mean_s"))


@book.add(f"""WITH e AS (SELECT *, CASE WHEN frp > 0 THEN frp ELSE 1e0 END AS w FROM vis WHERE at_s BETWEEN {CURSOR_S} - 6 * 21600 AND {CURSOR_S}),
m AS (SELECT cluster_id, min(at_s) AS a, max(at_s) AS b, count(*) AS n FROM e GROUP BY cluster_id),
h AS (SELECT e.cluster_id, at_s <= (a + b) / 2e0 AS early, sum(w * lat) / sum(w) AS lat, sum(w * lon) / sum(w) AS lon, sum(w * at_s) / sum(w) AS t, max(n) AS n, max(b - a) AS span FROM e JOIN m ON e.cluster_id = m.cluster_id GROUP BY e.cluster_id, at_s <= (a + b) / 2e0),
p AS (SELECT x.cluster_id, x.n, x.span, {HAV.format(a='x.lat', b='y.lat', c='x.lon', d='y.lon')} AS km, {BEAR.format(a='x.lat', b='y.lat', c='x.lon', d='y.lon')} AS bearing, (y.t - x.t) / 3600e0 AS hours FROM h x JOIN h y ON x.cluster_id = y.cluster_id AND x.early AND NOT y.early)
SELECT cluster_id, n AS detections, CASE WHEN km >= 0.1 AND hours >= 0.5 THEN round(bearing, 4) END AS bearing, CASE WHEN km >= 0.1 AND hours >= 0.5 THEN round(km / hours, 6) END AS rate_kmh FROM p WHERE n >= 4 AND span >= 1800""", det=True)
def growth_vector(spark, table):
    g = growth.observed(detections(table), CURSOR_S, window_s=6 * 21600)
    return g.select("cluster_id", "detections", F.round("bearing", 4).alias("bearing"), F.round("rate_kmh", 6).alias("rate_kmh"))


@book.add(f"SELECT cluster_id, round(greatest(0e0, ({CURSOR_S} - max(at_s)) / 3600e0), 6) AS hours FROM vis WHERE available_s <= {CURSOR_S} GROUP BY cluster_id", det=True)
def hours_since_last(spark, table):
    return growth.hours_since_last(detections(table).filter(F.col("available_s") <= CURSOR_S), CURSOR_S).withColumn("hours", F.round("hours", 6))


@book.add("""WITH g AS (SELECT *, at_s - lag(at_s) OVER (PARTITION BY cluster_id ORDER BY at_s, id) AS gap FROM vis),
e AS (SELECT *, CAST(sum(CASE WHEN gap > 21600 THEN 1 ELSE 0 END) OVER (PARTITION BY cluster_id ORDER BY at_s, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS episode FROM g)
SELECT cluster_id, episode, count(*) AS n, min(at_s) AS start_s, max(at_s) AS end_s, round(sum(frp), 6) AS total_frp, round(avg(lon), 9) AS lon FROM e GROUP BY cluster_id, episode HAVING count(*) >= 2""", det=True)
def episodes_gap6h(spark, table):
    e = episodes.sessions(detections(table), ["cluster_id"], "at_s", 21600).groupBy("cluster_id", "episode")
    return e.agg(F.count("*").alias("n"), F.min("at_s").alias("start_s"), F.max("at_s").alias("end_s"), F.round(F.sum("frp"), 6).alias("total_frp"), F.round(F.avg("lon"), 9).alias("lon")).filter("n >= 2")


@book.add("""WITH g AS (SELECT *, at_s - lag(at_s) OVER (PARTITION BY cluster_id ORDER BY at_s, id) AS gap FROM vis),
e AS (SELECT *, CAST(sum(CASE WHEN gap > 86400 THEN 1 ELSE 0 END) OVER (PARTITION BY cluster_id ORDER BY at_s, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS episode, row_number() OVER (PARTITION BY cluster_id ORDER BY at_s, id) AS rn FROM g),
s AS (SELECT cluster_id, episode, min(at_s) AS start_s, max(at_s) AS end_s, count(*) AS n, arg_min(id, rn) AS seed FROM e GROUP BY cluster_id, episode HAVING count(*) >= 4)
SELECT cluster_id, episode, start_s, end_s, n, (end_s - start_s) / 3600e0 AS hours, substr(sha256(cluster_id || '|' || start_s || '|' || seed), 1, 24) AS event_id FROM s""", det=True)
def episodes_gap24h_catalogue(spark, table):
    return episodes.catalogue(detections(table), ["cluster_id"], "at_s", 86400, 4)


@book.add("""WITH g AS (SELECT *, at_s - lag(at_s) OVER (PARTITION BY cluster_id ORDER BY at_s, id) AS gap FROM vis),
e AS (SELECT *, sum(CASE WHEN gap > 21600 THEN 1 ELSE 0 END) OVER (PARTITION BY cluster_id ORDER BY at_s, id ROWS UNBOUNDED PRECEDING) AS episode FROM g)
SELECT cluster_id, min(at_s) AS start_s, max(at_s) AS end_s, count(*) AS n FROM e GROUP BY cluster_id, episode""", det=True)
def session_window_stream_equiv(spark, table):
    from emberglass.streaming.windows import sessions

    return sessions(detections(table), 21600)


@book.add("SELECT cluster_id, CAST(floor(at_s / 1800) * 1800 AS BIGINT) AS bin_s, count(*) AS n, round(avg(frp), 6) AS mean_frp FROM vis GROUP BY cluster_id, CAST(floor(at_s / 1800) * 1800 AS BIGINT)", det=True)
def tumbling_bins_30m(spark, table):
    return episodes.tumbling(detections(table), ["cluster_id"], "at_s", 1800, F.count("*").alias("n"), F.round(F.avg("frp"), 6).alias("mean_frp"))


@book.add("""WITH t AS (SELECT DISTINCT cluster_id, CAST(floor(at_s / 3600) * 3600 AS BIGINT) AS t FROM vis)
SELECT t.cluster_id, t.t, count(*) FILTER (WHERE at_s >= t.t AND at_s < t.t + 3600) AS current, count(*) FILTER (WHERE at_s < t.t) AS history, count(*) FILTER (WHERE at_s >= t.t + 3600) AS label
FROM t JOIN vis v ON v.cluster_id = t.cluster_id AND at_s >= t.t - 10800 AND at_s < t.t + 25200 GROUP BY t.cluster_id, t.t""", det=True)
def sliding_history_label(spark, table):
    return episodes.history_and_label(detections(table), ["cluster_id"], "at_s").select("cluster_id", "t", "current", "history", "label")


@book.add("""WITH f AS (SELECT cluster_id, CAST(floor(at_s / 3600) AS BIGINT) AS hour, CASE WHEN source = 'MTG_I1' THEN 1 WHEN source = 'MODIS_NRT' THEN 2 WHEN source = 'UNKNOWN_SRC' THEN 9 ELSE 0 END AS flag FROM vis)
SELECT cluster_id, hour, bool_or(flag IN (1, 2)) AS positive, bool_or(flag IN (1, 2)) OR bool_and(flag = 0) AS known, count(*) AS scans FROM f GROUP BY cluster_id, hour""", det=True)
def label_policy(spark, table):
    return episodes.label_policy(_flags(table), ["cluster_id", "hour"])


def _flags(table):
    flag = F.when(F.col("source") == "MTG_I1", 1).when(F.col("source") == "MODIS_NRT", 2).when(F.col("source") == "UNKNOWN_SRC", 9).otherwise(0)
    return detections(table).select("id", "cluster_id", "at_s", F.floor(F.col("at_s") / 3600).cast("long").alias("hour"), flag.alias("flag"))


@book.add("""WITH f AS (SELECT id, cluster_id, at_s, CASE WHEN source = 'MTG_I1' THEN 1 WHEN source = 'MODIS_NRT' THEN 2 WHEN source = 'UNKNOWN_SRC' THEN 9 ELSE 0 END AS flag FROM vis)
SELECT id, flag, last_value(CASE WHEN flag IN (0, 1, 2) THEN flag IN (1, 2) END IGNORE NULLS) OVER (PARTITION BY cluster_id ORDER BY at_s, id ROWS UNBOUNDED PRECEDING) AS state FROM f""", det=True)
def state_carry_forward(spark, table):
    rows = _flags(table).withColumn("o", F.struct("at_s", "id"))
    return causal.carry_state(rows, ["cluster_id"], "o").select("id", "flag", "state")


@book.add("""WITH c AS (SELECT CAST(cluster_id % 50 AS BIGINT) AS "row", CAST(id % 97 AS BIGINT) AS col, CAST(floor(at_s / 86400) AS BIGINT) AS day, id FROM vis),
core AS (SELECT "row", col FROM c GROUP BY "row", col HAVING count(DISTINCT day) >= 3),
dil AS (SELECT DISTINCT "row" + a AS "row", col + b AS col FROM core, (VALUES (-1), (0), (1)) AS x(a), (VALUES (-1), (0), (1)) AS y(b))
SELECT id FROM c WHERE NOT EXISTS (SELECT 1 FROM dil WHERE dil."row" = c."row" AND dil.col = c.col)""", det=True)
def persistent_prior(spark, table):
    cells = detections(table).select("id", (F.col("cluster_id") % 50).alias("row"), (F.col("id") % 97).alias("col"), F.floor(F.col("at_s") / 86400).cast("long").alias("day"))
    return cells.join(episodes.persistent_cells(cells, 3), ["row", "col"], "left_anti").select("id")


@book.add("""SELECT c_custkey, CAST(('0x' || substr(sha256('["split-v1", "' || c_name || '"]'), 1, 8)) AS BIGINT) % 100 AS bucket, CAST(('0x' || substr(sha256('["calibration-v1", "' || c_name || '"]'), 1, 8)) AS BIGINT) % 2 AS half FROM customer""")
def split_roles(spark, table):
    return table("customer").select("c_custkey", episodes.split_bucket(F.col("c_name")).alias("bucket"), episodes.split_bucket(F.col("c_name"), "calibration-v1", 2).alias("half"))


@book.add("""WITH e AS (SELECT p_partkey AS event_id, (p_partkey * 7919) % 20011 AS "row", (p_partkey * 104729) % 20021 AS col, CASE WHEN p_size % 10 = 0 THEN 'test' WHEN p_size % 10 = 1 THEN 'calibration' WHEN p_size % 10 = 2 THEN 'selection' ELSE 'train' END AS role FROM part),
c AS (SELECT e.event_id, e."row", e.col, CASE WHEN role = 'calibration' AND EXISTS (SELECT 1 FROM e g WHERE g.role = 'test' AND abs(g."row" - e."row") < 64 AND abs(g.col - e.col) < 64) THEN 'reserved' ELSE role END AS role FROM e),
s AS (SELECT e.event_id, e."row", e.col, CASE WHEN role = 'selection' AND EXISTS (SELECT 1 FROM c g WHERE g.role IN ('test', 'calibration') AND abs(g."row" - e."row") < 64 AND abs(g.col - e.col) < 64) THEN 'reserved' ELSE role END AS role FROM c e)
SELECT e.event_id, CASE WHEN role = 'train' AND EXISTS (SELECT 1 FROM s g WHERE g.role IN ('test', 'calibration', 'selection') AND abs(g."row" - e."row") < 64 AND abs(g.col - e.col) < 64) THEN 'reserved' ELSE role END AS role FROM s e""")
def purge_overlaps(spark, table):
    s = F.col("p_size") % 10
    role = F.when(s == 0, "test").when(s == 1, "calibration").when(s == 2, "selection").otherwise("train")
    events = table("part").select(F.col("p_partkey").alias("event_id"), (F.col("p_partkey") * 7919 % 20011).alias("row"), (F.col("p_partkey") * 104729 % 20021).alias("col"), role.alias("role"))
    return episodes.purge_overlaps(events).select("event_id", "role")


@book.add("""SELECT o_orderkey, k AS part_index, n AS part_count FROM (SELECT o_orderkey, unnest(range(0, CASE WHEN o_orderkey % 3 = 1 THEN 2 ELSE 1 END)) AS k, CASE WHEN o_orderkey % 3 = 1 THEN 2 ELSE 1 END AS n FROM orders WHERE o_orderkey % 3 < 2)""")
def polygon_parts_explode(spark, table):
    k = (F.col("o_orderkey") % 50).cast("double")
    square = lambda d: F.array(F.array(F.array(k, k), F.array(k + d, k), F.array(k + d, k + d), F.array(k, k + d), F.array(k, k)))
    open_ = F.array(F.array(F.array(k, k), F.array(k + 1, k), F.array(k + 1, k + 1), F.array(k, k + 1)))
    kind = F.col("o_orderkey") % 3
    rows = table("orders").select("o_orderkey", F.when(kind == 0, F.array(square(1.0))).when(kind == 1, F.array(square(1.0), open_, square(2.0))).otherwise(F.array(open_)).alias("polygons"))
    return normalize.perimeter_parts(rows, "polygons", ["o_orderkey"]).select("o_orderkey", F.col("part_index").cast("long").alias("part_index"), F.col("part_count").cast("long").alias("part_count"))


@book.add(f"SELECT a.id AS a, b.id AS b, round({HAV.format(a='a.lat', b='b.lat', c='a.lon', d='b.lon')}, 6) AS km FROM vis a JOIN vis b ON a.cluster_id = b.cluster_id AND a.id < b.id AND b.at_s - a.at_s <= 3600 AND a.at_s - b.at_s <= 3600", det=True)
def haversine_pairs(spark, table):
    a = detections(table).select(F.col("id").alias("a"), "cluster_id", F.col("at_s").alias("ta"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"))
    hour = F.floor(F.col("ta") / 3600).cast("long")
    b = a.withColumn("hour", hour).toDF("b", "cluster_id", "tb", "lat2", "lon2", "hour")
    # within an hour of each other: the same hour or its neighbours
    a = a.withColumn("hour", F.explode(F.array(hour - 1, hour, hour + 1)))
    near = a.join(b, ["cluster_id", "hour"]).filter("a < b and abs(ta - tb) <= 3600")
    return near.select("a", "b", F.round(geo.haversine_km(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")), 6).alias("km"))
