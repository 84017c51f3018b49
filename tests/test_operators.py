"""Operators on small fixtures: nulls, ties, boundaries, brute force, poisoned futures."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from emberglass.constants import sweep_configs
from emberglass.operators import alerts, causal, egress, episodes, growth, normalize, scoring, spatial
from emberglass.operators.components import connected_components
from emberglass.sources import pages
from emberglass.storage import Scratch

DET = "id long, cluster_id long, at_s long, source string, frp double, lat double, lon double"


def test_future_rows_do_not_change_a_snapshot(spark):
    rows = [(k, k % 2, 1000 * k, "MTG_I1", float(k) or None, 37.0, -2.0) for k in range(20)]
    poisoned = [r if r[2] + 1020 <= 9000 else (*r[:4], 1e9, 0.0, 0.0) for r in rows]
    a, b = (sorted(map(tuple, causal.snapshot(causal.with_availability(spark.createDataFrame(x, DET)), 9000).collect())) for x in (rows, poisoned))
    assert a == b and len(a) == 2


def test_recorded_time_before_the_observation_is_none(spark):
    df = spark.createDataFrame([(1, 100, "MODIS_NRT", 90), (2, 100, "MODIS_NRT", 150), (3, 100, "__proto__", None)], "id int, at_s long, source string, r long")
    assert [r["available_s"] for r in causal.with_availability(df, "r").orderBy("id").collect()] == [None, 150, 10900]


def test_zero_is_measured_and_null_is_not(spark):
    raw = [("a", {"fire_radiative_power": "0", "confidence": "HIGH"}, [1.0, 2.0]), ("b", {"fire_radiative_power": " ", "confidence": "certain"}, [1.0, 2.0]), ("c", {"fire_radiative_power": "Infinity"}, None)]
    df = spark.createDataFrame(raw, "id string, props map<string,string>, coordinates array<double>")
    got = {r["id"]: (r["frp"], r["confidence"]) for r in normalize.hotspots(df).collect()}
    assert got == {"a": (0.0, 0.9), "b": (None, None)}
    assert tuple(normalize.rejected(df).first()) == (1, 3)


def test_sum_of_unmeasured_power_is_null(spark):
    df = spark.createDataFrame([(1, 1, None), (2, 1, None), (3, 2, 0.0)], "id long, cluster_id long, frp double").selectExpr("*", "0d lat", "0d lon")
    named = spark.createDataFrame([(1,), (2,), (3,)], "cluster_id long")
    assert {r["cluster_id"]: (r["total_frp"], len(r["hotspot_ids"])) for r in normalize.clusters(named, df).collect()} == {1: (None, 2), 2: (0.0, 1), 3: (None, 0)}


def test_asof_takes_the_latest_frame_or_the_first(spark):
    frames = spark.createDataFrame([(10, "a"), (20, "b")], "frame_s long, payload string")
    got = causal.asof(frames, spark.createDataFrame([(5,), (10,), (19,), (99,)], "cursor_s long"))
    assert sorted((r["cursor_s"], r["payload"]) for r in got.collect()) == [(5, "a"), (10, "a"), (19, "a"), (99, "b")]


def test_a_gap_of_the_limit_does_not_split(spark):
    df = spark.createDataFrame([(1, 1, 0), (2, 1, 100), (3, 1, 201)], "id long, k long, at_s long")
    assert [r["episode"] for r in episodes.sessions(df, ["k"], "at_s", 100).orderBy("id").collect()] == [0, 0, 1]


def test_label_policy(spark):
    df = spark.createDataFrame([("fire", 0), ("fire", 1), ("clear", 0), ("clear", 0), ("cloud", 0), ("cloud", 9)], "k string, flag int")
    assert {r["k"]: (r["positive"], r["known"]) for r in episodes.label_policy(df, ["k"]).collect()} == {"fire": (True, True), "clear": (False, True), "cloud": (False, False)}


def test_radius_is_inclusive_and_evidence_holds_ties(spark):
    pairs = spark.createDataFrame([(1, 7, 100.0), (1, 8, 100.0), (1, 9, 100.0001)], "seg_id long, id long, distance_m double")
    det = spark.createDataFrame([(7, 50, "MODIS_NRT", None), (8, 50, "MODIS_NRT", None), (9, 10, "MODIS_NRT", None)], "id long, at_s long, source string, confidence double")
    got = {r["config"]: (r["cut_s"], r["evidence"]) for r in spatial.cut_field(pairs, det, sweep_configs(spark)).collect()}
    assert got["all-100m"] == (50, [7, 8]) and got["all-1x"] == (10, [9])
    assert "geo-1x" not in got and "all-1x-highconf" not in got
    band = spatial.band(spatial.cut_field(pairs, det, sweep_configs(spark))).first()
    assert (band["earliest_config"], band["latest_config"], band["latest_s"]) == ("all-1x", "all-100m", 50)


def brute_departure(edges, cut, seeds, node, seen=()):
    best = seeds.get(node, -egress.INF)
    for e, a, b, s in edges:
        if a == node and b not in seen:
            best = max(best, min(cut.get(e, egress.INF), brute_departure(edges, cut, seeds, b, (*seen, node))) - s)
    return best


def test_latest_departure_equals_all_paths():
    rng = random.Random(5)
    for _ in range(150):
        edges = [(k, rng.randrange(6), rng.randrange(6), rng.randint(1, 9)) for k in range(rng.randint(1, 11))]
        cut = {k: rng.randint(5, 40) for k, *_ in edges if rng.random() < 0.6}
        seeds = {n: rng.choice([egress.INF, rng.randint(10, 40)]) for n in rng.sample(range(6), 2)}
        got = egress.latest_departure(edges, cut, seeds)
        for n in range(6):
            assert got.get(n, -egress.INF) == brute_departure(edges, cut, seeds, n)


def test_route_is_the_shortest_that_is_in_time():
    edges = [(1, 0, 1, 10, 100.0), (2, 1, 2, 10, 100.0), (3, 0, 2, 50, 150.0)]
    for cut, end, way in (({}, egress.INF, [3]), ({}, 100.0, [1, 2]), ({3: 20}, 100.0, [1, 2]), ({3: 60, 1: 1}, 100.0, [3])):
        g = egress.latest_departure([e[:4] for e in edges], cut, {2: end})
        assert egress.route(edges, cut, g, 0, {2})[0] == way
    assert egress.route(edges, {}, {}, 0, {2}) is None


def test_components_and_dbscan(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(1, 1), (None, 3)]
    root = {n: n for e in edges for n in e if None not in e}
    for _ in range(60):
        for a, b in edges:
            if a is not None:
                root[a] = root[b] = min(root[a], root[b])
    got = connected_components(spark.createDataFrame(edges, "src long, dst long"), Scratch(spark, "t"))
    assert dict(map(tuple, got.collect())) == root
    pts = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.5, 0.0), (3, 1.0, 0.0), (4, 1.9, 0.0), (5, 9.0, 9.0)], "id long, x double, y double")
    assert {r["id"]: (r["kind"], r["label"]) for r in egress.dbscan(pts, 1.0, 3, Scratch(spark, "t")).collect()} == {1: ("core", 1), 2: ("core", 1), 3: ("core", 1), 4: ("border", 1), 5: ("noise", -1)}


def test_average_precision_groups_ties(spark):
    df = spark.createDataFrame([(1, 1, 0.9), (1, 0, 0.5), (1, 1, 0.5), (2, 0, 0.5)], "k int, y int, p double")
    got = {r["k"]: r["ap"] for r in scoring.average_precision(df, ["k"], "y", "p").collect()}
    assert got[1] == pytest.approx(0.5 + 0.5 * 2 / 3) and got[2] is None


def test_gate_blocks_what_is_unknown(spark):
    df = spark.createDataFrame([("a", 9000.0, None, 10.0), ("b", 9000.0, None, None), ("c", None, None, 1.0)], "route string, earliest_s double, latest_s double, clearance_min double")
    assert {r["route"]: r["reason"] for r in egress.gate(df, 1000).collect()} == {"a": "open", "b": "clearance unknown", "c": "no way out"}
    assert egress.verdict(egress.gate(df, 1000, observed=False).withColumn("k", F.lit(1)), ["k"], observed=False).first()["verdict"] == "not_yet_observed"


def test_growth_needs_enough_evidence(spark):
    rows = [(k, 1, 1800 * k, "MTG_I1", None, 37.0 + 0.01 * k, -2.0) for k in range(5)] + [(9, 2, 0, "MTG_I1", None, 37.0, -2.0)]
    got = growth.observed(spark.createDataFrame(rows, DET), 9000).collect()
    assert [r["cluster_id"] for r in got] == [1] and got[0]["bearing"] == pytest.approx(0.0, abs=1e-6) and got[0]["rate_kmh"] == pytest.approx(2.22, abs=0.05)


def test_names_and_templates(spark):
    c = spark.createDataFrame([(1, " SORBAS "), (2, "a-7"), (3, ""), (4, "x")], "cid int, name string")
    places, ways = spark.createDataFrame([(5, "Sorbas")], "id long, name string"), spark.createDataFrame([(1, "A-7"), (2, "sorbas")], "id long, name string")
    assert {r["cid"]: (r["kind"], r["target"]) for r in alerts.resolve(c, places, ways).collect()} == {1: ("place", 5), 2: ("way", 1), 3: (None, None), 4: (None, None)}


def collection(path):
    at = int(path.split("startIndex=")[1])
    n = 1000 if at < 2000 else 7
    return json.dumps({"type": "FeatureCollection", "features": [{"id": f"{at}-{k}", "properties": {"at_s": 5}} for k in range(n)]})


def test_paging_retries_and_refuses():
    assert len(list(pages.all_pages(collection, "x", wait=0))) == 2007
    with pytest.raises(ValueError):
        list(pages.all_pages(lambda p: "[]", "x", wait=0))
    calls = itertools.count()

    def shaky(path):
        if next(calls) < 2:
            raise ConnectionError
        return json.dumps({"type": "FeatureCollection", "features": []})

    assert list(pages.all_pages(shaky, "x", wait=0)) == [] and next(calls) == 3


def test_feature_source_reads_by_day(spark):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(pages.FeatureSource)
    df = spark.read.format("features").options(collection="hotspots", from_s=0, to_s=2 * 86400, transport="tests.test_operators:collection", wait=0).load()
    assert df.count() == 2 * 2007
    assert df.filter("at_s >= 86400").rdd.getNumPartitions() == 1


def test_stream_equals_batch(spark, tmp_path):
    from emberglass.streaming.windows import tumbling

    rows = [(k, k % 3, 700 * k, "MTG_I1", 1.0, 37.0, -2.0) for k in range(40)]
    df = spark.createDataFrame(rows, DET)
    df.write.parquet(str(tmp_path / "in"))
    out = tumbling(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = out.writeStream.outputMode("complete").format("memory").queryName("bins").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.sql("SELECT * FROM bins").collect())) == sorted(map(tuple, tumbling(df).collect()))


def test_shapes(spark):
    import numpy as np

    from emberglass.functions import shapes

    square = np.array([(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)], float)
    half = shapes.morph(square, square[[2, 3, 4, 1, 2]] + 2, 0.5, 8)
    assert half.mean(0) == pytest.approx([1.5, 1.5], abs=0.3) and (half[0] == half[-1]).all()
    ring = [{"lat": a, "lon": b} for a, b in [(0.0, 0.0), (0.0, 2.0), (2.0, 2.0), (2.0, 0.0), (0.0, 0.0)]]
    df = spark.createDataFrame([(1, ring)], "id int, ring array<struct<lat: double, lon: double>>")
    assert {(r["row"], r["col"]) for r in shapes.cells_in_ring(df, 1.0).collect()} == {(0, 0), (0, 1), (1, 0), (1, 1)}
    lat, lon = shapes.destination(F.lit(0.0), F.lit(179.5), F.lit(90.0), F.lit(111.195))
    assert tuple(spark.range(1).select(lat, lon).first()) == pytest.approx((0.0, -179.5), abs=1e-3)
    assert [r[0] for r in spark.createDataFrame([(1704067200,), (1720000000,)], "t long").select(shapes.local_stamp(F.col("t"))).collect()] == ["2024-01-01T01:00:00+01:00", "2024-07-03T11:46:40+02:00"]


def test_api(spark):
    from emberglass.plans import api

    assert api.cursor("12") == 12 and api.cursor(None) is None
    for bad in ("-1", "1.5", "x", "", "9" * 15):
        with pytest.raises(ValueError):
            api.cursor(bad)
    rows = [(k, 1, 1800 * k, "MTG_I1", None, 37.0 + 0.01 * k, -2.0) for k in range(5)]
    det = causal.with_availability(spark.createDataFrame(rows, DET))
    assert api.fires(det, 4000)["clusters"].first()["n"] == 2
    assert {r["predictor"]: r["rate_kmh"] for r in api.growth_of(det, 9000, 0.5).collect()}["constant_rate"] == 0.5
    t = spark.createDataFrame([(1, 5, "5km", 2.0, True)], "fire_id long, asset_id long, ring string, distance_km double, in_corridor boolean")
    s = api.situation_of(det, t, spark.createDataFrame([(1, 99)], "fire_id long, valid_s long"), 9000).first()
    assert s["spread_status"] == "expired" and s["total_frp"] is None and s["text"] == "5 detections. 1 assets near, 1 in the path. The forecast has expired."
    e = spark.createDataFrame([(k,) for k in range(5)], "seq int")
    assert [r["seq"] for r in api.ledger(e, 2).collect()] == [3, 4] and api.ledger(e, 0).count() == 0
