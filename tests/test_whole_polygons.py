"""Containment and distance against a plain test of every edge."""

import math
import os
import random

import pytest

from emberglass.operators import polygons
from emberglass.storage import Scratch

RINGS = "rings array<array<struct<lat: double, lon: double>>>"


def turned(x):
    return (x + 180) % 360 - 180


def plain(lat, lon, rings):
    """(inside, km to the nearest edge) over all edges of all rings."""
    lon0 = rings[0][0][1]
    ky = 111132.92 - 559.82 * math.cos(2 * math.radians(lat)) + 1.175 * math.cos(4 * math.radians(lat)) - 0.0023 * math.cos(6 * math.radians(lat))
    kx = 111412.84 * math.cos(math.radians(lat)) - 93.5 * math.cos(3 * math.radians(lat)) + 0.118 * math.cos(5 * math.radians(lat))
    x, inside, best = turned(lon - lon0), False, math.inf
    for ring in rings:
        for (la, lo), (lb, ld) in zip(ring, ring[1:] + ring[:1]):
            x1 = turned(lo - lon0)
            x2 = x1 + turned(ld - lo)
            if (x1 > x) != (x2 > x) and lat < la + (lb - la) * (x - x1) / (x2 - x1):
                inside = not inside
            px, py, dx, dy = (x - x1) * kx, (lat - la) * ky, (x2 - x1) * kx, (lb - la) * ky
            t = max(0, min(1, (px * dx + py * dy) / (dx * dx + dy * dy))) if dx or dy else 0
            best = min(best, math.hypot(px - t * dx, py - t * dy) / 1000)
    return inside, 0.0 if inside else best


def star(rng, lat, lon, size, n):
    return [(lat + size * (r := rng.uniform(0.2, 1)) * math.sin(a), turned(lon + size * r * math.cos(a))) for k in range(n) for a in [2 * math.pi * k / n]]


def frame(spark, shapes):
    return spark.createDataFrame([(k, [[{"lat": a, "lon": o} for a, o in ring] for ring in rings]) for k, rings in shapes], f"pid long, {RINGS}")


def test_against_every_edge(spark):
    rng = random.Random(4)
    shapes = []
    for k, (lat, lon) in enumerate([(37, -2), (37.05, -2.05), (-10, 179.99), (-10, -179.98), (64, 20), (0, 0), (80, -179.9)]):
        outer = star(rng, lat, lon, rng.choice([0.01, 0.1, 0.4]), rng.choice([3, 9, 120]))
        hole = [(lat + 0.1 * (a - lat), turned(lon + 0.1 * turned(o - lon))) for a, o in outer]
        shapes.append((k, [outer, hole] if k % 2 else [outer + outer[:1]]))
    points = []
    for k, rings in shapes:
        lat, lon = rings[0][0]
        points += [(lat + rng.uniform(-0.6, 0.6), turned(lon + rng.uniform(-0.9, 0.9))) for _ in range(60)]
        points += [(lat + rng.gauss(0, 0.03), turned(lon + rng.gauss(0, 0.05))) for _ in range(60)]
    df = spark.createDataFrame([(i, a, o) for i, (a, o) in enumerate(points)], "i long, lat double, lon double")
    got = {(r["i"], r["pid"]): (r["inside"], r["distance_km"]) for r in polygons.located(df, frame(spark, shapes), ["i"], 20.0, Scratch(spark, "t")).collect()}
    want = {(i, k): x for i, (a, o) in enumerate(points) for k, rings in shapes if (x := plain(a, o, rings))[0] or x[1] <= 20}
    assert set(got) == set(want) and sum(x[0] for x in want.values()) > 100
    for key, (inside, km) in want.items():
        assert got[key][0] == inside and got[key][1] == pytest.approx(km, abs=1e-6)
    only = polygons.located(df, frame(spark, shapes), ["i"], 0.0, Scratch(spark, "t"))
    assert {(r["i"], r["pid"]) for r in only.collect()} == {k for k, x in want.items() if x[0]}


def test_edges_of_the_input(spark):
    square = [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 0.0)]
    odd = spark.createDataFrame([(1, None), (2, []), (3, [None, [{"lat": None, "lon": 1.0}, None]]), (4, [[{"lat": a, "lon": o} for a, o in square[:2]]]), (5, [[{"lat": a, "lon": o} for a, o in square] + [None]])], f"pid long, {RINGS}")
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, None, 0.5), (3, 50.0, 50.0)], "i long, lat double, lon double")
    assert [(r["i"], r["pid"], r["inside"]) for r in polygons.located(points, odd, ["i"], 20.0, Scratch(spark, "t")).collect()] == [(1, 5, True)]
    assert polygons.located(points, odd.limit(0), ["i"], 20.0, Scratch(spark, "t")).collect() == []
    with pytest.raises(Exception, match="half the globe"):
        polygons.edges_of(frame(spark, [(1, [[(80.0, 0.0), (80.0, 100.0), (80.0, -160.0), (80.0, -60.0)]])])).collect()


def test_a_long_edge_and_a_crowd(spark):
    long = [(0.0, 0.0), (0.0, 9.0), (0.001, 9.0), (0.001, 0.0)]
    points = spark.createDataFrame([(k, 0.0005 + (k % 7) * 0.02, 9 * k / 50) for k in range(50)], "i long, lat double, lon double")
    got = {r["i"]: (r["inside"], r["distance_km"]) for r in polygons.located(points, frame(spark, [(1, [long])]), ["i"], 20.0, Scratch(spark, "t")).collect()}
    for r in points.collect():
        inside, km = plain(r["lat"], r["lon"], [long])
        assert got[r["i"]][1] == pytest.approx(km, abs=1e-9) and (km == 0 or got[r["i"]][0] == inside)


def test_samples_of_paths(spark):
    path = [{"lat": 37.0, "lon": -2.0}, {"lat": 37.0, "lon": -2.0}, {"lat": 37.01, "lon": -2.0}, {"lat": 37.01, "lon": -1.99}]
    paths = spark.createDataFrame([("p", path), ("one", path[:1]), ("still", path[:2]), ("line", [{"lat": 0.0, "lon": 179.999}, {"lat": 0.0, "lon": -179.999}])], "line_id string, path array<struct<lat: double, lon: double>>")
    got = {}
    for r in polygons.path_samples(paths).distinct().collect():
        got.setdefault(r["line_id"], set()).add((round(r["lat"], 7), round(r["lon"], 7)))
    assert "one" not in got and got["still"] == {(37.0, -2.0)} and got["line"] == {(0.0, 179.999), (0.0, -179.999)}
    total = 1.11195 + 0.88797
    assert len(got["p"]) == math.ceil(total / 0.5) + 1 and {(37.0, -2.0), (37.01, -1.99)} <= got["p"]


def test_threats_take_the_most_severe(spark):
    square = [[{"lat": a, "lon": o} for a, o in [(37.0, -2.0), (37.0, -1.9), (37.1, -1.9), (37.1, -2.0)]]]
    assets = spark.createDataFrame([("in", 37.05, -1.95), ("near", 37.05, -1.87), ("line", 37.3, -1.95), ("far", 39.0, -2.0), ("at", 40.0, 3.0)], "asset_id string, lat double, lon double")
    lines = spark.createDataFrame([("line", [{"lat": 37.3, "lon": -1.95}, {"lat": 37.05, "lon": -1.95}])], "asset_id string, path array<struct<lat: double, lon: double>>")
    fires = spark.createDataFrame([("f", 37.05, -1.95), ("bare", 40.0, 3.0)], "fire_id string, flat double, flon double")
    per = spark.createDataFrame([("f", square)], f"fire_id string, {RINGS}")
    spread = spark.createDataFrame([("f", 1, [[{"lat": a, "lon": o} for a, o in [(37.0, -1.88), (37.0, -1.8), (37.1, -1.8), (37.1, -1.88)]]])], f"fire_id string, step int, {RINGS}")
    got = {(r["fire_id"], r["asset_id"]): (r["ring"], r["distance_km"], r["in_corridor"]) for r in polygons.threatened(assets, lines, fires, per, spread, Scratch(spark, "t")).collect()}
    assert got == {("f", "in"): ("inside", 0.0, False), ("f", "near"): ("5km", 2.7, True), ("f", "line"): ("inside", 0.0, False), ("bare", "at"): ("inside", 0.0, False)}


def test_small_polygons_meet_whole_and_crowds_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(polygons, "CALL", (7, 2))
    rng = random.Random(8)
    shapes = [(k, [star(rng, 37 + rng.uniform(0, 0.1), 179.95 + rng.uniform(0, 0.1), 0.05, 6)]) for k in range(9)]
    points = [(37 + rng.uniform(-0.2, 0.3), turned(180 + rng.uniform(-0.2, 0.2))) for _ in range(60)]
    df, scratch = spark.createDataFrame([(i, a, o) for i, (a, o) in enumerate(points)], "i long, lat double, lon double"), Scratch(spark, "t")
    got = {(r["i"], r["pid"]): (r["inside"], r["distance_km"]) for r in polygons.located(df, frame(spark, shapes), ["i"], 9.0, scratch).collect()}
    want = {(i, k): x for i, (a, o) in enumerate(points) for k, rings in shapes if (x := plain(a, o, rings))[0] or x[1] <= 9}
    assert set(got) == set(want) and all(got[k][0] == x[0] and got[k][1] == pytest.approx(x[1], abs=1e-6) for k, x in want.items())
    assert not any(name.startswith(("near", "met")) for name in os.listdir(scratch.root.removeprefix("file://")))  # no table of candidates


def written(spark):
    """(bytes shuffled, rows shuffled) by this application so far."""
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
    stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
    stages = [stages.apply(k) for k in range(stages.size())]
    return sum(s.shuffleWriteBytes() for s in stages), sum(s.shuffleWriteRecords() for s in stages)


def test_threats_of_fires_alike_are_found_once_and_not_shuffled(spark, tmp_path):
    box = lambda a, o, d: [[{"lat": a + i, "lon": turned(o + j)} for i, j in ((-d, -d), (-d, d), (d, d), (d, -d))]]
    rng = random.Random(3)
    assets = spark.createDataFrame([(k, 37 + rng.uniform(-0.1, 0.1), turned(180 + rng.uniform(-0.1, 0.1))) for k in range(300)], "asset_id long, lat double, lon double")
    lines = spark.createDataFrame([], "asset_id long, path array<struct<lat: double, lon: double>>")
    fires = spark.createDataFrame([(k, 37.0, 179.99) for k in range(2000)], "fire_id long, flat double, flon double")
    per = spark.createDataFrame([(k, box(37.0, 179.99, 0.02)) for k in range(0, 2000, 2)], f"fire_id long, {RINGS}")
    spread = spark.createDataFrame([(k, 1, box(37.05, -179.99, 0.03)) for k in range(0, 2000, 4)], f"fire_id long, step int, {RINGS}")
    before = written(spark)[1]
    polygons.threatened(assets, lines, fires, per, spread, Scratch(spark, "t")).write.parquet(str(tmp_path / "out"))
    assert written(spark)[1] - before < 60_000  # 600,000 pairs
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == out.select("fire_id", "asset_id").distinct().count() == 600_000
    assert sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet")) < 300_000
    kinds = {}
    for r in out.filter("fire_id < 4").collect():
        kinds.setdefault(r["fire_id"], set()).add((r["asset_id"], r["ring"], r["distance_km"], r["in_corridor"]))
    assert kinds[1] == kinds[3] != kinds[0] and {r[:3] for r in kinds[0]} == {r[:3] for r in kinds[2]}
    assert {r[0] for r in kinds[0] if r[3]} == {r["asset_id"] for r in assets.collect() if abs(r["lat"] - 37.05) < 0.03 and abs(turned(r["lon"] + 179.99)) < 0.03}
    assert not any(r[3] for k in (1, 2, 3) for r in kinds[k])


def test_threats_met_whole_are_those_met_by_pair(spark, monkeypatch):
    rng = random.Random(12)
    near = lambda d: (37 + rng.uniform(-d, d), turned(180 + rng.uniform(-d, d)))
    point = lambda p: {"lat": p[0], "lon": p[1]}
    assets = spark.createDataFrame([(k, *near(0.4)) for k in range(60)] + [(61, None, 1.0), (62, 37.0, 180.0), (62, 37.3, 180.0)], "asset_id int, lat double, lon double")
    paths = [(k, [point(near(0.03)) for _ in range(3)]) for k in range(50, 90)] + [(k, [point(near(0.5)) for _ in range(3)]) for k in range(55, 100, 9)]
    lines = spark.createDataFrame(paths, "asset_id int, path array<struct<lat: double, lon: double>>")
    fires = spark.createDataFrame([(f"f{k % 29}", *near(0.3)) for k in range(30)] + [("no", None, 1.0)], "fire_id string, flat double, flon double")
    ring = lambda d, n: [point(p) for p in star(rng, *near(0.3), d, n)]
    per = spark.createDataFrame([(f"f{k}", [ring(0.1, 100 if k == 3 else 7), ring(0.02, 5)]) for k in range(10)] + [("f10", None), ("x", [ring(0.1, 4)])], f"fire_id string, {RINGS}")
    spread = spark.createDataFrame([(f"f{k}", s, [ring(0.2, 90 if k > 25 else 6)]) for k in range(0, 29, 2) for s in (1, 2, 3)], f"fire_id string, step int, {RINGS}")
    found = lambda: sorted(map(tuple, polygons.threatened(assets, lines, fires, per, spread, Scratch(spark, "t")).collect()))
    monkeypatch.setattr(polygons, "THREAT_CALL", (50, 3))
    monkeypatch.setattr(polygons, "TURN", 5)
    whole = found()
    monkeypatch.setattr(polygons, "MOST_SAMPLES", 0)  # every asset is too long
    assert whole == found() and len(whole) > 800 and {r[4] for r in whole} == {True, False} and len({r[2] for r in whole}) == 4
