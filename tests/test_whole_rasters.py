"""Rasters in tiles against whole arrays, shapes against samples of their edges, distances against all active cells."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberglass.functions import geo
from emberglass.operators import rasters

SIDE, NORTH, WEST, SIZE = 4, 40.0, -3.0, 0.01


def raster(rng, rows, cols, holes=0.1):
    return {(r, c): rng.uniform(0, 900) for r in range(rows) for c in range(cols) if rng.random() > holes}


def cells_of(spark, known):
    return spark.createDataFrame([(r, c, v) for (r, c), v in known.items()], "row long, col long, value double")


def plain_slope(known, r, c):
    if (r, c) not in known:
        return None

    def rise(a, b, metres):
        ends = [known.get(a, known[r, c]), known.get(b, known[r, c])]
        n = (a in known) + (b in known)
        return (ends[1] - ends[0]) / (n * metres) if n else None

    p = math.radians(NORTH - (r + 0.5) * SIZE)
    of_lat = 111132.92 - 559.82 * math.cos(2 * p) + 1.175 * math.cos(4 * p) - 0.0023 * math.cos(6 * p)
    of_lon = 111412.84 * math.cos(p) - 93.5 * math.cos(3 * p) + 0.118 * math.cos(5 * p)
    e, s = rise((r, c - 1), (r, c + 1), of_lon * SIZE), rise((r - 1, c), (r + 1, c), of_lat * SIZE)
    if e is None or s is None:
        return None
    return math.degrees(math.atan(math.hypot(e, s))), math.degrees(math.atan2(-e, s)) % 360


def test_slopes_across_tiles_equal_the_whole_raster(spark):
    known = raster(random.Random(1), 11, 14)
    tiles = rasters.tiled(cells_of(spark, known), SIDE)
    assert {(r["row"], r["col"]): r["value"] for r in rasters.cells(tiles, SIDE).collect() if r["value"] is not None} == known
    got = {(r["row"], r["col"]): (r["slope"], r["aspect"]) for r in rasters.cells(rasters.slopes(tiles, SIDE, NORTH, SIZE), SIDE, "slope", "aspect").collect()}
    for r in range(11):
        for c in range(14):
            want = plain_slope(known, r, c)
            assert got.get((r, c), (None, None)) == (pytest.approx(want) if want else (None, None))


def test_samples_and_mosaic(spark):
    rng = random.Random(2)
    layers = [raster(rng, 9, 9, 0.6) for _ in range(3)]
    stacked = [rasters.tiled(cells_of(spark, k), SIDE).withColumn("layer", F.lit(i)) for i, k in enumerate(layers)]
    whole = rasters.mosaic(stacked[2].unionByName(stacked[0]).unionByName(stacked[1]))
    known = layers[2] | layers[1] | layers[0]
    assert {(r["row"], r["col"]): r["value"] for r in rasters.cells(whole, SIDE).collect() if r["value"] is not None} == known
    points = [(i, NORTH - rng.uniform(-0.02, 0.12), WEST + rng.uniform(-0.02, 0.12)) for i in range(200)]
    got = rasters.sampled(spark.createDataFrame(points, "i long, lat double, lon double"), whole, SIDE, NORTH, WEST, SIZE)
    assert got.columns == ["i", "lat", "lon", "value"]
    assert {r["i"]: r["value"] for r in got.collect()} == {i: known.get((math.floor((NORTH - a) / SIZE), math.floor((o - WEST) / SIZE))) for i, a, o in points}
    assert rasters.sampled(spark.createDataFrame(points, "i long, lat double, lon double"), whole.limit(0), SIDE, NORTH, WEST, SIZE).filter("value is not null").count() == 0


def drawn(ring, size):
    """Centres inside, by crossings to the right; and a test of whether an edge meets a closed cell."""
    pts = [(a / size, o / size) for a, o in ring]
    edges = list(zip(pts, pts[1:] + pts[:1]))

    def inside(y, x):
        hit = False
        for (y1, x1), (y2, x2) in edges:
            if (y1 > y) != (y2 > y) and x < x1 + (x2 - x1) * (y - y1) / (y2 - y1):
                hit = not hit
        return hit

    def meets(r, c):
        for (y1, x1), (y2, x2) in edges:
            t0, t1 = 0.0, 1.0
            for a, d, low in ((y1, y2 - y1, r), (x1, x2 - x1, c)):
                if d == 0:
                    if not low - 1e-9 <= a <= low + 1 + 1e-9:
                        t0, t1 = 1.0, 0.0
                else:
                    u, v = sorted(((low - a) / d, (low + 1 - a) / d))
                    t0, t1 = max(t0, u - 1e-9), min(t1, v + 1e-9)
            if t0 <= t1:
                return True
        return False

    return edges, inside, meets


@pytest.mark.parametrize("seed", range(4))
def test_all_touched_and_filled(spark, seed):
    rng, size = random.Random(seed), 0.1
    ring = [(rng.uniform(-1.5, 1.5), rng.uniform(-1.5, 1.5)) for _ in range(rng.choice([3, 5, 9]))]
    if seed == 3:
        ring = [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 0.0)]  # edges on the borders of cells
    df = spark.createDataFrame([("a", [{"lat": a, "lon": o} for a, o in ring])], "id string, ring array<struct<lat: double, lon: double>>")
    edges, inside, meets = drawn(ring, size)
    centre = {(r, c) for r in range(-20, 21) for c in range(-20, 21) if inside(r + 0.5, c + 0.5)}
    got = {(r["row"], r["col"]) for r in rasters.rasterised(df, size, all_touched=False).collect()}
    assert got == centre
    rows = [(r["row"], r["col"]) for r in rasters.rasterised(df, size).collect()]
    assert len(rows) == len(set(rows)) and centre <= set(rows)
    for (y1, x1), (y2, x2) in edges:
        for k in range(2001):
            t = k / 2000
            y, x = y1 + (y2 - y1) * t, x1 + (x2 - x1) * t
            if min(abs(y - round(y)), abs(x - round(x))) > 1e-6:
                assert (math.floor(y), math.floor(x)) in set(rows)
    assert all(meets(r, c) for r, c in set(rows) - centre)


def test_holes_parts_and_odd_rings(spark):
    at = lambda low, high: [{"lat": a, "lon": o} for a, o in [(low, low), (low, high), (high, high), (high, low)]]
    rows = [(1, at(0.0, 9.0)), (1, at(3.0, 6.0)), (2, at(1.2, 1.3)), (3, []), (3, None), (4, [{"lat": 2.5, "lon": 2.5}])]
    df = spark.createDataFrame(rows, "id long, ring array<struct<lat: double, lon: double>>")
    got = {}
    for r in rasters.rasterised(df, 1.0, all_touched=False).collect():
        got.setdefault(r["id"], set()).add((r["row"], r["col"]))
    assert got == {1: {(r, c) for r in range(9) for c in range(9) if not (3 <= r < 6 and 3 <= c < 6)}}
    assert {(r["id"], r["row"], r["col"]) for r in rasters.rasterised(df.filter("id > 1"), 1.0).collect()} == {(2, 1, 1), (4, 2, 2)}


def test_distances_equal_all_pairs(spark):
    rng = random.Random(6)
    rows = [(g, rng.randrange(-5, 25), rng.randrange(-9, 40), rng.random() < share) for g, share in (("a", 0.05), ("b", 0.5), ("none", 0.0), ("all", 1.0)) for _ in range(150)]
    rows += [(None, 1, 1, True), (None, 4, 5, False), ("a", None, 1, True)]
    df = spark.createDataFrame(rows, "k string, row int, col int, active boolean")
    for r in rasters.distances(df, "k").collect():
        near = [math.hypot(r["row"] - a, r["col"] - b) for g, a, b, on in rows if g == r["k"] and on and a is not None]
        assert (r["distance"] is None and not near and r["k"] == "none") or (r["k"] is None) or r["distance"] == min(near)
    assert rasters.distances(df, "k").count() == len(rows) - 1


def test_envelope():
    rng = random.Random(9)
    for _ in range(200):
        at = sorted(rng.sample(range(-50, 50), rng.randrange(1, 12)))
        height = [rng.randrange(0, 900) for _ in at]
        cols = list(range(-60, 61))
        assert rasters.envelope(at, height, cols).tolist() == [min((c - a) ** 2 + h for a, h in zip(at, height)) for c in cols]


def test_geostationary_round_trip(spark):
    places = [(a, o) for a in range(-70, 71, 7) for o in range(-70, 71, 7)]
    df = spark.createDataFrame([(float(a), float(o)) for a, o in places], "lat double, lon double")
    x, y = geo.geos_forward(F.col("lat"), F.col("lon"))
    df = df.select("lat", "lon", x.alias("x"), y.alias("y"))
    lat, lon = geo.geos_inverse(F.col("x"), F.col("y"))
    for r in df.select("*", lat.alias("a"), lon.alias("o")).collect():
        if r["x"] is not None:
            assert abs(r["a"] - r["lat"]) < 1e-9 and abs(r["o"] - r["lon"]) < 1e-9
        else:
            assert math.cos(math.radians(r["lat"])) * math.cos(math.radians(r["lon"])) < 0.16
    cells = spark.createDataFrame([(5567.5, 5567.5), (0.0, 0.0), (1000.0, 5567.5), (5567.5, 99999.0)], "r double, c double")
    lat, lon = geo.geos_cell(F.col("r"), F.col("c"))
    got = cells.select(lat.alias("a"), lon.alias("o")).collect()
    assert tuple(got[0]) == (0.0, 0.0) and tuple(got[1]) == (None, None) == tuple(got[3]) and 45 < got[2]["a"] < 60 and np.isclose(got[2]["o"], 0)
    far = spark.createDataFrame([(0.0, 179.0), (0.0, -100.0)], "lat double, lon double").select(*geo.geos_forward(F.col("lat"), F.col("lon")))
    assert [tuple(r) for r in far.collect()] == [(None, None)] * 2
