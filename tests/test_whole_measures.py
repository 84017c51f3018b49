"""Measures, motion and input bins on small cases: empty tables, nulls, ties, repeated rows."""

import math

import numpy as np
import pytest

from emberglass.functions import geo
from emberglass.operators import causal, growth, issues, scoring, spatial
from pyspark.sql import functions as F

SCAN = "cell long, scan_s long, available_s long, flag int, frp double, n_frp int"


def test_motion_needs_three_dated_states_and_short_gaps(spark):
    rows = [(1, 0.0, 1, 37.0, -3.0), (1, 2.0, 2, 38.0, -3.0), (1, 2.0, 3, 38.0, -3.0), (1, 99.0, 4, 39.0, -3.0), (2, 0.0, 1, 37.0, -3.0), (2, 1.0, 2, 37.0, -3.0), (2, None, 3, 37.0, -3.0)]
    df = spark.createDataFrame(rows, "fire long, t double, ord long, lat double, lon double")
    got = {r["ord"]: (r["bearing"], r["rate_kmh"]) for r in growth.motion(df, 10.0).collect()}
    assert sorted(got) == [1, 2, 3, 4]  # the second fire has two dated states only
    assert got[1] == got[3] == got[4] == (None, None)
    assert got[2][0] == 0.0 and math.isclose(got[2][1], 6371.0088 * math.radians(1) / 2)
    assert growth.motion(df.limit(0), 10.0).count() == 0


def test_input_bins_use_what_was_available(spark):
    issue, t = 36000, 36000 - 1800
    rows = [
        (1, t, issue, 1, 6.0, 1),  # the newest bin, available just in time
        (1, t + 600, issue + 1, 1, 9.0, 1),  # too late
        (1, t + 1200, issue, 255, None, 0),  # can't be seen: keeps the state
        (1, issue - 10800, issue, 0, None, 0),  # first scan of the oldest bin
        (1, issue, issue, 1, 5.0, 1),  # not before the issue
        (2, t, None, 2, 5.0, 1),  # never available
    ]
    at = spark.createDataFrame([(issue,)], "issue_s long")
    scans = spark.createDataFrame(rows, SCAN)
    got = {r["cell"]: r for r in issues.input_bins(scans, at).collect()}
    one, two = got[1], got[2]
    assert math.isclose(one["fire_5"], 1 / 3) and math.isclose(one["observable_5"], 1 / 3) and math.isclose(one["measured_5"], 1 / 3)
    assert math.isclose(one["frp_5"], math.log1p(2) / 5) and one["recent_fire"] == 1.0
    assert one["fire_0"] == 0 and math.isclose(one["observable_0"], 1 / 3)
    assert all(two[c] == 0 for c in two.asDict() if c not in ("cell", "issue_s"))
    assert issues.input_bins(scans.limit(0), at).count() == issues.input_bins(scans, at.limit(0)).count() == 0


def test_signed_area_keeps_its_digits_far_from_the_origin(spark):
    of = lambda lat, lon, d: F.array(*[F.struct(F.lit(lat + a).alias("lat"), F.lit(lon + b).alias("lon")) for a, b in ((0, 0), (0, d), (d, d), (d, 0), (0, 0))])
    r = spark.range(1).select(geo.signed_area_m2(of(40.0, 128.0, 2.0**-17)).alias("a"), geo.signed_area_m2(F.reverse(of(40.0, 128.0, 2.0**-17))).alias("b")).first()
    y, x = (spark.range(1).select(c).first()[0] for c in geo.metres_per_degree(F.lit(40.0)))
    assert math.isclose(r["a"], x * y * 4.0**-17, rel_tol=1e-9) and r["a"] > 0 > r["b"]


def test_median_r2_leaves_out_the_unknown(spark):
    rows = [(1, 0.5), (2, None), (3, float("nan")), (4, float("-inf")), (5, 0.7)]
    df = spark.createDataFrame(rows, "fire long, r2 double")
    assert tuple(scoring.median_r2(df).first()) == (2, 0.6)
    assert tuple(scoring.median_r2(df.limit(0)).first()) == (0, None)


def test_patches_hold_what_brute_force_finds(spark):
    events = [(k, k * 41 % 150 - 20, k * 67 % 130 - 20) for k in range(20)]
    seen = [(k, k * 31 % 180 - 50, k * 17 % 170 - 50) for k in range(300)]
    e, o = spark.createDataFrame(events, "event_id long, seed_row long, seed_col long"), spark.createDataFrame(seen, "id long, row long, col long")
    want = sorted((i, k) for i, r, c in events for k, y, x in seen if r - 32 <= y < r + 32 and c - 32 <= x < c + 32)
    assert sorted(map(tuple, spatial.local_observations(e, o).collect())) == want and want
    assert spatial.local_observations(e.limit(0), o).count() == spatial.local_observations(e, o.limit(0)).count() == 0


def test_a_cell_in_two_components_is_an_error(spark):
    pixels = spark.createDataFrame([(0, 0), (0, 1), (0, 0), (None, 0)], "row long, col long")
    once = spark.createDataFrame([(0, 0, 5)], "row long, col long, component long")
    got = [r["component"] for r in spatial.components_of_pixels(pixels, once).collect()]
    assert sorted(got, key=str) == [5, 5, None, None]
    with pytest.raises(Exception, match="more than one component"):
        spatial.components_of_pixels(pixels, once.union(once)).collect()


def test_summary_of_one_fire_and_of_none(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0, 1.0, None), (1, 2.0, 4.0, 3.0, None)], "fire long, area double, area1 double, dt double, others double")
    r = scoring.corpus_summary(df).first()
    assert (r["fires"], r["pairs"], r["dt_median"], r["r2_persistence"], r["r2_constant"]) == (1, 2, 2.0, 1 - 5 / 2, None)
    assert tuple(scoring.corpus_summary(df.limit(0)).first()) == (0, 0, None, None, None, None, None)


def test_the_first_box_that_holds_a_place(spark):
    boxes = {"a": (0.0, 0.0, 2.0, 2.0), "b": (1.0, 1.0, 3.0, 3.0)}
    df = spark.createDataFrame([(1.5, 1.5), (2.5, 3.0), (9.0, 9.0), (None, 1.0)], "lat double, lon double")
    assert [r[0] for r in df.select(spatial.coverage_at(F.col("lat"), F.col("lon"), boxes)).collect()] == ["a", "b", None, None]
    assert [r[0] for r in df.select(spatial.coverage_at(F.col("lat"), F.col("lon"), {})).collect()] == [None] * 4


def test_the_fit_of_a_calibration_is_the_least_of_its_loss(spark):
    rng = np.random.default_rng(3)
    p = np.clip(rng.random(600), 0, 1)
    y, w = (rng.random(600) < 1 / (1 + np.exp(-(0.7 * np.log((p + 1e-3) / (1.001 - p)) - 0.4)))).astype(int), rng.integers(1, 4, 600)
    rows = [(int(a), float(b), float(c)) for a, b, c in zip(y, p, w)] + [(None, 0.5, 1.0), (1, None, 1.0), (0, 0.5, None)]
    df = spark.createDataFrame(rows, "y int, p double, w double").cache()
    slope, intercept = scoring.fit_calibrator(df, "y", "p", "w")
    z = np.log(np.clip(p, 1e-6, 1 - 1e-6) / (1 - np.clip(p, 1e-6, 1 - 1e-6)))
    loss = lambda a, b: float((w * (np.logaddexp(0, a * z + b) - y * (a * z + b))).sum() + 0.5e-3 * a * a)
    best = loss(slope, intercept)
    assert all(loss(slope + i * 1e-3, intercept + j * 1e-3) > best for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j)
    assert [r[0] is None for r in df.filter("p is null").select(scoring.calibrated(F.col("p"), 1.0, 0.0)).collect()] == [True]
    with pytest.raises(ValueError, match="lack a class"):
        scoring.fit_calibrator(df.filter("y = 1"), "y", "p")
    with pytest.raises(ValueError, match="not above 0"):
        scoring.fit_calibrator(df.withColumn("y", 1 - F.col("y")), "y", "p")
    df.unpersist()


def test_tiles_keep_within_the_area_at_any_latitude(spark):
    rows = [(1, 36.0, -3.0, 36.1, -2.9), (2, 70.0, 10.0, 70.05, 10.4), (3, 1.0, 1.0, 1.0, 1.0), (4, None, 1.0, 1.0, 1.0)]
    t = spatial.survey_tiles(spark.createDataFrame(rows, "id long, south double, west double, north double, east double")).collect()
    assert {r["id"] for r in t} == {1, 2, 3} and all(r["area_m2"] <= 4e6 * 1.01 for r in t) and sum(r["id"] == 3 for r in t) == 1
    for k, s, w, n, e in rows[:2]:
        mine = [r for r in t if r["id"] == k]
        assert min(r["south"] for r in mine) == s and math.isclose(max(r["north"] for r in mine), n) and math.isclose(max(r["east"] for r in mine), e)
        assert math.isclose(sum((r["north"] - r["south"]) * (r["east"] - r["west"]) for r in mine), (n - s) * (e - w))


def test_origin_of_a_window_or_of_the_first_detection(spark):
    det = spark.createDataFrame([(5,), (3,), (None,)], "at_s long")
    assert [causal.timeline_origin(d, s).first()[0] for d, s in ((det, 9), (det, None), (det.limit(0), None))] == [9, 3, None]
