"""Readers and writers of files on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from emberglass.sources import files


def collection(path, features, kind="FeatureCollection"):
    path.write_text(json.dumps({"type": kind, "features": features}))
    return str(path)


def feature(i, kind, coordinates, **props):
    return {"id": i, "type": "Feature", "geometry": {"type": kind, "coordinates": coordinates} if kind else None, "properties": props}


def test_infrastructure_counts_what_it_cannot_place(spark, tmp_path):
    layer = files.features(spark, collection(tmp_path / "a.json", [feature("1", "Point", [1.0, 2.0], name="A"), feature("2", "LineString", [[0.0, 0.0], [1.0, 1.0], [2.0, 2.0]], voltageKv="132"), feature("3", None, None)]))
    assets, status = files.infrastructure({"lines": layer, "hospitals": None})
    assert {r["asset_id"]: tuple(r["position"]) for r in assets.collect()} == {"1": (2.0, 1.0), "2": (1.0, 1.0)}
    assert sorted(map(tuple, status.collect())) == [("hospitals", 0, 0, "unavailable"), ("lines", 2, 1, "partial")]
    with pytest.raises(Exception, match="FeatureCollection"):
        files.features(spark, collection(tmp_path / "b.json", [], "Nothing")).collect()


def test_capture_drops_unzoned_times(spark, tmp_path):
    raw = files.features(spark, collection(tmp_path / "a.json", [feature("1", "Point", [1.0, 2.0], observed_at="1970-01-01T00:01:00Z"), feature("2", "Point", [1.0, 2.0], observed_at="1970-01-01T00:01:00")]))
    assert [(r["id"], r["at_s"]) for r in files.capture(raw, 10).collect()] == [("1", 50)]


def test_road_graph_names_what_it_rejects(spark):
    edges = spark.createDataFrame([(1, 1, 2, 10.0, 0, True), (2, 1, 9, 10.0, 0, False), (3, 1, 2, 0.0, 0, False), (4, 1, 2, 5.0, 7, False)], "edge int, src int, dst int, travel_s double, geometry_ix int, reversed boolean")
    good, bad = files.road_graph(edges, spark.createDataFrame([(0, [1, 2, 3])], "geometry_ix int, path array<int>"), spark.createDataFrame([(1,), (2,)], "node int"))
    assert [(r["edge"], r["path"]) for r in good.collect()] == [(1, [3, 2, 1])]
    assert dict(map(tuple, bad.collect())) == {2: "unknown node", 3: "no travel time", 4: "no geometry"}


def test_ways_are_cut_where_they_meet(spark):
    ways = spark.createDataFrame([(1, [1, 2, 3], 0), (2, [2, 4], 1), (2, [2, 4], 1)], "way int, refs array<int>, one_way int")
    assert {(r["way"], r["src"], r["dst"]) for r in files.split_ways(ways).collect()} == {(1, 1, 2), (1, 2, 1), (1, 2, 3), (1, 3, 2), (2, 2, 4)}


def test_missing_scans_are_unknown_not_clear(spark):
    flags = spark.createDataFrame([(1, 1, 0, 1, 9000), (1, 1, 600, 0, 10)], "row int, col int, scan_s long, flag int, created_s long")
    got = files.quality_calendar(flags, spark.createDataFrame([(1, 1)], "row int, col int"), 0, 1800).orderBy("scan_s").collect()
    assert [(r["flag"], r["available_s"]) for r in got] == [(1, 9000), (0, 3300), (255, 3900)]


def test_weather_must_have_been_known(spark):
    weather = spark.createDataFrame([("a", 3600, 2.0, 90.0)], "loc string, hour_s long, speed double, direction double")
    of = lambda issue, valid: files.weather_at(spark.createDataFrame([(issue, valid, "a")], "issue_s long, valid_s long, loc string"), weather)
    assert of(3600, 4000).first()["wind_east"] == pytest.approx(-2.0)
    for bad in (of(3600, 9000), of(-90000, 4000)):
        with pytest.raises(Exception, match="not there"):
            bad.collect()


def test_forecast_faults(spark):
    ok = [[0.1] * 4, [0.2] * 4, [0.2] * 4]
    rows = [("ok", 2, 2, ok), ("falling", 2, 2, ok[::-1]), ("range", 2, 2, [[0.1] * 4, [2.0] * 4, [3.0] * 4]), ("short", 2, 2, ok[:2]), ("grid", 3, 2, ok)]
    got = dict(map(tuple, files.forecast_faults(spark.createDataFrame(rows, "id string, rows int, cols int, horizons array<array<double>>"), 2).collect()))
    assert got == {"ok": [], "falling": ["monotone"], "range": ["range"], "short": ["horizons"], "grid": ["grid"]}


def test_ledger_counts_torn_lines(spark, tmp_path):
    (tmp_path / "l.json").write_text('{"seq":1,"cursor_s":2,"fingerprint":"f","pocket":"p"}\n{"seq":"x"}\n{"seq":3,"cur')
    entries, bad = files.read_ledger(spark, str(tmp_path / "l.json"))
    assert entries.count() == 1 and bad.first()[0] == 2


def test_scans(spark, tmp_path):
    head = "ACQTIME,ABS_LINE,ABS_SAMP,LONGITUDE,LATITUDE,FRP,FRP_UNCERTAINTY,FIRE_CONFIDENCE,PIXEL_SIZE\n"
    (tmp_path / "s_20240101000000.csv").write_text(head + "20240101000500,1,2,-2.0,37.0,-1,,1,2\n20240101000500,1,3,-2.0,37.0,5.5,,1,2\n20240101000500,1,4,9.0,37.0,5.5,,1,2\n")
    got = files.scans(spark, str(tmp_path), (-3.0, 36.0, -1.0, 38.0)).orderBy("col").collect()
    assert [(r["col"], r["frp"]) for r in got] == [(2, None), (3, 5.5)]
    (tmp_path / "s_20240101010000.csv").write_text(head + "20240101000500,1,2,-2.0,37.0,1,,1,2\n")
    with pytest.raises(Exception, match="outside its scan"):
        files.scans(spark, str(tmp_path), (-3.0, 36.0, -1.0, 38.0)).collect()


def test_output_never_mixes(spark, tmp_path):
    df = files.digest(spark.createDataFrame([(1, "a")], "b int, a string"))
    files.write_new(df, str(tmp_path / "o"))
    with pytest.raises(Exception, match="EXISTS|exists"):
        files.write_new(df, str(tmp_path / "o"))
    assert df.first()["sha256"] == spark.range(1).select(F.sha2(F.lit('{"a":"a","b":1}'), 256)).first()[0]
