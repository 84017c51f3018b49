"""Readers of single files: whole, empty, missing and broken ones."""

import hashlib
import json
import os

import pytest

from emberglass.functions import geo
from emberglass.sources import fixtures
from pyspark.sql import functions as F


def put(folder, name, value):
    (folder / name).write_text(value if isinstance(value, str) else json.dumps(value))
    return str(folder / name)


def test_static_heat_takes_outer_rings(spark, tmp_path):
    box = [[0.0, 1.0], [0.0, 2.0], [1.0, 2.0], [0.0, 1.0]]
    shapes = [("Polygon", [box, box[:3]]), ("MultiPolygon", [[box[:3]], [box]]), ("Polygon", [box[:2]]), ("Polygon", [[[0.0], *box]])]
    path = put(tmp_path, "heat.json", {"features": [{"geometry": {"type": t, "coordinates": c}} for t, c in shapes] + [{"geometry": None}]})
    got = {r["ring_id"]: [tuple(p) for p in r["ring"]] for r in fixtures.static_heat(spark, path).collect()}
    assert {k: len(v) for k, v in got.items()} == {0: 4, 1: 3, 3: 4} and got[0][0] == (1.0, 0.0)
    with pytest.warns(UserWarning, match="no file"):
        assert fixtures.static_heat(spark, str(tmp_path / "none.json")).count() == 0


def test_settlements_are_closed_and_in_degrees(spark, tmp_path):
    e, n = spark.range(1).select(*geo.utm30_forward(F.lit(37.0), F.lit(-2.0))).first()
    hull = [[e, n], [e + 100, n], [e, n + 100]]
    rows = [{"id": "a", "name": "A", "buildings": 1, "population": None, "centreUtm30n": [e, n], "hullUtm30n": hull}, {"id": "b", "centreUtm30n": [e, n], "hullUtm30n": hull[:2]}]
    rows.append({**rows[0], "buildings": 7, "hullUtm30n": [*hull, hull[0]]})
    got = fixtures.settlements(spark, put(tmp_path, "s.json", {"settlements": rows})).collect()
    assert [(r["sid"], r["buildings"], r["population"], len(r["outline"])) for r in got] == [("a", 7, None, 4)]
    assert got[0]["outline"][0] == got[0]["outline"][-1] and abs(got[0]["lat"] - 37) < 1e-7 and abs(got[0]["lon"] + 2) < 1e-7


SURVEY = {"source": "s", "endpoint": "e", "fetchedAt": "t", "region": {"south": 1.0, "west": 2.0, "north": 3.0, "east": 4.0}, "maxAreaM2": 5.0, "tilesRequested": 6, "tilesFailed": 0, "measuredRangeCells": 1, "failures": [], "cells": [{"mcc": 214, "lat": 1.0, "lon": 2.0, "range": 900}]}


@pytest.mark.parametrize("field, value", [("source", " "), ("endpoint", None), ("tilesFailed", 1.5), ("tilesRequested", -1), ("maxAreaM2", 0), ("region", None), ("region", {"south": 1.0}), ("failures", None), ("cells", []), ("cells", None)])
def test_a_survey_that_lacks_something_is_refused(spark, tmp_path, field, value):
    with pytest.raises(ValueError, match=field):
        fixtures.cell_survey(spark, put(tmp_path, "c.json", {**SURVEY, field: value}))


def test_a_whole_survey(spark, tmp_path):
    cells, head = fixtures.cell_survey(spark, put(tmp_path, "c.json", SURVEY))
    assert [(r["ord"], r["mcc"], r["mnc"], r["range_m"]) for r in cells.collect()] == [(0, 214, None, 900.0)]
    assert (head.first()["tilesRequested"], head.first()["region"]["east"]) == (6, 4.0)
    with pytest.raises(ValueError, match="no survey"):
        fixtures.cell_survey(spark, str(tmp_path / "none.json"))


def test_scores_of_primary_rows(spark, tmp_path):
    fit = {"r2": 0.5, "median_r2_per_fire": 0.4, "median_mape": 0.3}
    row = {"corpus": "a", "fires": 9, "rate_basis": "centroid_drift", "primary": True, "mean_rate_kmh": 3.0, "burned_area": {"persistence": fit, "constant_ros": {"computed": False}}, "bearing_rate": {"rate_fires": 8, "direction_fires": 7, "persistence": {"rate_r2": 0.2, "rate_median_mape": None, "median_bearing_error_deg": 40.0}}}
    model = {"computed": True, "fires": 5, "rate": {"model": {"r2": 0.6, "median_mape": 0.1}}, "bearing": {"model_median_error_deg": 30.0}}
    rows = [row, {**row, "corpus": "b", "rate_basis": "frontal", "mean_rate_kmh": 2.0, "model": model}, {**row, "primary": False}]
    scores, rate = fixtures.harness_scores(spark, put(tmp_path, "m.json", {"rows": rows}))
    got = sorted((r["corpus"], r["name"], r["target"], r["r2"], r["events"]) for r in scores.collect())
    per = [("persistence", "bearing_rate", 0.2, 8.0), ("persistence", "burned_area", 0.5, 9.0)]
    assert got == sorted([(c, *p) for c in "ab" for p in per] + [("b", "model", "bearing_rate", 0.6, 5.0)]) and rate.first()[0] == 2.0
    with pytest.raises(Exception, match="harness"):
        fixtures.harness_scores(spark, put(tmp_path, "x.json", {"rows": [{**row, "rate_basis": "other"}]}))[0].collect()
    with pytest.warns(UserWarning, match="no scores"):
        scores, rate = fixtures.harness_scores(spark, str(tmp_path / "none.json"))
    assert scores.count() == 0 and rate.first()[0] is None


def test_snapshots_by_name_prefix_and_time(spark, tmp_path):
    assert fixtures.snapshot_name(spark, str(tmp_path)) is None and fixtures.snapshot_name(spark, str(tmp_path / "none")) is None
    for k, name in enumerate(["b-1.json", "b-2.json", "a.json", "c.txt"]):
        os.utime(put(tmp_path, name, "{}"), (1000 + k, 1000 + k))
    assert [fixtures.snapshot_name(spark, str(tmp_path), w) for w in ("", "a.json", "b")] == ["a.json", "a.json", "b-2.json"]
    with pytest.raises(ValueError, match="called d"):
        fixtures.snapshot_name(spark, str(tmp_path), "d")


def test_forecasts_are_those_of_the_index(spark, tmp_path):
    body = json.dumps({"eventId": "e", "issuedAt": "1970-01-01T01:00:00Z"})
    name = f"{'a' * 64}.json"
    put(tmp_path, name, body)
    entry = {"eventId": "e", "issuedAt": "1970-01-01T01:00:00Z", "file": name, "sha256": hashlib.sha256(body.encode()).hexdigest()}
    put(tmp_path, "index.json", {"schema": fixtures.INDEX_SCHEMA, "entries": [entry]})
    assert [tuple(r) for r in fixtures.forecasts(spark, str(tmp_path)).collect()] == [("e", 3600, body)]
    put(tmp_path, "index.json", {"schema": fixtures.INDEX_SCHEMA, "entries": [{**entry, "sha256": "0" * 64}]})
    with pytest.raises(Exception, match="checksum"):
        fixtures.forecasts(spark, str(tmp_path)).collect()
    put(tmp_path, "index.json", {"schema": "other", "entries": [entry]})
    with pytest.raises(Exception, match="invalid forecast index"):
        fixtures.forecasts(spark, str(tmp_path)).collect()
