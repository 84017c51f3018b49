"""The reach answer on a small survey, and what it refuses to say."""

import pytest

from emberglass.operators.coverage import reach_answer
from emberglass.storage import Scratch

CELLS = "ord long, mcc int, mnc int, lac int, cellid int, lat double, lon double, range_m double"
REGION = {"south": 36.0, "west": -3.0, "north": 38.0, "east": -1.0}


def test_reach_answer(spark):
    cells = spark.createDataFrame([(0, 214, 1, 2, 3, 37.0, -2.0, 5000.0), (1, 214, 1, 2, 4, 37.0, -2.0, 1000.0), (2, 214, 1, 2, 5, None, -2.0, 1000.0), (3, None, None, None, None, 37.0, -2.0, 0.0)], CELLS)
    places = spark.createDataFrame([("near", 37.0, -2.001, 100), ("mid", 37.03, -2.0, None), ("hit", 37.0, -2.0, 70), ("far", 38.0, -2.0, 5), ("lost", None, -2.0, 9), ("nowhere", 37.0, float("nan"), 9)], "sid string, lat double, lon double, population long")
    threat = spark.createDataFrame([("hit",), ("hit",)], "sid string")
    got = reach_answer(cells, places, threat, REGION, Scratch(spark, "t"))
    assert {tuple(r) for r in got["rows"].collect()} == {("near", 100, 2, 1, False, 100), ("mid", None, 1, 1, False, None), ("hit", 70, 2, 1, True, 0), ("far", 5, 0, 0, False, 0)}
    assert {r["id"]: r["reason"] for r in got["unusable"].collect()} == {"214-1-2-5": "position is missing", "?-?-?-?#3": "range is not a positive number"}
    assert {tuple(r) for r in got["unusable_settlements"].collect()} == {("lost", "position is missing"), ("nowhere", "position is no place")}
    assert [r["sid"] for r in got["unknown_population"].collect()] == ["mid"]
    s = got["summary"].first()
    assert (s["cells"], s["over_alerted"], s["measured_fraction"]) == (2, 100, 0.5) and "36.000,-3.000" in s["scope"]
    for c, p, t, fault in ((cells, places.limit(0), threat, "no settlements"), (cells, places.union(places.limit(1)), threat, "more than once"), (cells, places, spark.createDataFrame([("x",)], "sid string"), "not among"), (cells.filter("ord > 1"), places, threat, "no cell")):
        with pytest.raises(ValueError, match=fault):
            reach_answer(c, p, t, REGION, Scratch(spark, "t"))
