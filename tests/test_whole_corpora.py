"""Readers of corpora on small exports, and the projection's round trip."""

import gzip

import pytest
from pyspark.sql import functions as F

from emberglass.sources import corpora
from emberglass.storage import Scratch


def test_rows_without_a_time_are_counted(spark, tmp_path):
    text = "observed_at_utc,LONGITUDE,LONGITUDE_PARALLAX,LATITUDE_PARALLAX,PIXEL_SIZE,NOTE\n1970-01-01T00:01:00Z,9,-2.5,37.5,4.5,a\n1970-01-01 00:02:00,9,-2,x,1,b\nNaT,9,1,1,1,c\n,9,1,1,1,d\n"
    with gzip.open(tmp_path / "h.csv.gz", "wt") as f:
        f.write(text)
    rows, dropped = corpora.legacy_hotspots(spark, str(tmp_path / "h.csv.gz"))
    assert sorted((r["at_s"], r["lat"], r["lon"], r["pixel_km2"], r["NOTE"]) for r in rows.collect()) == [(60, 37.5, -2.5, 4.5, "a"), (120, None, -2.0, 1.0, "b")]
    assert dropped.first()["dropped"] == 2


def test_progression(spark):
    rows = [("f", "p", 10.5, 30.0, 400.0, 0.0), ("f", "p", 10.0, 20.0, 90.0, 500.0), ("f", "p", 12.0, 1.0, -1.0, -5.0), ("f", "z", 11.0, 99.0, 1.0, 1.0), ("f", "p", 0.0, 99.0, 1.0, 1.0), ("f", "p", 13.0, None, 1.0, 1.0), ("two", "p", 1.0, 1.0, 1.0, 1.0), ("two", "p", 2.0, 1.0, 1.0, 1.0)]
    got = corpora.progression(spark.createDataFrame(rows, "fname string, type string, enddoy double, area double, spdir_p double, ros_p double"), Scratch(spark, "t"))
    assert sorted(map(tuple, got.collect())) == [("f", 0.0, 20.0, 90.0, 0.5), ("f", 12.0, 50.0, None, None), ("f", 48.0, 51.0, None, None)]


def test_acquisitions(spark):
    places = spark.createDataFrame([(37.0, -8.0), (37.1, -8.0), (37.1, -7.9)], "lat double, lon double")
    x, y = corpora.laea_forward(F.col("lat"), F.col("lon"))
    (a, b, c) = [(r["x"], r["y"]) for r in places.select("lat", "lon", x.alias("x"), y.alias("y")).orderBy("lat", "lon").collect()]
    rows = [(1, "2020-08-01 12:00:00", 5.0, *a), (1, "2020-08-01 18:00:00", 9.0, *b), (1, "2020-08-20 18:00:00", 12.0, *c), (1, "2020-08-02 00:00:00", None, *b), (1, "never", 1.0, *b), (2, "2020-08-01 12:00:00", 5.0, *a), (2, "2020-08-01 13:00:00", 5.0, None, None), (2, "2020-08-01 14:00:00", 5.0, *a)]
    got = corpora.acquisitions(spark.createDataFrame(rows, "fire long, at string, area double, x double, y double")).orderBy("t").collect()
    assert [(r["fire"], r["t"], r["area"]) for r in got] == [("medeu-1", 0.0, 5.0), ("medeu-1", 6.0, 9.0), ("medeu-1", 462.0, 12.0)]
    assert got[0]["bearing"] is None and got[1]["bearing"] == pytest.approx(0.0, abs=1e-6) and got[1]["rate"] == pytest.approx(11.1195 / 6, abs=1e-3) and got[2]["rate"] is None


def test_projection_round_trip(spark):
    df = spark.createDataFrame([(float(a), float(o)) for a in range(30, 71, 4) for o in range(-12, 41, 4)] + [(52.0, 10.0)], "lat double, lon double")
    x, y = corpora.laea_forward(F.col("lat"), F.col("lon"))
    df = df.select("lat", "lon", x.alias("x"), y.alias("y"))
    lat, lon = corpora.laea_inverse(F.col("x"), F.col("y"))
    for r in df.select("*", lat.alias("a"), lon.alias("o")).collect():
        assert abs(r["a"] - r["lat"]) < 2e-8 and abs(r["o"] - r["lon"]) < 2e-8
    home = df.filter("lat = 52 and lon = 10").first()
    assert (home["x"], home["y"]) == (pytest.approx(4321000.0), pytest.approx(3210000.0))
