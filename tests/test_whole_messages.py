"""Messages on small fixtures: which route is named, what is rejected, what the document says, what the ledger keeps."""

import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from emberglass.operators import messages
from emberglass.streaming.ledger import Ledger

ROUTES = "route string, pocket string, destination string, edges array<long>, km double, travel_min long, slowest string, earliest_s double, open_s double, latest_s double, basis string, worst_min double, usable boolean"
PLACES = "sid string, name string, lat double, lon double, outline array<struct<lat: double, lon: double>>, languages array<string>, reached boolean"
SENT = "2024-07-10T12:00:00+02:00"


@pytest.fixture(scope="module")
def made(spark):
    route = lambda r, p, d, e, slow, at, late, ok: (r, p, d, e, 5.0, 9, slow, at, at, late, "b", 20.0, ok)
    found = spark.createDataFrame([
        route("a-b", "a", "Bee", [1, 2], "primary", 9000.0, 9900.0, True), route("a-c", "a", "Cee & Co", [3], "track", 9500.0, None, True), route("a-d", "a", "Dee", [2], "primary", 9900.0, None, False),
        route("b-a", "b", "Ay", [4], "residential", 9000.0, None, True), route("c-a", "c", "Nowhere", [2], "primary", 9000.0, 99_000.0, True),
    ], ROUTES)
    ring = [{"lat": 37.0 + x, "lon": -2.0 + y} for x, y in ((0, 0), (0, 1), (1, 1), (1, 0), (0, 0))]
    places = spark.createDataFrame([
        ("a", "Ay", 37.0, -2.0, ring, None, None), ("b", "Bee", 37.1, -2.0, None, ["en", "xx"], True), ("c", "Cee & Co", 37.2, -2.0, None, ["ca"], True),
        ("d", "Dee", 37.3, -2.0, None, ["xx"], False), ("e", "Eee", -2.0, 37.0, None, ["en"], True), ("f", "F", 37.0, -2.0, None, None, True),
    ], PLACES)
    verdicts = spark.createDataFrame([("a", "routes_open"), ("b", "routes_open"), ("c", "routes_open"), ("d", "no_verified_action"), ("e", "no_verified_action"), ("f", "not_yet_observed")], "pocket string, verdict string")
    ways = spark.createDataFrame([(1, None, "primary"), (2, "Big Road", "primary"), (3, "<Track>", "track"), (4, "", "residential")], "edge long, name string, highway string")
    rows = messages.recommended(found, verdicts, places, ways, 8000, 12_600).cache()
    packages, rejected = messages.spoken(rows, places, ways)
    return rows, packages.cache(), rejected.cache()


def test_one_route_a_pocket(made):
    got = {r["pocket"]: (r["instruction"], r["destination"], r["road"], r["certainty"], r["severity"]) for r in made[0].collect()}
    assert got == {
        "a": ("evacuate_alternate", "Cee & Co", "<Track>", "Possible", "Extreme"), "b": ("evacuate_primary", "Ay", "", "Possible", "Extreme"), "c": ("evacuate_primary", "Nowhere", "Big Road", "Possible", "Extreme"),
        "d": ("no_action", None, "", "Possible", "Severe"), "e": ("no_verified_action", None, "", "Possible", "Extreme"), "f": ("no_verified_action", None, "", "Possible", "Extreme"),
    }


def test_what_is_sent_and_what_is_not(made):
    sent = {(r["pocket"], r["language"]): r["text"] for r in made[1].collect()}
    assert set(sent) == {("a", "es"), ("a", "en"), ("d", "es"), ("e", "en"), ("f", "es"), ("f", "en")}
    assert sent["a", "en"] == "Go from Ay to Cee & Co along <Track>; part of the way is a track."
    assert {(r["pocket"], r["language"], r["reason"], r["detail"]) for r in made[2].collect()} == {("b", "en", "unresolved_name", ""), ("c", "ca", "unresolved_name", "Nowhere")}


def test_a_gap_is_no_sentence(spark, made):
    rows = made[0].withColumn("text", F.transform_values("text", lambda k, v: F.concat(v, F.lit(" {when}"))))
    packages, rejected = messages.spoken(rows, spark.createDataFrame([], PLACES), spark.createDataFrame([], "edge long, name string, highway string"))
    assert packages.count() == 0 and {r["reason"] for r in rejected.filter("text is not null").collect()} == {"incomplete_template"}


def test_documents(made):
    got = {r["pocket"]: r for r in messages.documents(made[1], SENT).collect()}
    assert set(got) == {"a", "d", "e", "f"} and [got[p]["problems"] for p in "adf"] == [[], [], []]
    assert got["e"]["problems"] == ["a point lies outside the region"]
    root, ns = ET.fromstring(got["a"]["xml"]), "{urn:oasis:names:tc:emergency:cap:1.2}"
    assert [i.find(f"{ns}language").text for i in root.iter(f"{ns}info")] == ["en", "es"]
    assert root.find(f"{ns}info/{ns}headline").text.endswith("<Track>; part of the way is a track.") and root.find(f"{ns}identifier").text == "emberglass:a:20240710T120000+0200:evacuate_alternate"
    wrong = messages.documents(made[1], "10 July", {"sender": "x", "status": "<b>", "scope": "Private"}).filter("pocket = 'a'").first()["problems"]
    assert "sent is no date of an alert" in wrong and "the scope asks for addresses" in wrong and "status holds markup" in wrong


def test_problems_of_rings(spark):
    ring = lambda *p: [{"lat": a, "lon": o} for a, o in p]
    df = spark.createDataFrame([(ring((37.0, -2.0), (37.1, -2.0), (37.0, -1.9)), "<info></info>"), (ring((37.0, -2.0), (37.1, -2.0), (37.0, -1.9), (37.0, -2.0)), "<info></info><urgency>x")], "area array<struct<lat: double, lon: double>>, xml string")
    open_ = {"scope": "Public"}
    got = [r["p"] for r in df.select(messages.problems(F.col("xml"), F.col("area"), F.lit(1), open_).alias("p")).collect()]
    assert got == [["the ring has fewer than four points", "the ring is not closed"], ["urgency is not closed"]]


def test_entries_are_recorded_once(spark, made, tmp_path):
    mark = messages.fingerprint_of({"b": 1, "a": [2]})
    assert mark == messages.fingerprint_of({"a": [2], "b": 1}) and len(mark) == 16
    rows = messages.entries(made[0], 8000, mark)
    assert {r["pocket"] for r in rows.collect()} == set("acdef")
    book = Ledger(spark, f"file://{tmp_path}/ledger")
    book.append(rows, 0)
    book.append(rows.withColumn("payload", F.lit("later")), 1)
    kept = book.entries().collect()
    assert len(kept) == 5 and not any(r["payload"] == "later" for r in kept) and any("Cee & Co: 5.0 km, 9 min, worst road track" in r["payload"] for r in kept)
