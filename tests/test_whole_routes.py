"""Routes, sentences, picks and known ids on small fixtures."""

import pytest
from pyspark.sql import functions as F

from emberglass.operators import audits, issues, routes, snapshots

GRAPH = "region int, kind string, edge long, src long, dst long, travel_s double, metres double, cut_s double"


def test_routes_are_the_shortest_in_time(spark):
    rows = [
        (1, "edge", 10, 1, 2, 60.0, 100.0, None), (1, "edge", 11, 2, 3, 60.0, 100.0, 1000.0), (1, "edge", 12, 1, 3, 600.0, 150.0, None),
        (1, "destination", None, None, 3, None, None, 5000.0), (1, "source", None, 1, None, None, None, None), (1, "source", None, 9, None, None, None, None),
        (2, "edge", 20, 1, 2, 60.0, 100.0, None), (2, "destination", None, None, 2, None, None, None), (2, "source", None, 1, None, None, None, None),
    ]
    got = {(r["region"], r["source"]): r for r in routes.routes(spark.createDataFrame(rows, GRAPH), ["region"]).collect()}
    assert set(got) == {(1, 1), (2, 1)}
    # leaving at 4400 by the long road beats 880 by the one that is cut
    assert (got[1, 1]["depart_s"], got[1, 1]["edges"], got[1, 1]["km"]) == (4400.0, [12], 0.15)
    assert (got[2, 1]["depart_s"], got[2, 1]["edges"], got[2, 1]["spare_s"]) == (None, [20], None)


def test_sentences_are_verified(spark):
    names = spark.createDataFrame([(1, 0, "Bedar"), (1, 1, "A 7"), (2, 0, "A 7"), (3, 0, "nowhere"), (3, 1, "A 7"), (4, 0, "A 7")], "sentence int, ord int, name string")
    places, ways = spark.createDataFrame([(1, "bedar ")], "id int, name string"), spark.createDataFrame([(5, "a 7", 70), (6, "A 9", 90)], "id int, name string, edge int")
    edges = spark.createDataFrame([(1, 70), (2, 90), (3, 90)], "sentence int, edge int")
    got = {r["sentence"]: (r["reason"], r["name"]) for r in routes.verified(names, places, ways, edges).collect()}
    assert got == {1: (None, None), 2: ("not_passable", "A 7"), 3: ("unresolved_name", "nowhere"), 4: (None, None)}


def test_choice_areas_and_severity(spark):
    gated = spark.createDataFrame([(1, "b", 5.0, True), (1, "a", 5.0, True), (1, "c", 9.0, False), (2, "a", 1.0, False)], "pocket int, destination string, earliest_s double, usable boolean")
    assert [(r["pocket"], r["destination"]) for r in routes.chosen(gated, "pocket").collect()] == [(1, "a")]
    row = gated.limit(1).select(routes.settlement_area(F.lit(None).cast("array<struct<lat:double,lon:double>>"), F.lit(1.0), F.lit(2.0)).alias("a"), routes.severity(F.lit(None).cast("boolean")).alias("s")).first()
    assert len(row["a"]) == 5 and row["a"][0] == row["a"][-1] and row["s"] == "Extreme"


def test_picks_and_known_ids(spark):
    events = spark.createDataFrame([(0, 0, 10, 5), (1, 20, 30, 9), (2, 5, 8, 5), (3, None, None, 99)], "ord int, first_s int, last_s int, detections int")
    assert snapshots.pick_event(events, 0, 12).first()["ord"] == 0 and snapshots.pick_event(events, 100, 200).first()["ord"] == 3
    assert snapshots.pick_event(events.limit(0), 0, 1).count() == 0
    ids, places = spark.createDataFrame([(1,), (1,), (2,), (4,)], "k int"), spark.createDataFrame([(1,), (2,)], "k int")
    assert {tuple(r) for r in audits.known_once(ids, places, "k").collect()} == {(4, "unknown"), (1, "repeated")}
    det = spark.createDataFrame([("a", 1), (None, 2)], "cluster_id string, id int")
    clusters = spark.createDataFrame([("a", [2]), ("b", [2, 7])], "cluster_id string, hotspot_ids array<int>")
    assert {tuple(r) for r in snapshots.detections_of(det, clusters).collect()} == {("a", 1), ("b", 2)}


def test_cell_features(spark):
    cells = spark.createDataFrame([(1, 0, 0, False, 0.0, 1.0, 1.0), (1, 3, 4, True, 2.0, 2.0, 2.0), (2, 0, 0, False, 0.0, 5.0, 5.0)], "g int, row int, col int, active boolean, fire double, lon double, lat double")
    got = {(r["g"], r["row"]): r["score"] for r in issues.nearness(cells, "g").collect()}
    assert got == {(1, 0): pytest.approx(2.718281828 ** -2.5), (1, 3): 1.0, (2, 0): 0.0}
    off = {(r["g"], r["row"]): (r["distance"], r["has_fire"]) for r in issues.offsets(cells, "g").collect()}
    assert off[1, 3] == (0.0, 1.0) and off[2, 0] == (0.0, 0.0) and off[1, 0][0] > 0
    thin = issues.thinned(spark.range(100).selectExpr("id", "id % 2 AS g"), "g", "id", 5)
    assert sorted(r["id"] for r in thin.filter("g = 0").collect()) == [0, 24, 48, 72, 98]


def test_clearance_sorts_no_task_of_roads_and_keeps_its_ties(spark):
    """Nobody: the first road; people: the tightest, first in order; unknown: no row. No struct is aggregated by sorting."""
    from emberglass.operators.routes import clearance_range

    edges = [(r, o, e, h) for r in (1, 2, 3, 4, 5) for o, e, h in ((2, 20, "track"), (1, 10, "motorway"), (3, 30, "service"), (0, 5, "nowhere"))]
    roads = spark.createDataFrame(edges, "route int, ord int, edge int, highway string")
    people = spark.createDataFrame([(1, 1000), (2, 0), (3, None), (4, -6)], "route int, population long")
    out = clearance_range(roads, people)
    got = {r["route"]: (r["worst_min"], r["best_min"], r["worst_profile"], r["best_profile"], r["edge"]) for r in out.collect()}
    assert got.keys() == {1, 2, 4} and got[4][4] == 10
    assert got[1] == (194.4, 93.8, "cautious", "optimistic", 20) and got[2] == (0.0, 0.0, "cautious", "cautious", 5)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan
