"""Routes and verdicts against heaps lane by lane, and against what must not happen."""

import os
import random

import pytest
from pyspark.sql import functions as F

from emberglass.constants import PROFILES, SPEED_KMH, SWEEP
from emberglass.operators import egress, evacuation
from emberglass.storage import Scratch

INF = egress.INF
EDGES = "edge long, src long, dst long, highway string, metres double, travel_s double"
CUTS = "config string, cut_s long, latency_s long"
PLACES = "sid string, name string, population long, node long"


def scaled(travel, highway, scale):
    speed = SPEED_KMH.get(highway)
    return travel if speed is None else max(1.0, float(int(travel * speed / max(1, int(speed * scale + 0.5)) + 0.5)))


def made(rng, n):
    roads = ["primary", "track", "residential", "tertiary"]
    edges = [(k, k % n, (k % n + 1 + rng.randrange(3)) % n, rng.choice(roads), float(rng.randint(100, 3000)), float(rng.randint(30, 400))) for k in range(3 * n)]
    edges += [(1000 + k, b, a, h, m + 1, s) for k, (_, a, b, h, m, s) in enumerate(edges)]
    configs = [c[1] for c in SWEEP]
    cuts = [(e[0], c, rng.randint(1000, 9000), rng.choice([0, 1000, 5000])) for e in edges for c in configs if rng.random() < 0.25]
    nodes = [(v, c, rng.randint(4000, 20_000), 100) for v in range(n) for c in configs if rng.random() < 0.3]
    return edges, cuts, nodes


@pytest.mark.parametrize(("seed", "cursor"), [(1, 6000), (2, 0)])
def test_routes_equal_heaps(spark, seed, cursor):
    rng = random.Random(seed)
    n = 25
    edges, cuts, nodes = made(rng, n)
    places = [("a", "A", 900, 0), ("b", "B", None, 9), ("c", "C", 0, 17), ("off", "Off", 5, None), ("d", "D", 10, 9)]
    frames = [spark.createDataFrame(rows, schema) for rows, schema in ((edges, EDGES), (cuts, f"edge long, {CUTS}"), (nodes, f"node long, {CUTS}"), (places, PLACES), ([("a",), ("b",), ("off",)], "sid string"))]
    routes, verdicts = evacuation.evacuation(*frames, cursor, 50_000, True, Scratch(spark, "t"))
    got = {r["route"]: r for r in routes.collect()}
    known = lambda rows: {(k, c): cut for k, c, cut, wait in rows if cut + wait <= cursor}
    edge_cut, node_cut = known(cuts), known(nodes)
    for pocket, source in (("a", 0), ("b", 9)):
        for sid, _, _, target in places:
            if target is None or target == source:
                assert f"{pocket}-{sid}" not in got
                continue
            values, way = [], None
            for p in PROFILES:
                roads = [(e, a, b, scaled(s, h, p[4]), m) for e, a, b, h, m, s in edges]
                for c in SWEEP:
                    mine = {e: t for (e, k), t in edge_cut.items() if k == c[1]}
                    best = egress.latest_departure([r[:4] for r in roads], mine, {target: node_cut.get((target, c[1]), INF)})
                    if source not in best:
                        continue
                    values.append(best[source])
                    if way is None:
                        leave = best if best[source] != INF else {v: (0.0 if v == source else g) for v, g in best.items()}
                        if best[source] == INF:  # only what is never cut
                            roads_open = [r for r in roads if r[0] not in mine and best.get(r[2]) == INF]
                            way = egress.route(roads_open, {}, {v: (0.0 if v == source else g) for v, g in best.items()}, source, {target})
                        else:
                            way = egress.route(roads, mine, leave, source, {target})
                        profile = p[0]
            r = got[f"{pocket}-{sid}"]
            assert r["earliest_s"] == min(min(values), 50_000) and r["latest_s"] == (None if max(values) == INF else max(values))
            length = {e[0]: e[4] for e in edges}
            assert sum(length[e] for e in r["edges"]) == way[1] and r["profile"] == profile
            assert r["km"] == pytest.approx(way[1] / 1000, abs=0.0051)
            at = {e[0]: (e[1], e[2]) for e in edges}
            assert at[r["edges"][0]][0] == source and at[r["edges"][-1]][1] == target
            assert all(at[x][1] == at[y][0] for x, y in zip(r["edges"], r["edges"][1:]))
            if pocket == "b":
                assert r["worst_min"] is None and not r["usable"]
            elif r["usable"]:
                assert r["earliest_s"] - r["worst_min"] * 60 - 1800 >= cursor
            else:
                assert r["reason"]
    assert {(r["pocket"], r["verdict"]) for r in verdicts.collect()} >= {("off", "no_verified_action"), ("b", "no_verified_action")}


def test_ways_meet_only_the_roads_that_their_hops_come_to(spark):
    none = spark.createDataFrame([], f"edge long, {CUTS}")
    chain = [(2 * k + d, k + d, k + 1 - d, "primary", 500.0 + k, 30.0) for k in range(10) for d in (0, 1)]
    chain += [(1000 + k, 1000 + k, 1, "primary", 500.0, 30.0) for k in range(400)]  # they lead here, and none leads to them
    frames = [spark.createDataFrame(chain, EDGES), none, none.withColumnRenamed("edge", "node"), spark.createDataFrame([("a", "A", 5, 0), ("b", "B", 5, 9)], PLACES), spark.createDataFrame([("a",)], "sid string")]
    scratch = Scratch(spark, "t")
    routes, _ = evacuation.evacuation(*frames, 0, 99_000, True, scratch)
    assert [r["edges"] for r in routes.collect()] == [[2 * k for k in range(9)]]  # more hops than one round has
    nets = [d for d in os.listdir(scratch.root.removeprefix("file://")) if d.startswith("net-")]
    assert max(spark.read.parquet(scratch.path(d)).count() for d in nets) < 100  # of 420 roads


def test_nothing_observed_opens_no_route(spark):
    edges, _, _ = made(random.Random(3), 10)
    none = spark.createDataFrame([], f"edge long, {CUTS}")
    routes, verdicts = evacuation.evacuation(spark.createDataFrame(edges, EDGES), none, none.withColumnRenamed("edge", "node"), spark.createDataFrame([("a", "A", 5, 0), ("b", "B", 5, 5)], PLACES), spark.createDataFrame([("a",)], "sid string"), 0, 9000, False, Scratch(spark, "t"))
    (r,) = routes.collect()
    assert not r["usable"] and r["earliest_s"] == 9000 and r["latest_s"] is None and "no combination of 24" in r["basis"]
    assert [tuple(v) for v in verdicts.collect()] == [("a", "not_yet_observed", None)]


def test_segments_and_latency(spark):
    det = spark.createDataFrame([(7, "MTG_I1"), (8, "SENTINEL_3A")], "id long, source string")
    cuts = spark.createDataFrame([(0, "all-1x", 1, 50, [7, 8]), (2, "all-2x", 1, 40, [8]), (1, "all-0.5x", 2, 9, [99])], "config_ord int, config string, seg_id long, cut_s long, evidence array<long>")
    assert {(r["seg_id"], r["config"]): r["latency_s"] for r in evacuation.with_latency(cuts, det).collect()} == {(1, "all-1x"): 1020, (1, "all-2x"): 21600, (2, "all-0.5x"): 10800}
    got = {r["edge"]: tuple(r)[1:] for r in evacuation.segments(spark.range(1, 4).select(F.col("id").alias("edge")), cuts).collect()}
    assert got[1] == (50, 40, 50, "earliest by all-2x, latest by all-1x, 2 of 12 configurations; the other 10 never cut it", [7, 8])
    assert got[2][:3] == (None, 9, 9) and got[3] == (None,) * 5


def test_from_detections_to_the_verdict(spark):
    from emberglass.operators.causal import with_availability
    from emberglass.plans import api

    at = lambda k: (37.0, -2.0 + 0.05 * k)
    nodes = spark.createDataFrame([(k, *at(k)) for k in range(4)], "node_id long, lat double, lon double")
    rows = [(k, k, k + 1, "primary", 4400.0, 200.0, *at(k), *at(k + 1)) for k in range(3)]
    edges = spark.createDataFrame(rows, f"{EDGES}, lat1 double, lon1 double, lat2 double, lon2 double")
    places = spark.createDataFrame([("a", "A", 100, 37.001, -2.0), ("b", "B", 50, 37.0, -1.85)], "sid string, name string, population long, lat double, lon double")
    det = with_availability(spark.createDataFrame([(1, 9000, "MODIS_NRT", 5.0, 0.9, 37.001, -1.925)], "id long, at_s long, source string, frp double, confidence double, lat double, lon double"))
    seen = {}
    for cursor in (9000 + 10_799, 9000 + 10_800):
        out = api.evacuate(det, edges, nodes, places, spark.createDataFrame([("a",)], "sid string"), cursor)
        seen[cursor] = ([(r["edges"], r["earliest_s"], r["usable"]) for r in out["routes"].collect()], out["verdicts"].first()["verdict"])
        cut = {r["edge"]: r["cut_s"] for r in out["segments"].collect()}
    assert cut == {0: None, 1: 9000, 2: None}
    assert seen[19_799] == ([([0, 1, 2], 12_600.0, False)], "not_yet_observed")
    ((edges_, earliest, usable),), verdict = seen[19_800]
    assert edges_ == [0, 1, 2] and not usable and verdict == "no_verified_action"
    assert earliest == 9000 - 2 * 286  # the cautious profile's two roads up to the cut's end
