"""Searches over all lanes at once against a heap per lane, and as-of picks against a scan."""

import os
import random

import pytest
from pyspark.sql import functions as F

from emberglass.operators import causal, egress
from emberglass.storage import Scratch

INF = egress.INF


@pytest.mark.parametrize("seed", range(3))
def test_departures_equal_the_heap_on_graphs_with_cycles(spark, seed):
    rng = random.Random(seed)
    edges, want = [], {}
    for region in range(4):
        n = rng.choice([3, 12, 40])
        roads = [(k, rng.randrange(n), rng.randrange(n), float(rng.randint(0, 9))) for k in range(rng.randint(1, 3 * n))]
        roads += [(1000 + k, k, k + 1, 1.0) for k in range(n - 1)]  # a long way, far beyond the hops of one round
        cut = {k: float(rng.randint(5, 200)) for k, *_ in roads if rng.random() < 0.4}
        seeds = {v: rng.choice([INF, float(rng.randint(10, 300))]) for v in rng.sample(range(n), 2)}
        want |= {(region, v): g for v, g in egress.latest_departure(roads, cut, seeds).items()}
        edges += [(region, k, a, b, s, cut.get(k)) for k, a, b, s in roads]
        edges += [(region, None, None, v, None, None if g == INF else g) for v, g in seeds.items()]
    edges += [(9, 1, 5, 6, 1.0, None)]  # a region without destinations
    df = spark.createDataFrame(edges, "region long, edge long, src long, dst long, travel_s double, cut_s double")
    got = {(r["region"], r["node"]): INF if r["depart_s"] is None else r["depart_s"] for r in egress.departures(df, ["region"], Scratch(spark, "t")).collect()}
    assert got == want


def test_lanes_equal_their_own_heaps(spark):
    rng = random.Random(11)
    lanes = [(p, c) for p in ("slow", "fast") for c in ("a", "b", "c")]
    roads = [(k, rng.randrange(60), rng.randrange(60), {"slow": float(rng.randint(2, 9)), "fast": float(rng.randint(1, 4))}, {c: float(rng.randint(20, 300)) for c in "abc" if rng.random() < 0.5}) for k in range(200)]
    ends = [("x", 3, {"a": 250.0}), ("y", 7, {}), ("z", 99, {"b": 10.0})]
    edges = spark.createDataFrame(roads, "edge long, src long, dst long, travel map<string,double>, cut map<string,double>")
    found = egress.departure_lanes(edges, spark.createDataFrame(ends, "destination string, node long, cut map<string,double>"), spark.createDataFrame(lanes, "profile string, config string"), Scratch(spark, "t"))
    got = {(r["profile"], r["config"], r["destination"], r["node"]): INF if r["depart_s"] is None else r["depart_s"] for r in found.collect()}
    want = {}
    for p, c in lanes:
        for name, node, own in ends:
            best = egress.latest_departure([(k, a, b, t[p]) for k, a, b, t, _ in roads], {k: cut[c] for k, *_, cut in roads if c in cut}, {node: own.get(c, INF)})
            want |= {(p, c, name, v): g for v, g in best.items()}
    assert got == want


def test_lanes_go_several_in_a_row(spark):
    rng = random.Random(5)
    lanes = [(p, c) for p in ("slow", "fast") for c in "abcd"][:-1]  # seven: the last part is short, and no full product
    roads = [(k, k % 30, rng.randrange(30), {"slow": 5.0, "fast": 2.0}, {c: float(rng.randint(20, 300)) for c in "abcd" if rng.random() < 0.5}) for k in range(90)]
    edges = spark.createDataFrame(roads, "edge long, src long, dst long, travel map<string,double>, cut map<string,double>")
    ends = spark.createDataFrame([("x", 3, {"a": 250.0}), ("y", 7, {})], "destination string, node long, cut map<string,double>")
    scratch = Scratch(spark, "t")
    found = egress.departure_lanes(edges, ends, spark.createDataFrame(lanes, "profile string, config string"), scratch).collect()
    got = {(r["profile"], r["config"], r["destination"], r["node"]): INF if r["depart_s"] is None else r["depart_s"] for r in found}
    want = {}
    for p, c in lanes:
        for name, node, own in (("x", 3, {"a": 250.0}), ("y", 7, {})):
            best = egress.latest_departure([(k, a, b, t[p]) for k, a, b, t, _ in roads], {k: cut[c] for k, *_, cut in roads if c in cut}, {node: own.get(c, INF)})
            want |= {(p, c, name, v): g for v, g in best.items()}
    assert got == want
    last = max((d for d in os.listdir(scratch.root.removeprefix("file://")) if d.startswith("values")), key=lambda d: int(d.split("-")[1]))
    assert spark.read.parquet(scratch.path(last)).count() <= 2 * 2 * 30  # two parts of two destinations, not seven lanes


def test_asof_equals_a_scan(spark):
    rng = random.Random(2)
    year = 1 << causal.SPAN_BITS
    at = lambda: rng.choice([rng.randrange(50), rng.randrange(20_000), rng.randrange(-3 * year, 40 * year)])
    frames = [(rng.choice("ab"), at(), rng.randrange(9)) for _ in range(300)] + [("only frames", 5, 1), ("a", None, 1)]
    cursors = [(rng.choice("ab"), at()) for _ in range(400)] + [("only cursors", 5), ("a", 7), ("a", 7), ("b", None)]
    f, c = spark.createDataFrame(frames, "k string, frame_s long, payload long"), spark.createDataFrame(cursors, "k string, cursor_s long")

    def pick(known, t):
        before = [x for x in known if x[0] <= t]
        return max(before) if before else max(x for x in known if x[0] == min(known)[0])

    for by in ("k", None):
        want = []
        for k, t in cursors:
            known = [x[1:] for x in frames if x[1] is not None and (by is None or x[0] == k)]
            if t is not None and known:
                want.append((*((k,) if by else ()), t, *pick(known, t)))
        got = causal.asof(f if by else f.drop("k"), c if by else c.drop("k"), by)
        assert sorted(map(tuple, got.collect())) == sorted(want)
        assert "SinglePartition" not in got._jdf.queryExecution().toString()
    with pytest.raises(Exception, match="out of range"):
        causal.asof(f.drop("k"), spark.createDataFrame([(1 << 40,)], "cursor_s long")).collect()
    assert causal.asof(f.limit(0), c, "k").collect() == [] == causal.asof(f, c.limit(0), "k").collect()


def test_frames_are_rows(spark):
    det = spark.createDataFrame([(5,), (7,), (7,), (None,), (20,)], "available_s long")
    of = lambda *a: sorted(r["frame_s"] for r in causal.timeline_frames(det, *a).collect())
    assert of() == [5, 7, 20] and of(6, 30) == [6, 7, 20, 30] and of(None, 6) == [5, 6]
    assert causal.timeline_frames(det.limit(0)).collect() == []


def test_repeated_scans_are_one_scan(spark):
    from emberglass.operators import issues

    clear = [600 * k for k in range(6)]
    cases = {"all": [(t, 0) for t in clear], "one missing, one twice": [(t, 0) for t in (*clear[:5], 0)], "one twice": [(t, 0) for t in (*clear, 0)], "torn": [(t, 0) for t in clear] + [(0, 4)], "off the hour's steps": [(t, 0) for t in clear[:5]] + [(601, 0)], "fire": [(0, 2), (0, 2)], "null": [(t, 0) for t in clear[:5]] + [(None, 0), (3000, None)]}
    flags = spark.createDataFrame([(c, t, f) for c, rows in cases.items() for t, f in rows], "cell string, scan_s long, flag int")
    got = {r["cell"]: (r["fire_1"], r["known_1"]) for r in issues.horizon_labels(flags, spark.createDataFrame([(0,)], "issue_s long")).collect()}
    assert got == {"all": (False, True), "one missing, one twice": (False, False), "one twice": (False, True), "torn": (False, False), "off the hour's steps": (False, False), "fire": (True, True), "null": (False, False)}
