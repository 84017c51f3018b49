"""Hulls and intervals against brute force, as SQL has neither."""

import random

import numpy as np
from emberglass.operators import scoring


def brute_hull(points):
    """A point is a corner if some line through it leaves all others strictly on one side or on the line beyond it."""
    p, out = sorted(set(points)), set()
    for a in p:
        for b in p:
            side = [(b[0] - a[0]) * (q[1] - a[1]) - (b[1] - a[1]) * (q[0] - a[0]) for q in p]
            on = [q for q, s in zip(p, side) if s == 0]
            if a != b and all(s >= 0 for s in side) and a in (min(on), max(on)) and b in (min(on), max(on)):
                out |= {a, b}
    return out or set(p)


def test_hulls_of_many_slices(spark):
    rng = random.Random(2)
    groups = {k: [(float(rng.randrange(12)), float(rng.randrange(12))) for _ in range(n)] for k, n in ((1, 200), (2, 5), (3, 1))}
    groups[4] = [(float(k), float(k)) for k in range(9)] * 2  # on one line, repeated
    df = spark.createDataFrame([(k, *p) for k, ps in groups.items() for p in ps], "g long, x double, y double")
    got = {r["g"]: [(p["x"], p["y"]) for p in r["hull"]] for r in scoring.convex_hulls(df, "g", cells=8).collect()}
    assert set(got) == set(groups)
    for k, points in groups.items():
        assert set(got[k]) == brute_hull(points) and len(set(got[k])) == len(got[k])
        area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(got[k], got[k][1:] + got[k][:1]))
        assert area > 0 if k < 3 else area == 0  # counter-clockwise
    assert scoring.convex_hulls(df.limit(0), "g").count() == 0


def test_intervals_are_seeded_and_hold_the_mean(spark):
    rows = [("a", float(v)) for v in np.random.default_rng(1).normal(5, 2, 80)] + [("b", 3.0)] * 4
    df = spark.createDataFrame(rows, "k string, v double")
    one = {r["k"]: r for r in scoring.bootstrap(df, ["k"], "v").collect()}
    two = {r["k"]: r for r in scoring.bootstrap(df.repartition(5), ["k"], "v").collect()}
    assert one == two and (one["b"]["low"], one["b"]["high"], one["b"]["n"]) == (3.0, 3.0, 4)
    x = np.array([v for k, v in rows if k == "a"])
    half = 1.96 * x.std() / len(x) ** 0.5
    assert abs(one["a"]["mean"] - x.mean()) < 1e-12 and abs(one["a"]["low"] - (x.mean() - half)) < 0.1 and abs(one["a"]["high"] - (x.mean() + half)) < 0.1
    assert scoring.bootstrap(df.limit(0), ["k"], "v").count() == 0
