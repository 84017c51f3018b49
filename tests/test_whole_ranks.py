"""Quantiles and running sums of groups that are spread, against sorting them whole."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberglass.operators import ranks, scoring
from emberglass.storage import Scratch

QS = [0.0, 0.25, 0.5, 0.9, 1.0]


@pytest.mark.parametrize("small", [100_000, 40])
def test_quantiles_equal_a_sort(spark, small, monkeypatch):
    monkeypatch.setattr(ranks, "SMALL", small)
    monkeypatch.setattr(ranks, "BINS", 7)
    rng = random.Random(small)
    rows = [("wide", rng.choice([-1e300, 1e300, 1e-300, 0.0, rng.uniform(-1, 1)])) for _ in range(200)]
    rows += [("skew", 10.0 ** rng.uniform(-12, 12)) for _ in range(300)] + [("same", 4.0)] * 120 + [("two", 1.0)] * 60 + [("two", 2.0)] * 60
    rows += [("one", 3.0), ("none", None), ("odd", math.nan), ("odd", math.inf), ("odd", 5.0)] + [(None, float(k)) for k in range(75)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {r["k"]: tuple(r)[1:] for r in ranks.quantiles(df, ["k"], "v", QS, Scratch(spark, "t")).collect()}
    for k in {r[0] for r in rows}:
        known = [v for g, v in rows if g == k and v is not None and math.isfinite(v)]
        assert got[k][0] == len(known)
        assert got[k][1:] == (tuple(pytest.approx(x, rel=1e-12) for x in np.quantile(known, QS)) if known else (None,) * 5)
    (one,) = ranks.quantiles(df, [], F.col("v") * 2, [0.5], Scratch(spark, "t")).collect()
    assert one["q0"] == pytest.approx(2 * float(np.median([v for _, v in rows if v is not None and math.isfinite(v)])))
    assert [tuple(r) for r in ranks.quantiles(df.limit(0), [], "v", [0.5], Scratch(spark, "t")).collect()] == [(0, None)]
    assert ranks.quantiles(df.limit(0), ["k"], "v", [0.5], Scratch(spark, "t")).collect() == []


def test_running_sums_over_ranges(spark):
    rng = random.Random(3)
    rows = [("hot", k, rng.randrange(9)) for k in range(500)] + [("a", 1, 4), ("b", None, 2), ("b", 7, 3), (None, 2, 1), (None, 1, 1)]
    rng.shuffle(rows)
    out = ranks.running(spark.createDataFrame(rows, "k string, t long, n long"), ["k"], F.col("t"), ["n"], Scratch(spark, "t"))
    assert out.columns == ["k", "t", "n", "n_"]
    for r in out.collect():
        assert r["n_"] == sum(n for k, t, n in rows if k == r["k"] and (t is None or (r["t"] is not None and t <= r["t"])))
    assert out.select(F.spark_partition_id()).distinct().count() > 1


def test_average_precision_of_one_large_group(spark):
    rng = random.Random(5)
    rows = [("hot", int(rng.random() < 0.3), rng.choice([rng.random(), 0.5])) for _ in range(1500)] + [("none", 0, 0.5), ("tie", 1, 0.5), ("tie", 0, 0.5), ("tie", 1, None)]
    got = {r["k"]: (r["n"], r["positives"], r["ap"]) for r in scoring.average_precision(spark.createDataFrame(rows, "k string, y int, p double"), ["k"], "y", "p").collect()}
    for key in ("hot", "none", "tie"):
        mine = [(p if p is not None else -1, y) for k, y, p in rows if k == key]
        ap, positives = 0.0, sum(y for _, y in mine)
        for t in sorted({p for p, _ in mine}, reverse=True):
            at = sum(y for p, y in mine if p == t)
            ap += at * sum(y for p, y in mine if p >= t) / sum(p >= t for p, _ in mine)
        assert got[key] == (len(mine), positives, pytest.approx(ap / positives) if positives else None)
