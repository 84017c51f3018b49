"""Scores of forecasts: pairs of states, errors, average precision, confusion, calibration."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberglass.functions.geo import circular_error
from emberglass.operators.ranks import quantiles, running
from emberglass.storage import Scratch


def state_pairs(states: DataFrame, most_gap: float | None = None, group: str = "fire") -> DataFrame:
    """Consecutive states (t in hours, area, bearing, rate) of each group with 0 < dt <= most_gap, side by side."""
    w = Window.partitionBy(group).orderBy("t")
    nxt = {f"{c}1": F.lead(c).over(w) for c in ("t", "area", "bearing", "rate")}
    pairs = states.withColumns(nxt).withColumn("dt", F.col("t1") - F.col("t")).filter("dt > 0")
    return pairs if most_gap is None else pairs.filter(F.col("dt") <= most_gap)


def group_rates(pairs: DataFrame, group: str = "fire") -> DataFrame:
    return pairs.groupBy(group).agg(F.avg((F.col("area1") - F.col("area")) / F.col("dt")).alias("growth"))


def leave_one_out(rates: DataFrame, value: str = "growth") -> DataFrame:
    """Adds others: the mean over the other groups, from two sums rather than a join with itself. With one group null."""
    total = rates.agg(F.sum(value).alias("s"), F.count(value).alias("k"))
    return rates.join(F.broadcast(total), F.lit(True)).withColumn("others", F.when(F.col("k") > 1, (F.col("s") - F.col(value)) / (F.col("k") - 1))).drop("s", "k")  # one row


def _scratch(df: DataFrame) -> Scratch:
    return Scratch(df.sparkSession, "scores")


def r2_mape(rows: DataFrame, keys: list[str], obs: str, pred: str) -> DataFrame:
    """1 - SSres / SStot and the median absolute percentage error over observed > 0; null where undefined."""
    o, p = F.col(obs), F.col(pred)
    tot, res = F.var_pop(o) * F.count(o), F.sum(F.pow(o - p, 2))
    fit = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.when((F.count("*") > 1) & (tot > 0), 1 - res / tot).alias("r2"))
    off = quantiles(rows, keys, F.when(o > 0, F.abs(p - o) / o), [0.5], _scratch(rows)).select(*keys, F.col("q0").alias("mape"))
    same = reduce(lambda a, b: a & b, [F.col(f"f.{k}").eqNullSafe(F.col(f"m.{k}")) for k in keys])
    return fit.alias("f").join(off.alias("m"), same).select(*[F.col(f"f.{k}").alias(k) for k in keys], "n", "r2", "mape")


def median_r2(scores: DataFrame) -> DataFrame:
    """One row: the groups whose r2 is known and finite, and its median (null if there is none)."""
    return quantiles(scores, [], "r2", [0.5], _scratch(scores)).select(F.col("n").alias("fires"), F.col("q0").alias("median_r2"))


def corpus_summary(pairs: DataFrame, group: str = "fire") -> DataFrame:
    """One row over pairs of states with others (see leave_one_out): fires, pairs, least, median and greatest gap, and the
    pooled r2 of area1 by persistence and by the other fires' mean growth; null where undefined. Pooled without a window,
    so no task gets all pairs. No pairs give zeros and nulls."""
    o, n = F.col("area1"), F.count("area1")

    def r2(pred: Column, given: Column) -> Column:
        of = F.when(given, o)
        k, tot = F.count(of), F.var_pop(of) * F.count(of)
        return F.when((k > 1) & (tot > 0), 1 - F.sum(F.when(given, F.pow(o - pred, 2))) / tot)

    constant = F.col("area") + F.col("others") * F.col("dt")
    one = pairs.agg(F.count_distinct(group).alias("fires"), n.alias("pairs"), F.min("dt").alias("dt_min"), F.max("dt").alias("dt_max"), r2(F.col("area"), F.lit(True)).alias("r2_persistence"), r2(constant, F.col("others").isNotNull()).alias("r2_constant"))
    middle = quantiles(pairs, [], "dt", [0.5], _scratch(pairs)).select(F.col("q0").alias("dt_median"))
    return one.crossJoin(middle).select("fires", "pairs", "dt_min", "dt_median", "dt_max", "r2_persistence", "r2_constant")  # one row each


def bearing_errors(pairs: DataFrame) -> DataFrame:
    e = pairs.filter("bearing is not null and bearing1 is not null").select(circular_error(F.col("bearing1"), F.col("bearing")).alias("e"))
    return quantiles(e, [], "e", [0.5], _scratch(e)).select("n", F.col("q0").alias("median_error"))


def average_precision(rows: DataFrame, keys: list[str], y: str, p: str) -> DataFrame:
    """Sum over distinct thresholds of the recall gained times the precision there; equal scores count at once.

    Rows are summed by score first, and sums run along ranges of scores, so a group of any size is spread.
    """
    g = rows.groupBy(*keys, F.col(p).alias("_p")).agg(F.sum(F.col(y).cast("long")).alias("_tp"), F.count("*").alias("_k"))
    g = running(g, keys, F.coalesce(-F.col("_p"), F.lit(float("inf"))), ["_tp", "_k"], _scratch(rows))  # no score: last
    gained = F.sum(F.col("_tp") * F.col("_tp_") / F.col("_k_"))
    return g.groupBy(*keys).agg(F.sum("_k").alias("n"), F.sum("_tp").alias("positives"), F.when(F.sum("_tp") > 0, gained / F.sum("_tp")).alias("ap"))


def confusion(rows: DataFrame, keys: list[str], y: str, p: str, thresholds: list[float]) -> DataFrame:
    """Counts and rates at each threshold; a rate without cases is null."""
    t = rows.withColumn("threshold", F.explode(F.array(*[F.lit(x) for x in thresholds])))
    pos, hit = F.col(y) == 1, F.col(p) >= F.col("threshold")
    c = t.groupBy(*keys, "threshold").agg(F.count_if(pos & hit).alias("tp"), F.count_if(~pos & hit).alias("fp"), F.count_if(pos & ~hit).alias("fn"), F.count_if(~pos & ~hit).alias("tn"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    rate = {"precision": F.try_divide(tp, tp + fp), "recall": F.try_divide(tp, tp + fn), "f1": F.try_divide(2 * tp, 2 * tp + fp + fn), "csi": F.try_divide(tp, tp + fp + fn), "fpr": F.try_divide(fp, fp + tn)}
    return c.withColumns(rate)


def calibration(rows: DataFrame, keys: list[str], y: str, p: str, bins: int = 10) -> DataFrame:
    b = F.least(F.lit(bins - 1), F.floor(F.col(p) * bins)).cast("int")
    return rows.groupBy(*keys, b.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("rate"))


def brier(rows: DataFrame, keys: list[str], y: str, p: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("brier"), F.count("*").alias("n"))


def class_weight(rows: DataFrame, y: str) -> DataFrame:
    """Negatives per positive, between 1 and 50; one class alone is an error."""
    pos, neg = F.count_if(F.col(y) == 1), F.count_if(F.col(y) == 0)
    return rows.agg(F.when((pos == 0) | (neg == 0), F.raise_error(F.lit("only one class")).cast("double")).otherwise(F.greatest(F.lit(1.0), F.least(F.lit(50.0), neg / pos))).alias("weight"))


def _clipped_logit(p: Column, eps: float) -> Column:
    """Null for a null or NaN, which least() and greatest() would pass over."""
    q = F.when(p.isNotNull() & ~F.isnan(p), F.least(F.lit(1 - eps), F.greatest(F.lit(eps), p)))
    return F.log(q / (1 - q))


def calibrated(p: Column, slope: float, intercept: float, eps: float = 1e-6) -> Column:
    """The probability with its clipped logit moved along a line; null for a null or NaN."""
    return 1 / (1 + F.exp(-(slope * _clipped_logit(p, eps) + intercept)))


def fit_calibrator(rows: DataFrame, y: str, p: str, weight: str | None = None, penalty: float = 1e-3, rounds: int = 50, eps: float = 1e-6) -> tuple[float, float]:
    """(slope, intercept) for calibrated(): a weighted logistic fit of y (0 or 1) to the clipped logit of p over all rows,
    with penalty / 2 times the slope's square, by Newton's steps.

    Each step is one aggregate of six sums, so nothing but they come to the driver; give rows as a written table, as it
    is read once a step. Rows without y, p or weight are left out. One class alone, or a slope not above 0, is an error.
    """
    data = rows.select(F.col(y).cast("double").alias("y"), _clipped_logit(F.col(p), eps).alias("z"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w")).filter("y is not null and z is not null and w is not null")
    if data.agg(F.count_distinct("y").alias("n")).first()["n"] < 2:
        raise ValueError("the calibration rows lack a class")

    def sums(a: float, b: float) -> tuple:
        at = F.col("z") * a + b
        m = 1 / (1 + F.exp(-at))
        h = F.col("w") * m * (1 - m)
        loss = F.col("w") * (F.log1p(F.exp(-F.abs(at))) + F.greatest(at, F.lit(0.0)) - F.col("y") * at)
        r = F.col("w") * (m - F.col("y"))
        return tuple(data.agg(*[F.sum(x) for x in (loss, r * F.col("z"), r, h * F.col("z") * F.col("z"), h * F.col("z"), h)]).first())

    a, b, step = 0.0, 0.0, 1.0
    loss, ga, gb, haa, hab, hbb = sums(a, b)
    for _ in range(rounds):
        g, h = np.array([ga + penalty * a, gb]), np.array([[haa + penalty, hab], [hab, hbb]])
        d = np.linalg.solve(h, g)
        if float(np.abs(d).max()) < 1e-10:
            break
        before, step = loss + penalty * a * a / 2, 1.0
        while True:  # half steps until it gets no worse
            na, nb = a - step * d[0], b - step * d[1]
            new = sums(float(na), float(nb))
            if new[0] + penalty * na * na / 2 <= before + 1e-12 * abs(before) or step < 1e-6:
                break
            step /= 2
        a, b, (loss, ga, gb, haa, hab, hbb) = float(na), float(nb), new
    if a <= 0:
        raise ValueError("the calibration slope is not above 0")
    return a, b


def monotone(hazards: Column) -> Column:
    """Probabilities by horizon, never falling, from an array of raw hazards: 1 - exp(-running sum of softplus)."""
    soft = F.transform(hazards, lambda x: F.log1p(F.exp(-F.abs(x))) + F.greatest(x, F.lit(0.0)))
    return F.transform(F.sequence(F.lit(1), F.size(hazards)), lambda i: -F.expm1(-F.aggregate(F.slice(soft, F.lit(1), i), F.lit(0.0), lambda s, v: s + v)))


def bootstrap(group_means: DataFrame, keys: list[str], value: str, draws: int = 2000, seed: int = 0) -> DataFrame:
    """Mean over groups with its 95 % interval, from seeded redraws of the groups. One row per group and key comes in."""
    cols = ", ".join(f"{k} {group_means.schema[k].dataType.simpleString()}" for k in keys)

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.sort(pdf[value].to_numpy(float))
        rng = np.random.default_rng(seed)
        m = np.array([x[rng.integers(0, len(x), len(x))].mean() for _ in range(draws)])
        lo, hi = np.quantile(m, [0.025, 0.975])
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keys}, "mean": x.mean(), "low": lo, "high": hi, "n": len(x)}])

    return group_means.select(*keys, value).groupBy(*keys).applyInPandas(of, f"{cols}, mean double, low double, high double, n long")


def acceptance(scores: DataFrame, least_groups: int = 10, most_fpr: float = 0.01) -> DataFrame:
    """One row per model: accepted, and the reasons against it. scores: model, seed, horizon, groups, low, brier, best_brier, fpr."""
    bad = F.filter(F.array(F.when(F.col("groups") < least_groups, "too few groups"), F.when(F.col("low") <= 0, "not above the baselines"), F.when(F.col("brier") > F.col("best_brier"), "Brier score"), F.when(F.col("fpr") > most_fpr, "false positives")), lambda x: x.isNotNull())
    r = scores.withColumn("bad", bad).groupBy("model").agg(F.countDistinct("seed").alias("seeds"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("bad")))).alias("reasons"))
    r = r.withColumn("reasons", F.when(F.col("seeds") < 3, F.array_append("reasons", "fewer than three seeds")).otherwise(F.col("reasons")))
    return r.select("model", (F.size("reasons") == 0).alias("accepted"), "reasons")


def constraints(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(name, violated) for each named condition that rows must not meet; one pass over rows."""
    counts = rows.agg(*[F.count_if(F.coalesce(c, F.lit(True))).alias(n) for n, c in checks.items()])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("violated")) for n in checks])))


def hull(points: pd.DataFrame) -> list[tuple[float, float]]:
    """Convex hull (monotone chain), counter-clockwise from the least point."""
    p = sorted(set(zip(points["x"], points["y"])))
    if len(p) < 3:
        return p

    def half(seq: Iterator) -> list:
        out: list = []
        for q in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return half(iter(p)) + half(iter(p[::-1]))


def convex_hulls(points: DataFrame, key: str, cells: int = 64) -> DataFrame:
    """(key, hull) for points (key, x, y). A hull's points are hull points of their slice, so slices go first and only
    theirs meet: no task gets all points of a key."""
    t = f"{key} {points.schema[key].dataType.simpleString()}"
    sliced = points.select(key, "x", "y", F.pmod(F.xxhash64("x", "y"), F.lit(cells)).alias("part"))
    own = sliced.groupBy(key, "part").applyInPandas(lambda pdf: pd.DataFrame([(pdf[key].iloc[0], *p) for p in hull(pdf)], columns=[key, "x", "y"]), f"{t}, x double, y double")
    return own.groupBy(key).applyInPandas(lambda pdf: pd.DataFrame([{key: pdf[key].iloc[0], "hull": [{"x": x, "y": y} for x, y in hull(pdf)]}]), f"{t}, hull array<struct<x: double, y: double>>")
