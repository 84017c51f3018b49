"""Issue times, labels over horizons, and features of grid cells. Times are in seconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberglass.operators.ranks import quantiles
from emberglass.operators.rasters import distances
from emberglass.storage import Scratch

HOUR, DELAY_S, TAIL_H, HORIZONS = 3600, 2700, 6, (1, 3, 6)


def _ceil_hour(x: Column) -> Column:
    return (F.ceil(x / HOUR) * HOUR).cast("long")


def _spaced(n: Column, most: int) -> Column:
    """Places 0 to n - 1, or most of them at equal steps, both ends included."""
    step = (n - 1) / F.lit(float(max(most - 1, 1)))
    some = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.when(F.lit(most > 1) & (i == most - 1), n - 1).otherwise(F.floor(i * step)).cast("long")))
    return F.when(n <= most, F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)).otherwise(some)


def issue_times(events: DataFrame, most: int = 48) -> DataFrame:
    """(event_id, issue_s): full hours from 45 minutes after start_s, and not before seed_available_s if there is one, to
    6 hours after end_s or before archive_end_s, whichever is first; at most `most`, evenly spaced, without regard to
    what follows them. An event without room has no row."""
    if most < 1:
        raise ValueError("at least one issue time is needed")
    first = _ceil_hour(F.greatest(F.col("start_s") + DELAY_S, F.col("seed_available_s")))
    last = F.least(_ceil_hour(F.col("end_s") + TAIL_H * HOUR), F.col("archive_end_s") - max(HORIZONS) * HOUR)
    rows = events.select("event_id", first.alias("first"), (F.floor((last - first) / HOUR) + 1).alias("n")).filter("n > 0")
    return rows.select("event_id", "first", F.explode(_spaced(F.col("n"), most)).alias("k")).select("event_id", (F.col("first") + F.col("k") * HOUR).alias("issue_s"))


def thinned(rows: DataFrame, by: str, order: str, most: int) -> DataFrame:
    """At most `most` rows of each group, evenly spaced in order (a sampling operator)."""
    w = Window.partitionBy(by)
    placed = rows.withColumns({"place_": F.row_number().over(w.orderBy(order)) - 1, "of_": F.count("*").over(w)})
    return placed.filter(F.array_contains(_spaced(F.col("of_"), most), F.col("place_").cast("long"))).drop("place_", "of_")


def horizon_labels(flags: DataFrame, issues: DataFrame, step_s: int = 600) -> DataFrame:
    """(cell, issue_s, fire_1, known_1, ... for each of HORIZONS): whether a cell burns in the first h hours after a full
    hour, and whether that is known: fire at some scan (flag 1 or 2), or clear (0) at every one that is due. A scan that
    comes more than once is one scan, and clear only if all its rows say so.

    Issues meet scans by the hour in an equality join, so a scan is used by six issues at most.
    """
    asked = issues.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(max(HORIZONS) - 1)))).withColumn("hour", F.col("issue_s") / HOUR + F.col("k"))
    # one row a scan, so that neither repeats nor a row without a time can stand in for one that is missing
    scans = flags.groupBy("cell", "scan_s").agg(F.bool_or(F.col("flag").isin(1, 2)).alias("fire"), F.bool_and(F.coalesce(F.col("flag") == 0, F.lit(False))).alias("clear")).filter("scan_s is not null")
    met = scans.withColumn("hour", F.floor(F.col("scan_s") / HOUR).cast("double")).join(asked, "hour")
    out = []
    for h in HORIZONS:
        in_h, due = F.col("k") < h, F.col("scan_s") % step_s == 0
        burns = F.coalesce(F.bool_or(F.when(in_h, F.col("fire"))), F.lit(False))
        out += [burns.alias(f"fire_{h}"), (burns | (F.count_if(in_h & due & F.col("clear")) == h * HOUR // step_s)).alias(f"known_{h}")]
    return met.groupBy("cell", "issue_s").agg(*out)


BIN_S, BINS, SCANS_A_BIN = 1800, 6, 3


def input_bins(scans: DataFrame, issues: DataFrame) -> DataFrame:
    """(cell, issue_s, recent_fire, and for each of the six half hours before a full hour, oldest first: fire_k,
    observable_k, frp_k, measured_k) from scans (cell, scan_s, available_s, flag, frp: summed power, n_frp: how many).

    Only scans that were available by the issue count. fire and observable are shares of the three scans of a bin, so a
    scan that lacks counts as not observable; frp is log1p(power / 3) / 5. recent_fire is the last observable scan's
    state, 0 if none. A cell without any scan in those three hours has no row. Scans meet issues by the hour in an equality
    join, so a scan is used by three issues at most, and only partial sums are shuffled by cell.
    """
    hours = BIN_S * BINS // HOUR
    asked = issues.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(hours)))).select("issue_s", (F.col("issue_s") / HOUR - F.col("k")).alias("hour"))
    met = scans.withColumn("hour", F.floor(F.col("scan_s") / HOUR).cast("double")).join(asked, "hour")
    fire, seen, ready = F.col("flag").isin(1, 2), F.col("flag").isin(0, 1, 2), F.col("available_s") <= F.col("issue_s")
    place = F.floor((F.col("scan_s") - F.col("issue_s")) / BIN_S) + BINS
    out = [F.coalesce(F.max(F.when(ready & seen, F.struct("scan_s", fire.alias("fire"))))["fire"].cast("double"), F.lit(0.0)).alias("recent_fire")]
    for k in range(BINS):
        use = ready & (place == k)
        out += [
            (F.count_if(use & fire) / SCANS_A_BIN).alias(f"fire_{k}"),
            (F.count_if(use & seen) / SCANS_A_BIN).alias(f"observable_{k}"),
            (F.log1p(F.coalesce(F.sum(F.when(use, F.col("frp"))), F.lit(0.0)) / 3) / 5).alias(f"frp_{k}"),
            (F.coalesce(F.sum(F.when(use, F.col("n_frp"))), F.lit(0)) / SCANS_A_BIN).alias(f"measured_{k}"),
        ]
    return met.groupBy("cell", "issue_s").agg(*out)


def grid_sums(points: DataFrame) -> DataFrame:
    """(row, col, frp, detections): power above 0 and finite is summed, all detections count."""
    f = F.col("frp")
    return points.groupBy("row", "col").agg(F.coalesce(F.sum(F.when((f > 0) & (f < float("inf")) & ~F.isnan(f), f)), F.lit(0.0)).alias("frp"), F.count("*").alias("detections"))


def sample_stats(samples: DataFrame, value: str, by: str) -> DataFrame:
    """Per group: how many, how many above 0, median, 90th percentile and largest."""
    v = F.col(value)
    counts = samples.groupBy(by).agg(F.count("*").alias("n"), F.count_if(v > 0).alias("positive"), F.max(v).alias("largest"))
    q = quantiles(samples, [by], value, [0.5, 0.9], Scratch(samples.sparkSession, "stats")).select(F.col(by).alias("g_"), "q0", "q1")
    return counts.join(q, F.col(by).eqNullSafe(F.col("g_"))).select(by, "n", "positive", F.col("q0").alias("p50"), F.col("q1").alias("p90"), "largest")


def offsets(cells: DataFrame, by: str) -> DataFrame:
    """cells (by, lon, lat, fire) with east, north, distance from the fire's weighted centre, in 50 km, and has_fire; all
    are 0 where nothing burns."""
    w = Window.partitionBy(by)
    total = F.sum("fire").over(w)
    x, y = F.sum(F.col("fire") * F.col("lon")).over(w) / total, F.sum(F.col("fire") * F.col("lat")).over(w) / total
    east, north = (F.col("lon") - x) * 111.32 * F.cos(F.radians("lat")) / 50, (F.col("lat") - y) * 110.54 / 50
    ok = total > 0
    return cells.select("*", *[F.when(ok, c).otherwise(0.0).alias(n) for c, n in ((east, "east"), (north, "north"), (F.hypot(east, north), "distance"), (F.lit(1.0), "has_fire"))])


def nearness(cells: DataFrame, by: str) -> DataFrame:
    """(by, row, col, score): exp(-d / 2), d the distance in cells to the nearest active one; 0 if none is."""
    return distances(cells, by).select(by, "row", "col", F.coalesce(F.exp(-F.col("distance") / 2), F.lit(0.0)).alias("score"))


def novelty(cells: DataFrame) -> DataFrame:
    """cells (observable, fire: arrays of six bins' fractions, old) with known, past, latest_clear, no_past_detection."""
    known, past = F.array_max("observable") > 0, F.array_max("fire") > 0
    return cells.withColumns({"known": known, "past": past, "latest_clear": known & (F.col("old") == 0), "no_past_detection": known & ~past})


def rolling_issues(clusters: DataFrame, step_s: int = HOUR, horizons: tuple[int, ...] = (1, 3, 6, 12)) -> DataFrame:
    """(cluster_id, issue_s, horizon_h, from_s, to_s): an issue every step from first_s to last_s, each with an hour's
    target around its horizon."""
    at = clusters.withColumn("issue_s", F.explode(F.sequence("first_s", "last_s", F.lit(step_s).cast("long"))))
    h = at.withColumn("horizon_h", F.explode(F.array(*[F.lit(x) for x in horizons])))
    mid = F.col("issue_s") + F.col("horizon_h") * HOUR
    return h.select("cluster_id", "issue_s", "horizon_h", (mid - HOUR // 2).alias("from_s"), (mid + HOUR // 2).alias("to_s"))


def hour_features(at_s: Column, frp: Column) -> list[Column]:
    """log1p(frp / 3) / 5 and the hour of the day on a circle."""
    turn = 2 * 3.141592653589793 * (F.pmod(at_s, F.lit(86400)) / 86400)
    return [(F.log1p(frp / 3) / 5).alias("frp_feature"), F.sin(turn).alias("hour_sin"), F.cos(turn).alias("hour_cos")]
