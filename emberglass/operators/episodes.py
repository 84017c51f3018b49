"""Gap-split episodes, windows, labels, splits and purges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sessions(rows: DataFrame, keys: list[str], at: str, gap_s: int) -> DataFrame:
    """Adds episode: counts from 0 within the keys; a gap of more than gap_s starts the next."""
    w = Window.partitionBy(*keys).orderBy(at, *[c for c in rows.columns if c == "id"])
    gap = (F.col(at) - F.lag(at).over(w)) > gap_s
    return rows.withColumn("episode", F.sum(F.coalesce(gap.cast("long"), F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def catalogue(rows: DataFrame, keys: list[str], at: str, gap_s: int, least: int) -> DataFrame:
    """Episodes of at least so many rows: first, last, count, hours, and an id digested from the first row."""
    e = sessions(rows, keys, at, gap_s).groupBy(*keys, "episode").agg(F.min(at).alias("start_s"), F.max(at).alias("end_s"), F.count("*").alias("n"), F.min(F.struct(at, "id")).alias("seed"))
    digest = F.substring(F.sha2(F.concat_ws("|", *keys, F.col(f"seed.{at}"), F.col("seed.id")), 256), 1, 24)
    return e.filter(F.col("n") >= least).select(*keys, "episode", "start_s", "end_s", "n", ((F.col("end_s") - F.col("start_s")) / 3600).alias("hours"), digest.alias("event_id"))


def tumbling(rows: DataFrame, keys: list[str], at: str, width_s: int, *aggregates: Column) -> DataFrame:
    return rows.groupBy(*keys, (F.floor(F.col(at) / width_s) * width_s).cast("long").alias("bin_s")).agg(*aggregates)


def history_and_label(rows: DataFrame, keys: list[str], at: str, step_s: int = 3600, history_s: int = 10800, lead_s: int = 3600, horizon_s: int = 21600) -> DataFrame:
    """For each step with rows in it: counts before it (history), in it, and in the horizon after lead_s.

    Rows are counted by step first; all three are sums over ranges of the steps, in one window.
    """
    steps = rows.groupBy(*keys, (F.floor(F.col(at) / step_s) * step_s).cast("long").alias("t")).agg(F.count("*").alias("current"))
    w = Window.partitionBy(*keys).orderBy("t")
    history = F.sum("current").over(w.rangeBetween(-history_s, -step_s))
    label = F.sum("current").over(w.rangeBetween(lead_s, lead_s + horizon_s - step_s))
    return steps.withColumns({"history": F.coalesce(history, F.lit(0)), "label": F.coalesce(label, F.lit(0))})


def label_policy(flags: DataFrame, keys: list[str]) -> DataFrame:
    """positive if any flag is fire (1, 2); known if fire, or if all flags are clear (0)."""
    fire, clear = F.bool_or(F.col("flag").isin(1, 2)), F.bool_and(F.col("flag") == 0)
    return flags.groupBy(*keys).agg(fire.alias("positive"), (fire | clear).alias("known"), F.count("*").alias("scans"))


def persistent_cells(cells: DataFrame, least_days: int, day: str = "day") -> DataFrame:
    """(row, col) seen on so many different days, and the eight cells around each."""
    core = cells.groupBy("row", "col").agg(F.countDistinct(day).alias("days")).filter(F.col("days") >= least_days)
    around = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    return core.select("row", "col", F.explode(around).alias("o")).select((F.col("row") + F.col("o.a")).alias("row"), (F.col("col") + F.col("o.b")).alias("col")).distinct()


def split_bucket(group: Column, salt: str = "split-v1", n: int = 100) -> Column:
    """The number that the JSON list [salt, group] hashes to."""
    text = F.concat(F.lit(f'["{salt}", "'), group, F.lit('"]'))
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long") % n


def split_role(bucket: Column, start_s: Column, end_s: Column, train_before_s: int, validate_from_s: int, test_from_s: int) -> Column:
    return F.when((bucket < 70) & (end_s < train_before_s), "train").when((bucket >= 70) & (bucket < 85) & (start_s >= validate_from_s) & (end_s < test_from_s), "validation").when((bucket >= 85) & (start_s >= test_from_s), "test").otherwise("reserved")


def purge_overlaps(events: DataFrame, size: int = 64, order: tuple = (("calibration", ("test",)), ("selection", ("calibration", "test")), ("train", ("selection", "calibration", "test")))) -> DataFrame:
    """Events (event_id, row, col, role) whose size x size patch overlaps one of a role that goes before become reserved.

    Patches meet by cell of the same size in an equality join: such that overlap are in the same or a neighbouring cell.
    """
    at = lambda c: F.floor(F.col(c) / size).cast("long")
    for role, before in order:
        guard = events.filter(F.col("role").isin(*before)).select(F.col("row").alias("gr"), F.col("col").alias("gc")).distinct()
        near = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
        guard = guard.select("gr", "gc", near.alias("o")).select("gr", "gc", (at("gr") + F.col("o.a")).alias("kr"), (at("gc") + F.col("o.b")).alias("kc"))
        mine = events.filter(F.col("role") == role).withColumns({"kr": at("row"), "kc": at("col")})
        hit = (mine["kr"] == guard["kr"]) & (mine["kc"] == guard["kc"]) & (F.abs(F.col("row") - F.col("gr")) < size) & (F.abs(F.col("col") - F.col("gc")) < size)
        lost = mine.join(guard, hit, "left_semi").select("event_id", F.lit(True).alias("lost"))
        events = events.join(lost, "event_id", "left").withColumn("role", F.when(F.col("lost"), "reserved").otherwise(F.col("role"))).drop("lost")
    return events
