"""Checks that sets are what they should be: separate roles, equal coverage, no duplicates, every id known."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def separation(events: DataFrame, size: int = 64) -> DataFrame:
    """(a, b, shared_groups, overlaps) for every two roles that meet: groups in both, and events of a whose size x size
    patch overlaps one of b. Reserved events aside. Patches meet in cells of that size."""
    e = events.filter("role <> 'reserved'")
    g = e.select("role", "spatial_group").distinct()
    pair = lambda x, y, on: x.join(y, on).filter(F.col("a") < F.col("b"))
    shared = pair(g.withColumnRenamed("role", "a"), g.withColumnRenamed("role", "b"), "spatial_group").groupBy("a", "b").agg(F.count("*").alias("shared_groups"))
    cell = lambda c, k=0: F.floor(F.col(c) / size).cast("long") + k
    near = F.explode(F.array(*[F.struct(cell("seed_row", i).alias("r"), cell("seed_col", j).alias("c")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    x = e.select(F.col("role").alias("a"), "event_id", F.col("seed_row").alias("ar"), F.col("seed_col").alias("ac"), near.alias("cell"))
    y = e.select(F.col("role").alias("b"), F.col("seed_row").alias("br"), F.col("seed_col").alias("bc"), F.struct(cell("seed_row").alias("r"), cell("seed_col").alias("c")).alias("cell"))
    met = pair(x, y, "cell").filter((F.abs(F.col("ar") - F.col("br")) < size) & (F.abs(F.col("ac") - F.col("bc")) < size))
    over = met.groupBy("a", "b").agg(F.count_distinct("event_id").alias("overlaps"))
    return shared.join(over, ["a", "b"], "full").select("a", "b", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("shared_groups", "overlaps")])


def coverage(have: DataFrame, want: DataFrame, *keys: str) -> DataFrame:
    """One row: keys of want that have lacks, keys of have that want lacks, and keys that have holds more than once."""
    h = have.groupBy(*keys).agg(F.count("*").alias("h"))
    w = want.select(*keys).distinct().withColumn("w", F.lit(1))
    both = h.join(w, list(keys), "full")
    return both.agg(F.count_if(F.col("h").isNull()).alias("missing"), F.count_if(F.col("w").isNull()).alias("extra"), F.count_if(F.col("h") > 1).alias("repeated"))


def shared_ids(rows: DataFrame, role: str, key: str) -> DataFrame:
    """Keys that more than one role holds, with the roles."""
    g = rows.select(role, key).distinct().groupBy(key).agg(F.array_sort(F.collect_set(role)).alias("roles"))
    return g.filter(F.size("roles") > 1)


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with the same key the last in order."""
    return rows.withColumn("nth_", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).filter("nth_ = 1").drop("nth_")


def known_once(ids: DataFrame, places: DataFrame, key: str) -> DataFrame:
    """(key, fault): ids that places lacks, or that are named more than once. No row means that all are sound."""
    times = ids.groupBy(key).agg(F.count("*").alias("n"))
    lacking = times.join(places.select(key).distinct(), key, "left_anti").select(key, F.lit("unknown").alias("fault"))
    return lacking.union(times.filter("n > 1").select(key, F.lit("repeated").alias("fault")))
