"""Exact quantiles and average precision of groups of any size: no task holds a group.

A quantile is found by narrowing a range of values: a histogram of the range says in which of its bins the wanted rank
falls, and the values of that bin are the next range. Sums along an order are taken in ranges of it: each range's sum is
carried to the next ones, and only within a range are rows followed one by one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberglass.storage import Scratch

#: Values that a task may sort, bins of a range, and groups above that size whose bounds are broadcast.
SMALL, BINS, BROADCAST_GROUPS = 100_000, 4096, 100_000
INF = float("inf")


def quantiles(rows: DataFrame, by: Sequence[str], value: Column | str, qs: Sequence[float], scratch: Scratch) -> DataFrame:
    """(by, n, and for each of qs a column q0, q1, ...): of each group the exact quantiles, linear between values.

    Nulls, NaN and infinite values are left out and not counted in n; a group without values has n 0 and nulls. With no
    columns in by there is one row, for no rows too. Null keys are a group.

    Groups of up to SMALL values are sorted where their counts meet. Larger ones, of which there are few, are narrowed by a
    round of histograms after the other over the values that are still in question.
    """
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    keyed = rows.select(F.struct(*by).alias("g") if by else F.lit(0).alias("g"), F.when(~F.isnan(v) & (F.abs(v) < INF), v).alias("v"))
    known = scratch.save(keyed, "values")
    sizes = scratch.save(known.groupBy("g").agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")), "sizes")
    large = sizes.filter(F.col("n") > SMALL)
    n_large = large.count()
    small = known if not n_large else _with(known, large.select("g"), n_large, "left_anti")
    out = small.groupBy("g").agg(F.count("v").alias("n"), *[F.percentile("v", q).alias(f"q{k}") for k, q in enumerate(qs)])
    if n_large:
        out = out.unionByName(_narrowed(_with(known, large.select("g"), n_large, "left_semi"), large, n_large, qs, scratch))
    if by:
        return out.select(*[F.col("g")[c].alias(c) for c in by], "n", *[f"q{k}" for k in range(len(qs))])
    none = sizes.sparkSession.range(1).select(F.lit(0).alias("g"))  # one row, so that there is an answer without rows
    return none.join(out, "g", "left").select(F.coalesce("n", F.lit(0).cast("long")).alias("n"), *[f"q{k}" for k in range(len(qs))])


def _with(rows: DataFrame, groups: DataFrame, n: int, how: str) -> DataFrame:
    other = F.broadcast(groups) if n <= BROADCAST_GROUPS else groups
    return rows.alias("r").join(other.alias("o"), F.col("r.g").eqNullSafe(F.col("o.g")), how).select("r.*", *[c for c in groups.columns if c != "g" and how == "inner"])


def _narrowed(known: DataFrame, large: DataFrame, n_large: int, qs: Sequence[float], scratch: Scratch) -> DataFrame:
    known = scratch.save(known.filter("v is not null"), "large")
    place = [F.lit(float(q)) * (F.col("n") - 1) for q in qs]
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(x).cast("long"), F.ceil(x).cast("long")) for x in place])))
    wanted = scratch.save(large.select("g", F.explode(ranks).alias("rank"), "lo", "hi", F.lit(0).cast("long").alias("below"), F.col("n").alias("within")), "wanted")
    found = None
    while True:
        done = wanted.filter("lo = hi").select("g", "rank", F.col("lo").alias("v"))
        few = wanted.filter((F.col("lo") < F.col("hi")) & (F.col("within") <= SMALL))
        met = _with(known, few, n_large * 2 * len(qs), "inner").filter("v >= lo and v <= hi")
        sorted_ = met.groupBy("g", "rank").agg(F.array_sort(F.collect_list("v")).alias("vs"), F.first("below").alias("below"))  # SMALL values
        done = scratch.save(done.union(sorted_.select("g", "rank", F.get("vs", (F.col("rank") - F.col("below")).cast("int")))), "done")
        found = done if found is None else found.union(done)
        many = wanted.filter((F.col("lo") < F.col("hi")) & (F.col("within") > SMALL))
        if many.isEmpty():
            break
        # halves, so that the width of any range is finite
        share = (F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
        bin_ = F.least(F.lit(BINS - 1), F.floor(share * BINS)).cast("int")
        met = _with(known, many, n_large * 2 * len(qs), "inner").filter("v >= lo and v <= hi")
        bins = met.groupBy("g", "rank", "below", bin_.alias("bin")).agg(F.count("*").alias("within"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        up_to = F.sum("within").over(Window.partitionBy("g", "rank").orderBy("bin"))
        bins = bins.withColumn("below", F.col("below") + up_to - F.col("within")).filter("below <= rank and rank < below + within")
        wanted = scratch.save(bins.select("g", "rank", "lo", "hi", "below", "within"), "wanted")
    at = found.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at"))  # two a quantile
    sized = large.select("g", "n").alias("s").join(at.alias("a"), F.col("s.g").eqNullSafe(F.col("a.g"))).select("s.g", "s.n", "a.at")

    def one(x: Column) -> Column:
        low, high = F.element_at("at", F.floor(x).cast("long")), F.element_at("at", F.ceil(x).cast("long"))
        return low + (high - low) * (x - F.floor(x))

    return sized.select("g", "n", *[one(x).alias(f"q{k}") for k, x in enumerate(place)])


def running(rows: DataFrame, keys: Sequence[str], order: Column, sums: Sequence[str], scratch: Scratch) -> DataFrame:
    """rows with a column `name_` for each of sums: its sum over the group's rows up to each, in ascending order.

    Rows are dealt by ranges of (keys, order), so a group lies in as many as it needs. A range's sums go to the group's
    later ranges by a window over sums alone. Orders should differ within a group: of equal ones any may come first. Null
    keys are a group; null orders come first.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.withColumn("_at", order)
    placed = scratch.save(placed.repartitionByRange(n, *keys, "_at").withColumn("_part", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy(*keys, "_part").agg(*[F.sum(c).alias(c) for c in sums])
    parts = parts.select(*keys, "_part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in sums])
    within = Window.partitionBy(*keys, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    own = placed.select("*", *[F.sum(c).over(within).alias(f"{c}_own") for c in sums])
    same = F.col("r._part") == F.col("p._part")
    for c in keys:
        same = same & F.col(f"r.{c}").eqNullSafe(F.col(f"p.{c}"))
    met = own.alias("r").join(parts.alias("p"), same)
    return met.select(*[F.col(f"r.{c}").alias(c) for c in rows.columns], *[(F.col(f"r.{c}_own") + F.col(f"p.{c}_before")).alias(f"{c}_") for c in sums])
