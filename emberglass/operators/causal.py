"""What was known when: availability times, snapshots at a cursor, timelines and as-of picks. Times are in seconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberglass.constants import DEFAULT_LATENCY_S, LATENCY_S, lookup
from emberglass.storage import Scratch


def with_availability(det: DataFrame, recorded: str | None = None) -> DataFrame:
    """Adds latency_s and available_s. A recorded time before the observation is no time at all (null); without one the
    source's latency counts from the observation."""
    latency = lookup(LATENCY_S, F.col("source"), DEFAULT_LATENCY_S)
    out = det.withColumn("latency_s", latency)
    derived = F.col("at_s") + F.col("latency_s")
    if recorded is None:
        return out.withColumn("available_s", derived)
    r = F.col(recorded)
    return out.withColumn("available_s", F.when(r.isNull(), derived).when(r >= F.col("at_s"), r))


def snapshot(det: DataFrame, cursor_s: int) -> DataFrame:
    """Clusters as they could be known at the cursor, everything recomputed from the rows available by then."""
    seen = det.filter(F.col("available_s") <= cursor_s)
    return seen.groupBy("cluster_id").agg(
        F.count("*").alias("n"), F.sum("frp").alias("total_frp"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"),
        F.min("at_s").alias("first_s"), F.max("at_s").alias("last_s"),
    )


#: Cursors of one call: their table is broadcast.
MOST_CURSORS = 100_000


def cumulative_snapshots(det: DataFrame, cursors: DataFrame, bucket_s: int = 86400) -> DataFrame:
    """(cluster_id, cursor_s, n, total_frp) at every cursor of a small regular grid.

    Rows are summed by the cursor that first sees them and the sums run on along the cursors, so nothing is repeated
    for the cursors after it. cursors: one column cursor_s, multiples of bucket_s, at most MOST_CURSORS of them.
    """
    if cursors.limit(MOST_CURSORS + 1).count() > MOST_CURSORS:
        raise ValueError(f"more than {MOST_CURSORS} cursors")
    first = (F.ceil(F.col("available_s") / bucket_s) * bucket_s).cast("long")
    steps = det.groupBy("cluster_id", first.alias("cursor_s")).agg(F.count("*").alias("k"), F.sum("frp").alias("f"))
    # a cluster's own steps meet the shared cursors; the grid has clusters x cursors rows, as the result has
    grid = det.select("cluster_id").distinct().crossJoin(F.broadcast(cursors))
    w = Window.partitionBy("cluster_id").orderBy("cursor_s").rowsBetween(Window.unboundedPreceding, 0)
    out = grid.join(steps, ["cluster_id", "cursor_s"], "left").withColumns({"n": F.sum("k").over(w), "total_frp": F.sum("f").over(w)})
    return out.filter("n is not null").select("cluster_id", "cursor_s", "n", "total_frp")


def timeline(det: DataFrame, start_s: int | None = None, end_s: int | None = None) -> DataFrame:
    """One row: start, end and the sorted distinct frames within, start and end included."""
    lo = F.lit(start_s) if start_s is not None else F.min("available_s")
    hi = F.lit(end_s) if end_s is not None else F.max("available_s")
    return det.agg(lo.cast("long").alias("start_s"), hi.cast("long").alias("end_s"), F.array_sort(F.collect_set("available_s")).alias("f")).select(
        "start_s", "end_s", (F.col("end_s") - F.col("start_s")).alias("duration_s"),
        F.array_sort(F.array_distinct(F.array_union(F.filter("f", lambda x: x.between(F.col("start_s"), F.col("end_s"))), F.array("start_s", "end_s")))).alias("frames"),
    )


def timeline_frames(det: DataFrame, start_s: int | None = None, end_s: int | None = None) -> DataFrame:
    """The frames of timeline() as rows (frame_s), each once, in no order: the distinct times within, start and end
    included. Nothing without a time, unless start and end are both given."""
    within = det.select(F.col("available_s").cast("long").alias("frame_s")).filter("frame_s is not null")
    ends = within.agg(F.min("frame_s").alias("lo"), F.max("frame_s").alias("hi"))  # one row
    ends = ends.select(F.lit(start_s).cast("long").alias("lo") if start_s is not None else "lo", F.lit(end_s).cast("long").alias("hi") if end_s is not None else "hi")
    for bound, sign in ((start_s, ">="), (end_s, "<=")):
        within = within if bound is None else within.filter(f"frame_s {sign} {int(bound)}")
    return within.union(ends.select(F.explode(F.array("lo", "hi")))).filter("frame_s is not null").distinct()


def timeline_origin(det: DataFrame, from_s: int | None = None) -> DataFrame:
    """One row: origin_s, where a window starts or, if it doesn't say, the earliest at_s; null without either."""
    return det.agg(F.coalesce(F.lit(from_s).cast("long"), F.min("at_s")).alias("origin_s"))


#: As-of picks run over buckets of seconds (about an hour), and these over spans (about a year), as powers of two; times lie
#: within 2**38 seconds of the origin, which is past the year 9999.
BUCKET_BITS, SPAN_BITS, TIME_BITS = 12, 25, 38


def asof(frames: DataFrame, cursors: DataFrame, by: str | None = None) -> DataFrame:
    """cursors (cursor_s) with the latest frame (frame_s, payload) not after each; before the first frame the first.

    by names a column to do it within. Of frames at one second that with the largest payload counts. Without any frame
    there are no rows; repeated cursors keep their number; a cursor without a time has none before it.

    Frames and cursors are counted down to one row a second first. Each bucket's last frame is then carried on over the
    buckets of its span, each span's over the spans, and only within its own bucket is a cursor compared with frames. So
    every window holds a few thousand rows at most, however many rows or however few groups there are.
    """
    part = [by] if by else []
    told = lambda t: F.when(F.abs(t) < 2**TIME_BITS, t).when(t.isNotNull(), F.raise_error(F.lit("a time is out of range")).cast("long"))
    f = frames.filter("frame_s is not null").groupBy(*part, F.col("frame_s").alias("t")).agg(F.max(F.struct("frame_s", "payload")).alias("f"))
    c = cursors.select(*part, F.col("cursor_s").alias("t")).filter("t is not null").distinct()
    both = f.withColumn("asked", F.lit(False)).unionByName(c.withColumn("asked", F.lit(True)), allowMissingColumns=True)
    both = both.withColumn("u", told(F.col("t")) + F.lit(2**TIME_BITS))
    keyed = both.withColumns({"bucket": F.shiftright("u", BUCKET_BITS), "span": F.shiftright("u", SPAN_BITS), "all": F.shiftright("u", TIME_BITS + 1)})
    keyed = Scratch(frames.sparkSession, "asof").save(keyed, "seconds")  # three readers follow; both sides are read once
    buckets = keyed.groupBy(*part, "all", "span", "bucket").agg(F.max("f").alias("last"), F.min("f").alias("first"))
    spans = buckets.groupBy(*part, "all", "span").agg(F.max("last").alias("last"), F.min("first").alias("first"))

    def before(keys: list[str], order: str):
        return F.max("last").over(Window.partitionBy(*part, *keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))

    whole = Window.partitionBy(*part, "all")
    spans = spans.select(*part, "span", before(["all"], "span").alias("of_span"), F.min("first").over(whole).alias("first"))
    buckets = buckets.select(*part, "span", "bucket", before(["span"], "bucket").alias("of_bucket"))
    carried = buckets.join(spans, [*part, "span"]).select(*part, "bucket", F.coalesce("of_bucket", "of_span").alias("carried"), "first")
    w = Window.partitionBy(*part, "bucket").orderBy("t", "asked").rowsBetween(Window.unboundedPreceding, 0)
    near = keyed.select(*part, "bucket", "t", "asked", F.last("f", ignorenulls=True).over(w).alias("own")).filter("asked")
    hit = near.join(carried, [*part, "bucket"]).select(*part, F.col("t").alias("cursor_s"), F.coalesce("own", "carried", "first").alias("hit"))
    hit = hit.filter("hit is not null").select(*part, "cursor_s", F.col("hit.frame_s").alias("frame_s"), F.col("hit.payload").alias("payload"))
    return cursors.select(*part, "cursor_s").join(hit, [*part, "cursor_s"]).select(*part, "cursor_s", "frame_s", "payload")


def known_cut(cut: Column, latency: Column, cursor_s: int) -> Column:
    """A cut counts once its first evidence could have been delivered; else it is not known (null)."""
    return F.when(cut + latency <= cursor_s, cut)


def carry_state(flags: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Adds state: the last observable flag's meaning (1 or 2 is fire, 0 is none); what can't be seen keeps it."""
    seen = F.when(F.col("flag").isin(0, 1, 2), F.col("flag").isin(1, 2))
    return flags.withColumn("state", F.last(seen, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
