"""Mixing sources to target weights by capped water-filling, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberglass.llm.text import WORDS

#: Hex digits of a document's seeded hash that name its bucket: 4096 buckets of each source are summed on their own.
BUCKET_DIGITS = 3


def n_words(text: str | Column) -> Column:
    """Words of a text; a null has none."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: Sequence[float], share: float, max_epochs: float) -> DataFrame:
    """(source, source_size) with target: the words to take of each source, in one pass over the sorted sources.

    Source i gets min(max_epochs * source_size, level * weight). The level at which the targets add up to share of all
    sizes is where clamping sources and sharing their excess by weight ends: sources are clamped in the order of
    cap / weight, so the level is the first (budget - caps before) / (weights from here on) that is not above the cap
    / weight of its own row. If the caps cannot hold the budget, all are clamped.
    """
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    rows = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (nth % len(weights) + 1).cast("int")))
    rows = rows.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs))).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, onward = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    budget = F.sum("source_size").over(everything) * F.lit(float(share))
    rows = rows.withColumn("level", (budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward))
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything)["level"]
    return rows.select("source", "source_size", F.least("cap", F.coalesce(level, F.lit(float("inf"))) * F.col("weight")).alias("target"))


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", size_col: str | None = None) -> DataFrame:
    """Rows (row, size, source_size, target, copies) for every row of docs; row holds all its columns as a struct.

    A document is repeated the whole part of its source's epochs (target / source_size) and once more if it stands, in
    the source's seeded order, before the point at which the rest of the target is reached; it counts as before if its
    middle is. So a source's words meet its target within half a document. The order is that of md5(seed, id), then id
    and size: reruns agree. It is summed in 4096 buckets of each source, so a hot source is spread over as many tasks.

    Sizes are the words of text_col, or what size_col holds.

    Null texts and texts without words have size 0 and are repeated like any other. Null sources are one source, last.
    Repeated rows are documents of their own. An empty table gives no rows.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")).alias("k")
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))).alias("h")
    size = F.coalesce(F.col(size_col).cast("long"), F.lit(0)) if size_col else n_words(F.col(text_col).cast("string"))
    base = docs.select(F.struct("*").alias("row"), key, F.col(source_col).cast("string").alias("source"), F.col(id_col).alias("id"), size.alias("size"), digest)
    base = base.withColumn("b", F.substring("h", 1, BUCKET_DIGITS))
    buckets = base.groupBy("k", "source", "b").agg(F.sum("size").alias("size"))
    goal = targets(buckets.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, max_epochs)
    goal = goal.withColumn("k", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    before = Window.partitionBy("k").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select("k", "b", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset")).join(goal.drop("source"), "k")
    rows = base.drop("source").join(buckets, ["k", "b"])
    running = F.sum("size").over(Window.partitionBy("k", "b").orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("middle", F.col("offset") + running - F.col("size") / 2)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.col("target") - whole * F.col("source_size")
    copies = whole + (F.col("middle") < rest).cast("long")
    return rows.select("row", "size", "source_size", "target", copies.alias("copies"))
