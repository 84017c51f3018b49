"""Fires from a live interface, or, where that fails, from a pinned capture, saying so."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberglass.sources.pages import TIME_FIELD, register
from emberglass.storage import Scratch

#: Seconds that a day of a collection may take.
DEADLINE_S = 8.0


def live(spark: SparkSession, from_s: int, to_s: int, transport: str, **options) -> DataFrame:
    """(collection, id, at_s, geometry, properties) of hotspots, clusters and perimeters in [from_s, to_s), read at once: a
    task a day and collection. Further options are the source's own."""
    register(spark)
    given = {"deadline_s": DEADLINE_S} | options

    def one(collection: str) -> DataFrame:
        reader = spark.read.format("features").options(collection=collection, from_s=from_s, to_s=to_s, transport=transport, **given)
        return reader.load().select(F.lit(collection).alias("collection"), "*")

    return reduce(DataFrame.unionByName, [one(c) for c in TIME_FIELD])


def chosen(spark: SparkSession, first: Callable[[], DataFrame], pinned: Callable[[], DataFrame]) -> DataFrame:
    """What first gives, with source `live`; if it fails, what pinned gives, with source `replay` and the reason.

    Rows are written to the shared folder before the choice, so that a failure in any task counts, and the answer is of one
    source whole. If pinned fails too, its error is the caller's.
    """
    scratch = Scratch(spark, "fires")
    try:
        return scratch.save(first(), "live").select("*", F.lit("live").alias("source_used"), F.lit(None).cast("string").alias("fallback_reason"))
    except Exception as e:  # whatever the interface does wrong
        reason = str(e).strip().splitlines()[0][:200] if str(e).strip() else type(e).__name__
        return scratch.save(pinned(), "replay").select("*", F.lit("replay").alias("source_used"), F.lit(reason).alias("fallback_reason"))
