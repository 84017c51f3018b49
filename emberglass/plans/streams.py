"""Queries that run a table through a stream to its end and return what the sink holds."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberglass.plans.base import Book
from emberglass.storage import Scratch
from emberglass.streaming import state
from emberglass.streaming.ledger import Ledger

book = Book()


@book.add("""WITH s AS (SELECT event_id % 50 AS cell, event_id // 50 * 600 AS scan_s, CASE WHEN event_id * 7 % 11 < 6 THEN CAST(event_id * 7 % 11 AS INTEGER) END AS flag FROM events)
SELECT cell, scan_s, flag, last_value(CASE WHEN flag IN (0, 1, 2) THEN flag > 0 END IGNORE NULLS) OVER (PARTITION BY cell ORDER BY scan_s) AS state FROM s""")
def stream_carry_state(spark, table):
    state.with_store(spark)
    scratch, k = Scratch(spark, "stream"), F.col("event_id")
    scan = (F.floor(k / 50) * 600).cast("long")
    scans = table.stream("events").select((k % 50).alias("cell"), scan.alias("scan_s"), (scan + 900 + k % 7 * 100).alias("available_s"), F.when(k * 7 % 11 < 6, (k * 7 % 11).cast("int")).alias("flag"))
    said = scratch.path("said")

    def keep(rows, n: int) -> None:
        rows.write.mode("overwrite").parquet(f"{said}/batch={n}")

    state.carried(scans).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", scratch.path("check")).trigger(availableNow=True).start().awaitTermination()
    return state.latest(spark.read.schema(state.OUT).parquet(said))


@book.add("SELECT min(o_orderkey) AS seq, o_custkey % 50 AS cursor_s, o_orderstatus AS fingerprint, o_orderpriority AS pocket FROM orders GROUP BY ALL")
def stream_ledger(spark, table):
    scratch = Scratch(spark, "ledger")
    entries = table.stream("orders").select(F.col("o_orderkey").alias("seq"), (F.col("o_custkey") % 50).alias("cursor_s"), F.col("o_orderstatus").alias("fingerprint"), F.col("o_orderpriority").alias("pocket"), F.lit(None).cast("string").alias("payload"))
    book_ = Ledger(spark, scratch.path("ledger"))
    book_.sink(entries, scratch.path("check")).awaitTermination()
    return book_.entries().select("seq", "cursor_s", "fingerprint", "pocket")
