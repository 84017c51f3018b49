"""A ledger that a stream appends to, each entry once, however often a micro-batch runs.

A batch's new entries are written as JSON lines into a folder of their own, then a commit names that folder. Only folders
that a commit names are read, so what a failed attempt left counts for nothing. A commit is made by a rename to a name that
says its batch: there is one for a batch or none.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberglass.operators.alerts import append_new
from emberglass.sources.files import LEDGER

MOST_BYTES = 16 * 1024 * 1024


class LedgerFull(RuntimeError):
    pass


class Ledger:
    """Entries (seq, cursor_s, fingerprint, pocket, payload) under a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, most_bytes: int = MOST_BYTES):
        self.spark, self.path, self.most_bytes = spark, path.rstrip("/"), most_bytes
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}")

    def _committed(self, batch: int) -> bool:
        return self._fs.exists(self._at(f"commits/{batch:020d}.json"))

    def commits(self) -> DataFrame:
        """(batch, segment, bytes), a row a batch."""
        schema = "batch long, segment string, bytes long"
        at = f"{self.path}/commits"
        return self.spark.read.schema(schema).json(f"{at}/*.json") if self._fs.exists(self._hadoop.Path(at)) else self.spark.createDataFrame([], schema)

    def _lines(self) -> DataFrame:
        at = f"{self.path}/segments"
        if not self._fs.exists(self._hadoop.Path(at)):
            return self.spark.createDataFrame([], "value string, segment string, batch long")
        raw = self.spark.read.schema("value string, segment string").text(at)
        return raw.join(self.commits().select("segment", "batch"), "segment")

    def entries(self, before: int | None = None) -> DataFrame:
        """Committed entries, of batches before one if it is given. Lines that cannot be read are left out."""
        lines = self._lines() if before is None else self._lines().filter(F.col("batch") < before)
        return lines.select(F.from_json("value", LEDGER).alias("e")).select("e.*").filter("seq is not null and cursor_s is not null and fingerprint is not null and pocket is not null")

    def unreadable(self) -> DataFrame:
        """One row: committed lines that are no entries, torn ones among them."""
        e = F.from_json("value", LEDGER)
        ok = e["seq"].isNotNull() & e["cursor_s"].isNotNull() & e["fingerprint"].isNotNull() & e["pocket"].isNotNull()
        return self._lines().agg(F.count_if(~ok & (F.trim("value") != "")).alias("unreadable"))

    def size(self, before: int | None = None) -> int:
        c = self.commits() if before is None else self.commits().filter(F.col("batch") < before)
        return c.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]

    def append(self, entries: DataFrame, batch: int) -> bool:
        """Adds what earlier batches lack by (cursor_s, fingerprint, pocket), of several the least seq; False if the batch is
        there already. A ledger of most_bytes or more takes nothing: LedgerFull, and the stream stops at this batch."""
        if self._committed(batch):
            return False
        if self.size(batch) >= self.most_bytes:
            raise LedgerFull(f"the ledger holds {self.most_bytes} bytes or more")
        segment = f"{batch}-{uuid.uuid4().hex}"
        folder = f"segments/segment={segment}"
        sound = entries.select(*[F.col(c.split()[0]) for c in LEDGER.split(", ")]).filter("seq is not null and cursor_s is not null and fingerprint is not null and pocket is not null")
        append_new(self.entries(batch), sound).write.json(f"{self.path}/{folder}")
        note = {"batch": batch, "segment": segment, "bytes": self._fs.getContentSummary(self._at(folder)).getLength()}
        self._commit(batch, json.dumps(note))
        return True

    def _commit(self, batch: int, text: str) -> None:
        draft, name = self._at(f"drafts/{uuid.uuid4().hex}"), self._at(f"commits/{batch:020d}.json")
        self._fs.mkdirs(name.getParent())
        out = self._fs.create(draft, True)
        out.write(text.encode())
        out.close()
        if not self._fs.rename(draft, name):
            self._fs.delete(draft, False)
            if not self._committed(batch):
                raise OSError(f"batch {batch} could not be committed")

    def sink(self, stream: DataFrame, checkpoint: str, **trigger):
        """Starts the stream into the ledger; trigger as of writeStream.trigger(), all there is now if none is named."""
        writer = stream.writeStream.foreachBatch(lambda rows, n: (self.append(rows, n), None)[1])
        return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
