"""The last observable state of each cell as scans arrive, in any order, with corrections of what was said before."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What keyed state with timers needs of a session.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
OUT = "cell long, scan_s long, flag int, state boolean, revision long, late boolean"
_COLUMNS = ["cell", "scan_s", "flag", "state", "revision", "late"]


def with_store(spark: SparkSession) -> None:
    for k, v in STORE.items():
        spark.conf.set(k, v)


class Carry(StatefulProcessor):
    """State of a cell: its scans of the last keep_s seconds (flag and what was said of each), the state carried in from
    those before, and the number of its last revision. A timer lets scans go once the watermark has left them behind."""

    def __init__(self, keep_s: int):
        self.keep_s = keep_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.scans = handle.getMapState("scans", "scan_s long", "flag int, state boolean")
        self.base = handle.getValueState("base", "state boolean, before_s long")
        self.last = handle.getValueState("last", "revision long, timer_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        base, before = self.base.get() or (None, None)
        revision, timer = self.last.get() or (0, None)
        known = {k[0]: tuple(v) for k, v in self.scans.iterator()}
        said, late = dict(known), []
        for batch in rows:
            for scan, flag in zip(batch["scan_s"].tolist(), batch["flag"].tolist()):
                flag = None if pd.isna(flag) else int(flag)
                if before is not None and scan < before:
                    late.append((int(scan), flag))
                elif scan not in known or known[scan][0] != flag:
                    known[int(scan)] = (flag, None)
                    said.pop(scan, None)
        out, now = [], base
        for scan in sorted(known):
            flag = known[scan][0]
            now = flag in (1, 2) if flag in (0, 1, 2) else now
            if scan not in said or said[scan][1] != now:
                self.scans.updateValue((scan,), (flag, now))
                out.append((key[0], scan, flag, now, revision + 1, False))
        out += [(key[0], scan, flag, None, revision + 1, True) for scan, flag in late]
        self.last.update((revision + bool(out), self._timer(timer, min(known, default=None))))
        if out:
            yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        edge = timerValues.getCurrentWatermarkInMs() // 1000 - self.keep_s
        known = {k[0]: tuple(v) for k, v in self.scans.iterator()}
        gone = sorted(s for s in known if s < edge)
        if gone:
            self.base.update((known[gone[-1]][1], edge))
            for scan in gone:
                self.scans.removeKey((scan,))
        revision, _ = self.last.get() or (0, None)
        self.last.update((revision, self._timer(None, min((s for s in known if s >= edge), default=None))))
        yield from ()

    def _timer(self, at_ms: int | None, first_s: int | None) -> int | None:
        """One timer a cell, for its oldest scan."""
        if at_ms is not None or first_s is None:
            return at_ms
        at_ms = (first_s + self.keep_s + 1) * 1000
        self.handle.registerTimer(at_ms)
        return at_ms

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=_COLUMNS)
    return out.astype({"cell": "int64", "scan_s": "int64", "flag": "Int32", "state": "boolean", "revision": "int64", "late": "bool"})


def carried(scans: DataFrame, keep_s: int = 21_600, delay: str = "1 hour") -> DataFrame:
    """A stream (cell, scan_s, flag, state, revision, late) of what a stream of scans (cell, scan_s, available_s, flag) says
    of each cell: what carry_state() of causal.py gives for all scans so far, told again where a late scan changes it.

    The watermark follows the time of availability, not of observation, and a row that comes more than delay after others
    that became available later is lost. A cell's scans are kept
    until the watermark is keep_s past them, then only the state after them is. A scan that comes later still is passed on
    with late and no state. Of one scan's rows the last to come counts; rows without a cell or a scan time, or available before 1970,
    are left out.
    The session needs with_store(); take latest() of what the sink holds.
    """
    known = scans.filter("cell is not null and scan_s is not null").withColumn("available", F.timestamp_seconds("available_s")).withWatermark("available", delay)
    return known.groupBy("cell").transformWithStateInPandas(statefulProcessor=Carry(keep_s), outputStructType=OUT, outputMode="Update", timeMode="EventTime")


def latest(said: DataFrame) -> DataFrame:
    """Of all that was said the last word on each scan."""
    last = F.max_by(F.struct("flag", "state"), "revision").alias("v")
    return said.filter("not late").groupBy("cell", "scan_s").agg(last).select("cell", "scan_s", "v.flag", "v.state")
