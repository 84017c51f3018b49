"""Feature sources that answer in pages: one input partition per day, retries, and pushed time filters."""

from __future__ import annotations

import json
import time
import urllib.error
from collections.abc import Callable, Iterator, Sequence
from datetime import UTC, datetime
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, Filter, GreaterThanOrEqual, InputPartition, LessThan

PAGE, MOST_PAGES, ATTEMPTS = 1000, 200, 3
TIME_FIELD = {"hotspots": "observed_at", "clusters": "last_observed", "perimeters": "computed_at"}


def day_windows(ranges: DataFrame) -> DataFrame:
    """Half-open days (from_s, to_s) that cover each [from_s, to_s] range."""
    day = lambda c: F.floor(F.col(c) / 86400).cast("long")
    return ranges.select(F.explode(F.sequence(day("from_s"), day("to_s"))).alias("d")).select((F.col("d") * 86400).alias("from_s"), ((F.col("d") + 1) * 86400).alias("to_s"))


def features_of(body: str) -> list[dict]:
    """A collection's features; any other answer is an error, never empty."""
    found = json.loads(body)
    if not isinstance(found, dict) or found.get("type") != "FeatureCollection" or not isinstance(found.get("features"), list):
        raise ValueError("the answer is no FeatureCollection")
    return found["features"]


def retryable(e: Exception) -> bool:
    status = getattr(e, "code", None)
    return status >= 500 or status == 429 if isinstance(status, int) else isinstance(e, (TimeoutError, ConnectionError, TypeError, urllib.error.URLError))


def fetch(get: Callable[[str], str], url: str, wait: float = 0.5) -> list[dict]:
    for attempt in range(ATTEMPTS):
        try:
            return features_of(get(url))
        except Exception as e:
            if attempt == ATTEMPTS - 1 or not retryable(e):
                raise
            time.sleep(wait * 2**attempt)
    raise AssertionError


def all_pages(get: Callable[[str], str], path: str, wait: float = 0.5) -> Iterator[dict]:
    """Features page by page until a short page; more than MOST_PAGES pages are an error."""
    for k in range(MOST_PAGES):
        mark = "&" if "?" in path else "?"
        found = fetch(get, f"{path}{mark}limit={PAGE}&startIndex={k * PAGE}", wait)
        yield from found
        if len(found) < PAGE:
            return
    raise ValueError(f"more than {MOST_PAGES} pages")


def window_path(collection: str, start: str, end: str, bbox: Sequence[float]) -> str:
    field = TIME_FIELD[collection]
    box = ",".join(str(x) for x in bbox)
    return f"collections/{collection}/items?filter=BBOX({box}) AND {field} >= '{start}' AND {field} < '{end}' AND active = true"


def base_url(url: str, hosts: Sequence[str]) -> str:
    """The address, if it is https, names one of hosts, and has neither user, port, query nor fragment; else an error."""
    at = urlsplit(url)
    if at.scheme != "https" or at.hostname not in hosts or at.netloc != at.hostname or at.query or at.fragment:
        raise ValueError("the address is not that of a known host")
    return url.rstrip("/")


class Day(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


def days(start: int, end: int) -> list[Day]:
    first = start - start % 86400
    return [Day(max(d, start), min(d + 86400, end)) for d in range(first, end, 86400)]


def _named(name: str) -> Callable:
    """module:function"""
    import importlib

    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def rows_of(options: dict, day: Day) -> Iterator[tuple]:
    get = _named(options["transport"])
    path = f"{options['collection']}?from_s={day.start}&to_s={day.end}"
    if "bbox" in options:
        start, end = (datetime.fromtimestamp(t, UTC).strftime("%Y-%m-%dT%H:%M:%SZ") for t in (day.start, day.end))
        path = window_path(options["collection"], start, end, [float(x) for x in options["bbox"].split(",")])
    if "base_url" in options:
        path = f"{base_url(options['base_url'], options['hosts'].split(','))}/{path}"
    until = time.monotonic() + float(options["deadline_s"]) if "deadline_s" in options else None

    def timely(url: str) -> str:
        if until is not None and time.monotonic() > until:
            raise ValueError(f"{options['collection']} took longer than {options['deadline_s']} s")
        return get(url)

    for f in all_pages(timely, path, wait=float(options.get("wait", 0.5))):
        p = f.get("properties") or {}
        yield str(p.get("id") or f.get("id") or ""), p.get("at_s"), json.dumps(f.get("geometry")), json.dumps(p)


class FeatureReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.start, self.end = options, int(options["from_s"]), int(options["to_s"])

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds on at_s narrow the days that are asked for; they are checked again afterwards."""
        for f in filters:
            if isinstance(f, GreaterThanOrEqual) and f.attribute == ("at_s",):
                self.start = max(self.start, f.value)
            elif isinstance(f, LessThan) and f.attribute == ("at_s",):
                self.end = min(self.end, f.value)
            yield f

    def partitions(self) -> list[Day]:
        return days(self.start, self.end)

    def read(self, day: Day) -> Iterator[tuple]:
        return rows_of(self.options, day)


class FeatureStreamReader(DataSourceStreamReader):
    """Offsets are the second up to which a collection has been read. A batch is what lies between two of them, a partition
    a day: it can be read again and gives the same question, so a restart from any offset misses and repeats nothing."""

    def __init__(self, options: dict):
        self.options, self.start = options, int(options["from_s"])
        self.end = int(options["to_s"]) if "to_s" in options else None
        self.reached = self.start

    def initialOffset(self) -> dict:
        return {"at_s": self.start}

    def latestOffset(self) -> dict:
        """The last full step_s that lies lag_s back, never less than before."""
        now = int(_named(self.options["clock"])() if "clock" in self.options else time.time()) - int(self.options.get("lag_s", 0))
        step = int(self.options.get("step_s", 3600))
        at = now - now % step
        self.reached = max(self.reached, at if self.end is None else min(at, self.end))
        return {"at_s": self.reached}

    def partitions(self, start: dict, end: dict) -> list[Day]:
        self.reached = max(self.reached, end["at_s"])
        return days(start["at_s"], end["at_s"])

    def read(self, day: Day) -> Iterator[tuple]:
        return rows_of(self.options, day)

    def commit(self, end: dict) -> None:
        """The source keeps nothing for a reader, so there is nothing to let go."""


class FeatureSource(DataSource):
    """spark.read.format("features"): options collection, from_s, to_s, transport (module:function from path to body).

    With the option bbox (west,south,east,north) the box, the day's bounds and active features are asked for by the
    collection's filter; else the day's bounds alone by plain parameters. With base_url, which must name one of hosts, paths
    become addresses. A day that takes longer than deadline_s is an error.

    As a stream to_s may be missing: it follows clock (module:function, seconds; the machine's if none) lag_s behind, in
    steps of step_s.
    """

    @classmethod
    def name(cls) -> str:
        return "features"

    def schema(self) -> str:
        return "id string, at_s long, geometry string, properties string"

    def reader(self, schema) -> FeatureReader:
        return FeatureReader(dict(self.options))

    def streamReader(self, schema) -> FeatureStreamReader:
        return FeatureStreamReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the source known to the session, and lets it see filters."""
    spark.dataSource.register(FeatureSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
