"""The library's functions by name in SQL text, registered by one call.

Scalar functions are SQL functions whose bodies are the column expressions of this library, so a query that uses them stays
in generated code and is optimised as one. Table functions take any table: their analysis says by which columns it is
partitioned and ordered, and what it gains.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from decimal import Decimal

from pyspark.sql import Column, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, SkipRestOfInputTableException

from emberglass.constants import RINGS_KM
from emberglass.functions import geo
from emberglass.operators import normalize, spatial

RING = "ARRAY<STRUCT<lat: DOUBLE, lon: DOUBLE>>"
_PIECE = re.compile(r"(?P<text>'(?:[^'\\]|\\.|'')*')|(?P<operator>[-*+/%<>=!&|^~]+|\b(?:and|or|not)\b)\(|(?P<number>(?<![\w.])\d+\.\d+(?:E-?\d+)?)", re.IGNORECASE)


def text_of(column: Column) -> str:
    """A column expression as SQL: operators as the functions that they are, fractions as doubles and not decimals."""
    put = {"text": "{}", "operator": "`{}`(", "number": "{}D"}
    return _PIECE.sub(lambda m: put[m.lastgroup].format(m[m.lastgroup]), column._jc.node().sql())


def _cell(lat: Column, lon: Column, size: Column) -> Column:
    return F.struct(F.floor(lat / size).cast("long").alias("row"), F.floor(lon / size).cast("long").alias("col"))


#: name: (parameters and their types, result's type, expression of the parameters)
SCALARS: dict[str, tuple[list[tuple[str, str]], str, Callable[..., Column]]] = {
    "haversine_km": ([(x, "DOUBLE") for x in ("lat1", "lon1", "lat2", "lon2")], "DOUBLE", geo.haversine_km),
    "bearing_deg": ([(x, "DOUBLE") for x in ("lat1", "lon1", "lat2", "lon2")], "DOUBLE", geo.bearing_deg),
    "circular_error": ([("a", "DOUBLE"), ("b", "DOUBLE")], "DOUBLE", geo.circular_error),
    "compass": ([("bearing", "DOUBLE")], "STRING", geo.compass),
    "point_segment_m": ([(x, "DOUBLE") for x in ("lat", "lon", "lat1", "lon1", "lat2", "lon2")], "DOUBLE", geo.point_segment_m),
    "ring_area_km2": ([("ring", RING)], "DOUBLE", geo.ring_area_km2),
    "ring_is_closed": ([("ring", RING)], "BOOLEAN", geo.ring_is_closed),
    "in_ring": ([("lat", "DOUBLE"), ("lon", "DOUBLE"), ("ring", RING)], "BOOLEAN", geo.in_ring),
    "grid_cell": ([("lat", "DOUBLE"), ("lon", "DOUBLE"), ("size", "DOUBLE")], "STRUCT<row: BIGINT, col: BIGINT>", _cell),
    "ring_of": ([("distance_km", "DOUBLE"), ("inside", "BOOLEAN")], "STRING", spatial.ring_of),
    "frp_scale": ([("frp", "DOUBLE")], "DOUBLE", geo.frp_scale),
    "confidence_label": ([("confidence", "DOUBLE")], "STRING", geo.confidence_label),
    "confidence_of": ([("label", "STRING")], "DOUBLE", normalize.confidence),
}


def _named(argument: AnalyzeArgument | None, what: str) -> str:
    if argument is None or not isinstance(argument.value, str):
        raise ValueError(f"{what} must be a column's name")
    return argument.value


def _must_have(table: AnalyzeArgument, *columns: str) -> StructType:
    if not table.isTable:
        raise ValueError("the first argument must be a table")
    missing = [c for c in columns if c not in table.dataType.names]
    if missing:
        raise ValueError(f"the table has no column {', '.join(missing)}")
    return table.dataType


def _with(schema: StructType, *fields: tuple) -> StructType:
    out = StructType([f for f in schema.fields if f.name not in {name for name, _ in fields}])
    for name, kind in fields:
        out = out.add(name, kind)
    return out


class Sessions:
    """sessions(TABLE(t), key, at, gap): the table's rows with episode, which counts a key's runs from 0; a gap of more than
    gap ends a run. Rows without a time come first and are in no episode (null). A key's rows are read once, in order."""

    @staticmethod
    def analyze(table: AnalyzeArgument, key: AnalyzeArgument, at: AnalyzeArgument, gap: AnalyzeArgument) -> AnalyzeResult:
        by, time = _named(key, "key"), _named(at, "at")
        schema = _must_have(table, by, time)
        if not isinstance(gap.value, (int, float, Decimal)) or gap.value < 0:
            raise ValueError("gap must be a number, 0 or more")
        return AnalyzeResult(_with(schema, ("episode", LongType())), partitionBy=[PartitioningColumn(f"`{by}`")], orderBy=[OrderingColumn(f"`{time}`")])

    def __init__(self):
        self.last, self.episode = None, -1

    def eval(self, table: Row, key: str, at: str, gap: float) -> Iterator[tuple]:
        now = table[at]
        if now is not None:
            if self.last is None or now - self.last > float(gap):
                self.episode += 1
            self.last = now
        yield *(v for n, v in zip(table.__fields__, table) if n != "episode"), self.episode if now is not None else None


class Bands:
    """bands(TABLE(t), route, depart): of each route the earliest and the latest departure (null, if one is unbounded: null),
    and how many there are."""

    @staticmethod
    def analyze(table: AnalyzeArgument, route: AnalyzeArgument, depart: AnalyzeArgument) -> AnalyzeResult:
        by, when = _named(route, "route"), _named(depart, "depart")
        schema = _must_have(table, by, when)
        out = StructType().add(by, schema[by].dataType).add("earliest", DoubleType()).add("latest", DoubleType()).add("combos", LongType())
        return AnalyzeResult(out, partitionBy=[PartitioningColumn(f"`{by}`")])

    def __init__(self):
        self.route, self.n, self.low, self.high = None, 0, float("inf"), float("-inf")

    def eval(self, table: Row, route: str, depart: str) -> None:
        at = float("inf") if table[depart] is None else float(table[depart])
        self.route, self.n, self.low, self.high = table[route], self.n + 1, min(self.low, at), max(self.high, at)

    def terminate(self) -> Iterator[tuple]:
        finite = lambda x: x if abs(x) < float("inf") else None
        yield self.route, finite(self.low), finite(self.high), self.n


class NearestRings:
    """threat_rings(TABLE(t), id, distance): of each id the nearest row's distance and ring, and whether it is inside the
    widest ring; reads no further than a key's first row, which is the nearest."""

    @staticmethod
    def analyze(table: AnalyzeArgument, id: AnalyzeArgument, distance: AnalyzeArgument) -> AnalyzeResult:  # noqa: A002
        by, km = _named(id, "id"), _named(distance, "distance")
        schema = _must_have(table, by, km)
        out = StructType().add(by, schema[by].dataType).add("distance_km", DoubleType()).add("ring", StringType()).add("threatened", BooleanType())
        return AnalyzeResult(out, partitionBy=[PartitioningColumn(f"`{by}`")], orderBy=[OrderingColumn(f"`{km}`", overrideNullsFirst=False)])

    def __init__(self):
        self.done = False

    def eval(self, table: Row, id: str, distance: str) -> Iterator[tuple]:  # noqa: A002
        if self.done:
            raise SkipRestOfInputTableException("the nearest is known")
        self.done = True
        km = None if table[distance] is None else float(table[distance])
        ring = next((f"{int(r)}km" for r in RINGS_KM if km is not None and km <= r), None) if km is None or km > 0 else "inside"
        yield table[id], km, ring, ring is not None


def register(spark: SparkSession) -> list[str]:
    """Makes all functions known to the session as temporary ones and gives their names."""
    for name, (parameters, result, body) in SCALARS.items():
        given = ", ".join(f"{p} {kind}" for p, kind in parameters)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({given}) RETURNS {result} RETURN {text_of(body(*[F.col(p) for p, _ in parameters]))}")
    for name, table_function in (("sessions", Sessions), ("bands", Bands), ("threat_rings", NearestRings)):
        spark.udtf.register(name, F.udtf(table_function))
    return [*SCALARS, "sessions", "bands", "threat_rings"]
