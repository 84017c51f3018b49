"""All queries over the driver's tables, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from emberglass.plans import events, measures, more, named, relational, roads, scoring, shapes, spatial, streams

BOOKS = [events.book, spatial.book, shapes.book, more.book, measures.book, scoring.book, roads.book, streams.book, named.book, relational.book]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for book in BOOKS for name, f in book.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for book in BOOKS for name, sql in book.sql.items()}
