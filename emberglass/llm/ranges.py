"""Rows in ascending ranges of a key, one task each."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame


def in_order(df: DataFrame, key: str, *ties: str, per_range: int = 8192) -> DataFrame:
    """df in one shuffle, so that each partition is sorted and follows the one before it; nulls first.

    Equal keys share a partition. A partition has about per_range rows.
    """
    n = max(1, math.ceil(df.count() / per_range))
    return df.repartitionByRange(n, key).sortWithinPartitions(key, *ties)
