"""Text pieces that several operators share. Words are runs of anything but space and the bytes 09-0D."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: The same words as a pattern, for SQL.
WORDS = r"[^\x20\x09-\x0D]+"


def words(text: bytes) -> list[bytes]:
    """Words of UTF-8 text with A-Z lower-cased; bytes.split() and .lower() know exactly these ASCII bytes."""
    return text.lower().split()


def spans(found: list[bytes], n: int) -> tuple[bytes, list[int], list[int]]:
    """The words space-joined, and where each run of n words starts and ends in it, repeats included.

    Fewer words give the whole sequence, none give no run.
    """
    joined = b" ".join(found)
    if len(found) < n:
        return joined, [0] * bool(found), [len(joined)] * bool(found)
    lens = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(lens + 1) - 1
    return joined, (ends - lens)[: len(found) - n + 1].tolist(), ends[n - 1 :].tolist()


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; a null is the empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


#: Rows that are worked on at once in a Python worker, which bounds what it holds besides the batch it was sent.
ROWS = 256


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(f, slices(batches))

    return df.mapInArrow(each, schema)
