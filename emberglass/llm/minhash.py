"""Document fingerprints by one-permutation MinHash.

Shingles of five words are hashed once to 64 bits. The top bits name one of BINS bins, the least of the rest is the
bin's value. Empty bins are filled by optimal densification: each tries bins in a fixed pseudo-random order of its own,
the same for all documents, until it meets one that was not empty (after 64 misses, one chance in 10^9 with a quarter of
the bins full, the next one that is). Of each value the low B_BITS bits are stored, packed.
Two fingerprints' share of equal values, corrected for values that agree by chance (one in 2**B_BITS), estimates the
share of shingles in common.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberglass.llm.ranges import in_order
from emberglass.llm.text import slices, words
from emberglass.storage import Scratch

#: A fingerprint has BINS * B_BITS bits. BINS is a power of two; B_BITS divides 8.
BINS, B_BITS, SHINGLE = 256, 8, 5
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64's finisher."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def _probes(bins: int) -> np.ndarray:
    """For each attempt a row with the bin that each bin tries."""
    with np.errstate(over="ignore"):
        n = np.arange(1, 64 * bins + 1, dtype=np.uint64) * _ODD
        return (_mixed(n) >> np.uint64(64 - (bins.bit_length() - 1))).astype(np.int64).reshape(64, bins)


def word_hashes(found: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.array([digest(w) for w in found], dtype=np.uint64)


def signature(hashes: np.ndarray, bins: int = BINS, b_bits: int = B_BITS, shingle: int = SHINGLE) -> bytes:
    """Packed low bits from the words' hashes; fewer words than a shingle are one shingle, no words give b''."""
    n = len(hashes)
    if not n:
        return b""
    with np.errstate(over="ignore"):
        size = min(n, shingle)
        grams = np.zeros(n - size + 1, np.uint64)
        for k in range(size):
            grams = (grams ^ hashes[k : n - size + 1 + k]) * _ODD + np.uint64(k + 1)
            grams ^= grams >> np.uint64(29)
        grams = np.sort(_mixed(grams))
        edges = np.arange(bins, dtype=np.uint64) << np.uint64(64 - (bins.bit_length() - 1))
        first = np.searchsorted(grams, edges)
        full = np.append(first[1:], len(grams)) > first
        values = np.zeros(bins, np.uint64)
        values[full] = _mixed(grams[first[full]])
        empty = np.flatnonzero(~full)
        if len(empty):
            source = np.full(bins, -1)
            for tries in _probes(bins):
                hit = full[tries[empty]]
                source[empty[hit]] = tries[empty[hit]]
                empty = empty[~hit]
                if not len(empty):
                    break
            for i in empty:  # after so many misses: the next full bin
                source[i] = (i + 1 + np.argmax(np.roll(full, -int(i) - 1))) % bins
            filled = source >= 0
            values[filled] = values[source[filled]]
    low = (values & np.uint64((1 << b_bits) - 1)).astype(np.uint8)
    bits = np.unpackbits(low[:, None], axis=1)[:, 8 - b_bits :]
    return np.packbits(bits.ravel()).tobytes()


def likeness(a: bytes, b: bytes, b_bits: int = B_BITS) -> float:
    """Estimated share of shingles in common, 0 to 1. Two texts without words are alike, one is like no other."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    x = np.unpackbits(np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8)).reshape(-1, b_bits)
    same, chance = float((~x.any(axis=1)).mean()), 1 / (1 << b_bits)
    return min(1.0, max(0.0, (same - chance) / (1 - chance)))


def fingerprint(text: str) -> bytes:
    return signature(word_hashes(words(text.encode())))


_COLUMNS = [("kind", pa.int32()), ("part", pa.int32()), ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("first_text", pa.string()), ("last_text", pa.string())]
_SCHEMA = "kind int, part int, doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double, first_text string, last_text string"


def _against_next(text: str, mark: bytes, following: str, next_mark: bytes) -> tuple:
    n = len(text)
    edited = text[: n - n // 4] + following[: n // 4]
    own = fingerprint(edited)
    return n, hashlib.sha256(edited.encode()).hexdigest(), mark, own, likeness(mark, own), likeness(mark, next_mark)


def _batches(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), _COLUMNS)], [n for n, _ in _COLUMNS])


def _following(parts: DataFrame, scratch: Scratch) -> DataFrame:
    """(part, next) for parts 0, 1, ... n - 1, which may be empty: the next one that isn't, after the last the first.

    Equality joins only; where parts are empty, pointers are doubled until none points to an empty one.
    """
    n = parts.count()
    now = scratch.save(parts.select("part", "empty", F.pmod(F.col("part") + 1, F.lit(max(n, 1))).alias("next")), "next")
    for _ in range(max(n, 1).bit_length() + 1):
        on = now.select(F.col("part").alias("at"), F.col("empty").alias("skip"), F.col("next").alias("then"))
        moved = now.join(on, F.col("next") == F.col("at"))
        if moved.filter("skip and not empty").isEmpty():
            break
        now = scratch.save(moved.select("part", "empty", F.when(F.col("skip"), F.col("then")).otherwise(F.col("next")).alias("next")), "next")
    return now.filter("not empty").select("part", "next")


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_range: int = 8192) -> DataFrame:
    """One row per row of docs: the fingerprints of its text, and of the text whose last floor(n / 4) characters give
    way to the first as many (or all) of the next document's, and how near they are to each other and to the next's.

    The next document is that of the next larger id, after the last the first. Rows of equal id follow each other by
    text, null ids come first. A null text is empty; texts without words have an empty fingerprint. A single document
    is its own next. Other columns are not looked at; an empty table gives no rows.

    Ranges of ids are sorted in one shuffle. Only the first and the last text of each range go beyond it, to meet
    those of the neighbouring ranges.
    """
    scratch = Scratch(docs.sparkSession, "minhash")
    rows = in_order(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")), "doc_id", "text", per_range=per_range)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, first = TaskContext.get().partitionId(), None, None
        for batch in slices(batches):
            out = []
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                mark = fingerprint(text)
                if last is None:
                    first = text
                else:
                    out.append((0, part, last[0], *_against_next(last[1], last[2], text, mark), None, None))
                last = (doc_id, text, mark)
            if out:
                yield _batches(out)
        yield _batches([(1, part, last[0], *[None] * 6, first, last[1]) if last else (2, part, *[None] * 9)])

    done = scratch.save(rows.mapInArrow(each, _SCHEMA), "rows")
    ends = done.filter("kind = 1").select("part", "doc_id", "first_text", "last_text")
    follows = _following(done.filter("kind > 0").select("part", (F.col("kind") == 2).alias("empty")), scratch)

    def edge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(0, 0, i, *_against_next(a, fingerprint(a), b, fingerprint(b)), None, None) for i, a, b in zip(*(c.to_pylist() for c in batch.columns))]
            if out:
                yield _batches(out)

    first = ends.select(F.col("part").alias("next"), F.col("first_text").alias("following"))
    edges = ends.join(follows, "part").join(first, "next").select("doc_id", "last_text", "following").mapInArrow(edge, _SCHEMA)
    whole = done.filter("kind = 0").union(edges)
    return whole.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
