"""Fill-in-the-middle: texts cut into prefix, middle and suffix and put in an order a model can learn to fill in.

A text is a row of units, the matches of a pattern from left to right. Two passes find the cuts: the first counts the
matches, the second advances one lazy match iterator to the smaller rank and then on to the larger. Neither keeps units,
so a text of any length needs no memory besides itself and its output.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberglass.llm.text import slices

#: Marks of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: A unit that is one code point.
CODE_POINT = r"(?s:.)"
ADDED = ("n", "form", "prefix_chars", "middle_chars", "output")


def count_units(unit: re.Pattern, text: str) -> int:
    """First pass: the number of matches."""
    return sum(1 for _ in unit.finditer(text))


def cuts(unit: re.Pattern, text: str, low: int, high: int) -> tuple[int, int]:
    """Second pass: the offsets in text at which its low-th and high-th unit end, 0 <= low <= high; 0 for rank 0."""
    matches, at, out = unit.finditer(text), 0, []
    for step in (low, high - low):
        last = deque(islice(matches, step), maxlen=1)  # drops all but the last match as it goes
        at = last[0].end() if last else at
        out.append(at)
    return out[0], out[1]


def check_marks(marks: tuple[str, str, str]) -> None:
    """Marks must be told apart wherever they stand: none is empty, within another, or begins as one of them ends."""
    for a in marks:
        for b in marks:
            if not a or (a is not b and a in b) or any(a.endswith(b[:k]) for k in range(1, min(len(a), len(b)))):
                raise ValueError(f"marks {marks} could be mistaken for each other")
    if len(set(marks)) < 3:
        raise ValueError("marks must differ")


def _ranks(id_col: str, seed: int) -> Column:
    """Four unsigned numbers of 32 bits from a row's id: the first hex digits of SHA-256 of `seed:id`."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)])


def transform(docs: DataFrame, unit: str = CODE_POINT, seed: int = 1, plain_percent: int = 10, spm_percent: int = 20, marks: tuple[str, str, str] = MARKS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with n (units, long), form, prefix_chars, middle_chars (long, code points; null if plain) and output (string).

    With h1 to h4 from the row's id, the prefix ends after the smaller of h1 % (n + 1) and h2 % (n + 1) units, the middle
    after the larger, and what follows, units or not, is the suffix; what stands before or between units goes with the
    unit after it. A text is plain, and its own output, if it is empty or holds a mark, or if h3 % 100 is not below
    100 - plain_percent. Else it is spm (suffix, prefix, middle) if h4 % 100 < spm_percent, or psm. A pattern may match
    the empty string: that is a unit too.

    A null text is empty; a null id counts as no digits. Repeated rows come out alike. Every row stays; columns of the
    added names are replaced, others are kept whatever their names. An empty table gives no rows.
    """
    check_marks(marks)
    rows = docs.drop(*ADDED)
    p, s, m = marks
    text_at = rows.columns.index(text_col)
    pattern = re.compile(unit)

    def formed(text: str, h: list[int]) -> tuple:
        n = count_units(pattern, text)
        if not text or h[2] % 100 >= 100 - plain_percent or any(x in text for x in marks):
            return n, "plain", None, None, text
        a, b = cuts(pattern, text, *sorted((h[0] % (n + 1), h[1] % (n + 1))))
        prefix, middle, suffix = text[:a], text[a:b], text[b:]
        if h[3] % 100 < spm_percent:
            return n, "spm", a, b - a, "".join((s, suffix, p, prefix, m, middle))
        return n, "psm", a, b - a, "".join((p, prefix, s, suffix, m, middle))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            row, h = batch.column(0), batch.column(1).to_pylist()
            texts = row.field(text_at).to_pylist()
            got = list(zip(*(formed(t or "", k) for t, k in zip(texts, h)))) or [()] * 5
            columns = [pa.array(x, pa.string() if k in (1, 4) else pa.int64()) for k, x in enumerate(got)]
            yield pa.RecordBatch.from_arrays([*row.flatten(), *columns], names)

    added = [T.StructField(c, T.StringType() if c in ("form", "output") else T.LongType()) for c in ADDED]
    names = [*rows.columns, *ADDED]
    one = rows.select(F.struct(*[F.col(f"`{c}`").cast("string").alias(c) if c == text_col else F.col(f"`{c}`") for c in rows.columns]).alias("row"), _ranks(id_col, seed).alias("h"))
    fields = [T.StructField(f.name, T.StringType()) if f.name == text_col else T.StructField(f.name, f.dataType) for f in rows.schema]
    return one.mapInArrow(each, T.StructType([*fields, *added]))


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output of transform() was made from, from it and its form alone."""
    p, s, m = marks

    def parts(first: str, second: str) -> Column:
        body = F.substring(output, len(first) + 1, 2**31 - 1)
        head = F.split(body, f"\\Q{second}\\E", 2)
        tail = F.split(F.get(head, 1), f"\\Q{m}\\E", 2)
        return F.struct(F.get(head, 0).alias("a"), F.get(tail, 0).alias("b"), F.get(tail, 1).alias("middle"))

    psm, spm = parts(p, s), parts(s, p)
    return (
        F.when(form == "psm", F.concat(psm["a"], psm["middle"], psm["b"]))
        .when(form == "spm", F.concat(spm["b"], spm["middle"], spm["a"]))
        .otherwise(output)
    )
