"""Fill-in-the-middle against a plain version that stores all units, and its round trip."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from emberglass.llm import fim


def plain(doc_id, text, unit=fim.CODE_POINT, percent=10, spm=20):
    text = text or ""
    ends = [m.end() for m in re.finditer(unit, text)]
    h = [int(hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(ends)
    if not text or any(m in text for m in fim.MARKS) or h[2] % 100 >= 100 - percent:
        return n, "plain", None, None, text
    a, b = (([0] + ends)[r] for r in sorted((h[0] % (n + 1), h[1] % (n + 1))))
    p, m, s = text[:a], text[a:b], text[b:]
    if h[3] % 100 < spm:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


EDGES = [None, "", "x", "<P>", "a<S>b", "a<M", "<<P<S<M>>", "\U0001f600é\n\r\0z", "P>x<", "word " * 40_000, "same", "same"]


@pytest.mark.parametrize("unit", [fim.CODE_POINT, r"\w+", r"[^\n]*\n?"])
def test_against_stored_units(spark, unit):
    rows = [(k, EDGES[k % len(EDGES)]) for k in range(60)] + [(None, "no id"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = fim.transform(docs, unit=unit)
    got = out.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(rows) and {r["form"] for r in got} == {"plain", "psm", "spm"}
    for r, (i, t) in zip(sorted(got, key=lambda r: (r["doc_id"] is None, r["doc_id"], r["text"] is None)), sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is None))):
        assert (r["doc_id"], r["text"]) == (i, t)
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == plain(i, t, unit)
        assert r["back"] == (t or "")


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab<>PSM\n\U0001f600", max_size=30), st.data())
def test_cuts_are_where_units_end(text, data):
    unit = re.compile(data.draw(st.sampled_from([fim.CODE_POINT, r"[ab]+", r"a*"])))
    ends = [0] + [m.end() for m in unit.finditer(text)]
    n = fim.count_units(unit, text)
    assert n == len(ends) - 1
    low, high = sorted(data.draw(st.tuples(st.integers(0, n), st.integers(0, n))))
    assert fim.cuts(unit, text, low, high) == (ends[low], ends[high])


def test_extra_columns_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "abc", "keep", 5, [1, 2])], "doc_id long, text string, row string, n long, h array<int>")
    out = fim.transform(docs)
    assert out.columns == ["doc_id", "text", "row", "h", *fim.ADDED]
    (r,) = out.collect()
    assert (r["row"], r["h"], r["n"]) == ("keep", [1, 2], 3)
    assert fim.transform(docs.limit(0)).collect() == []


def test_marks_that_could_be_mistaken():
    for marks in [("", "b", "c"), ("a", "a", "c"), ("ab", "ba", "c"), ("a", "xax", "c"), ("aba", "x", "y")]:
        with pytest.raises(ValueError):
            fim.check_marks(marks)
    fim.check_marks(("|p|x", "{s}", "{m}"))


def test_no_unit_array(spark):
    import tracemalloc

    text, unit = "x" * 2_000_000, re.compile(fim.CODE_POINT)
    tracemalloc.start()
    n = fim.count_units(unit, text)
    assert fim.cuts(unit, text, n // 3, n) == (n // 3, n)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100_000  # two million units


def test_shares_of_forms(spark):
    docs = spark.createDataFrame([(k, "text of some length") for k in range(5000)], "doc_id long, text string")
    n = {r["form"]: r["count"] for r in fim.transform(docs).groupBy("form").count().collect()}
    assert abs(n["plain"] / 5000 - 0.1) < 0.02 and abs(n["spm"] / 5000 - 0.18) < 0.02
