"""Functions by name in SQL text, against the column expressions and plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from emberglass.functions import sql
from emberglass.operators import episodes

SQUARE = [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 0.0), (0.0, 0.0)]


@pytest.fixture(scope="module")
def named(spark):
    sql.register(spark)
    return sql.register(spark)  # again is no error


@pytest.mark.parametrize("name", sorted(sql.SCALARS))
def test_scalars_equal_their_expressions(spark, named, name):
    rng = random.Random(3)
    parameters, _, body = sql.SCALARS[name]
    made = {"DOUBLE": lambda: rng.choice([None, 0.0, rng.uniform(-80, 80), rng.uniform(0.1, 1)]), "BOOLEAN": lambda: rng.choice([True, False, None]), "STRING": lambda: rng.choice(["HIGH", "low", "Medium", "x", None]), sql.RING: lambda: rng.choice([None, [{"lat": a, "lon": o} for a, o in SQUARE], [{"lat": a, "lon": o} for a, o in SQUARE[:4]]])}
    rows = [tuple(made[kind]() for _, kind in parameters) for _ in range(40)]
    if name == "grid_cell":
        rows = [(a, b, 0.5) for a, b, _ in rows]
    if name == "compass":
        rows = [(None if b is None else abs(b) * 4,) for (b,) in rows]
    df = spark.createDataFrame(rows, ", ".join(f"{p} {kind}" for p, kind in parameters))
    df.createOrReplaceTempView("given")
    given = ", ".join(p for p, _ in parameters)
    got = spark.sql(f"SELECT {name}({given}) AS v FROM given").collect()
    assert [r["v"] for r in got] == [r["v"] for r in df.select(body(*[F.col(p) for p, _ in parameters]).alias("v")).collect()]
    assert "PythonUDF" not in spark.sql(f"SELECT {name}({given}) AS v FROM given")._jdf.queryExecution().toString()


def test_sessions_of_any_table(spark, named):
    rng = random.Random(8)
    rows = [(k, rng.randrange(5), rng.randrange(4000), "extra") for k in range(200)]
    df = spark.createDataFrame(rows, "id long, k int, at_s long, note string")
    df.createOrReplaceTempView("rows")
    got = spark.sql("SELECT * FROM sessions(TABLE(rows), 'k', 'at_s', 100)")
    assert got.columns == ["id", "k", "at_s", "note", "episode"]
    want = episodes.sessions(df, ["k"], "at_s", 100)
    assert {(r["k"], r["at_s"], r["episode"]) for r in got.collect()} == {(r["k"], r["at_s"], r["episode"]) for r in want.collect()}
    odd = spark.createDataFrame([("a", None, 7), ("a", 1.5, 7), ("a", 9.0, 7)], "`my key` string, t double, episode int")
    odd.createOrReplaceTempView("odd")
    got = spark.sql("SELECT * FROM sessions(TABLE(odd), key => 'my key', at => 't', gap => 5.0)").collect()
    assert [tuple(r) for r in got] == [("a", None, None), ("a", 1.5, 0), ("a", 9.0, 1)]
    odd.limit(0).createOrReplaceTempView("none")
    assert spark.sql("SELECT * FROM sessions(TABLE(none), 'my key', 't', 5)").collect() == []
    for text, fault in [("TABLE(rows), 'nope', 'at_s', 1", "no column nope"), ("TABLE(rows), 'k', 'at_s', -1", "0 or more"), ("5, 'k', 'at_s', 1", "must be a table")]:
        with pytest.raises(Exception, match=fault):
            spark.sql(f"SELECT * FROM sessions({text})").collect()


def test_bands_and_rings(spark, named):
    spark.createDataFrame([("a", 5.0), ("a", None), ("a", 3.0), ("b", None), (None, 1.0)], "r string, d double").createOrReplaceTempView("ways")
    got = {r["r"]: tuple(r)[1:] for r in spark.sql("SELECT * FROM bands(TABLE(ways), 'r', 'd')").collect()}
    assert got == {"a": (3.0, None, 3), "b": (None, None, 1), None: (1.0, 1.0, 1)}
    spark.createDataFrame([(1, 7.0), (1, 4.0), (2, 0.0), (3, 99.0), (4, None), (4, 20.0), (5, None)], "i int, km double").createOrReplaceTempView("far")
    got = {r["i"]: (r["distance_km"], r["ring"], r["threatened"]) for r in spark.sql("SELECT * FROM threat_rings(TABLE(far), 'i', 'km')").collect()}
    assert got == {1: (4.0, "5km", True), 2: (0.0, "inside", True), 3: (99.0, None, False), 4: (20.0, "20km", True), 5: (None, None, False)}


def test_text_of_leaves_strings_alone():
    text = sql.text_of(F.concat(F.lit("a+(1.5) or("), F.col("x")) == F.lit("b"))
    assert "'a+(1.5) or('" in text and "`=`(" in text
