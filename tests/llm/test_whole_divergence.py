"""Source divergence against counters in one process, in Python's exact integers."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from emberglass.llm import divergence
from emberglass.storage import Scratch

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, least=3, top=200):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = [re.sub("[A-Z]", lambda m: m.group().lower(), t) for t in TERM.findall(text or "")]
        counts[lang, source].update(found)
        docs[lang].update(set(found))
    out = set()
    for lang, source in groups:
        kept = [t for t, k in docs[lang].items() if k >= least]
        here = [g for g in groups if g[0] == lang]

        def p(sources, term):
            c = sum(counts[g][term] for g in sources)
            n = sum(counts[g][t] for g in sources for t in kept)
            return 1 + 10**9 * (c + 1) // (n + len(kept))

        pairs = [(sum((p([(lang, source)], t) - p([g], t)) ** 2 // p([g], t) for t in kept), g[1]) for g in here if g[1] != source]
        terms = [((a - q) ** 2 // q, t) for t in kept if counts[lang, source][t] for a, q in [(p([(lang, source)], t), p(here, t))] if a > q]
        for part, found in (("pair", pairs), ("term", terms)):
            for k, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode())), 1):
                if part == "pair" or k <= top:
                    out.add((lang, source, part, item, value, k))
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "text string, lang string, source string")


def made_rows(n, seed):
    r = random.Random(seed)
    words = ["Red", "red", "blue", "Ärger", "ärger", "x", "don't", "a-b", "9", "中文"] + [f"rare{c}" for c in "abcdefg"]
    return [(None if r.random() < 0.05 else " ".join(r.choices(words, k=r.randrange(25))), r.choice(["en", "de", None, ""]), r.choice(["a", "b", "ä", None, "hot", "hot", "hot"])) for _ in range(n)]


@pytest.mark.parametrize("broadcast", [True, False])
@pytest.mark.parametrize("least", [1, 3])
def test_against_brute_force(spark, broadcast, least, monkeypatch):
    if not broadcast:
        monkeypatch.setattr(divergence, "BROADCAST_SOURCES", 0)
    rows = made_rows(120, 7)
    got = [tuple(r) for r in divergence.audit(table(spark, rows), Scratch(spark, "t"), least_docs=least, top=4).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, least, 4)


def test_edges(spark):
    # a language without kept terms, a group without terms, one source alone, repeated rows, ties
    rows = [("one", "nl", "a"), ("two", "nl", "b"), (None, "it", "a"), ("", "it", "b"), ("1 2 3", "it", None), ("alone alone", "fr", "a")]
    rows += [("tie toe", "pt", "a")] * 3 + [("tie", "pt", "b"), ("", "pt", "c")]
    got = {tuple(r) for r in divergence.audit(table(spark, rows), Scratch(spark, "t")).collect()}
    assert got == brute(rows)
    assert ("nl", "a", "pair", "b", 0, 1) in got and not any(r[0] == "fr" for r in got)
    assert divergence.audit(table(spark, rows).limit(0), Scratch(spark, "t")).collect() == []


def test_extra_columns_and_long_text(spark):
    rows = [("w" * 200_000 + " of many " * 30_000, "en", "a"), ("of many", "en", "b"), ("many of", "en", "b")]
    docs = table(spark, rows).withColumns({c: F.lit("clash") for c in ("term", "n", "docs", "terms", "hits", "i", "j", "v", "g")})
    assert {tuple(r) for r in divergence.audit(docs, Scratch(spark, "t")).collect()} == brute(rows)


def test_probability_is_exact(spark):
    r = random.Random(1)
    cases = []
    for _ in range(300):
        total = r.randrange(10 ** r.randrange(1, 16))
        cases.append((r.randrange(total + 1), total, 1 + r.randrange(10**6)))
    df = spark.createDataFrame(cases, "c long, t long, v long").select("*", divergence.probability(F.col("c"), F.col("t") + F.col("v")).alias("p"))
    for x in df.collect():
        assert x["p"] == 1 + 10**9 * (x["c"] + 1) // (x["t"] + x["v"])


def test_terms_are_counted_without_interpreted_functions(spark):
    """Counting is compiled as a whole; the empty term stands for every group, even one without terms."""
    from emberglass.llm.divergence import term_counts

    out = term_counts(spark.createDataFrame([("a b A", "x", "s"), ("b", "x", "s"), ("1 2", "x", "t"), (None, "y", "t"), (" b ", "x", "t")], "text string, lang string, source string"))
    assert "lambda" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["lang"], r["source"], r["term"]): (r["n"], r["docs"]) for r in out.collect()}
    assert {k for k in got if k[2] == ""} == {("x", "s", ""), ("x", "t", ""), ("y", "t", "")}
    assert {k: v for k, v in got.items() if k[2]} == {("x", "s", "a"): (2, 1), ("x", "s", "b"): (2, 2), ("x", "t", "b"): (1, 1)}
