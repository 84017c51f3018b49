"""How far the sources of a language differ in their terms.

Each term is pivoted into one wide vector, an array with a place for every source of its language. Higher-order functions
turn a vector into its contributions to the pairs of sources, and partial aggregates add these up where the vectors are.
Probabilities are whole billionths and every step is whole-number arithmetic, so results do not depend on the order of
additions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberglass.storage import Scratch

#: What separates terms: ASCII but letters.
BREAKS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Sources whose profile rows may be broadcast; with more, terms meet them in a join dealt over SALTS.
BROADCAST_SOURCES, SALTS = 10_000, 64


#: Denominators for which a billion times a count is sure to fit.
_SHORT = 9_000_000_000


def probability(count: Column, d: Column) -> Column:
    """1 + floor(10**9 * (count + 1) / d), where count + 1 is at most d: the occurrences and kept terms of a group.

    Exact: in one division where the product fits, else by long division in three steps of three digits. Beyond
    9 * 10**15 the multiplication raises.
    """
    one, rest = F.lit(1).cast("long"), count + F.lit(1).cast("long")
    long_ = one
    for unit in (1_000_000, 1_000, 1):
        long_ = long_ + F.lit(unit).cast("long") * F.call_function("div", rest * 1000, d)
        rest = rest * 1000 % d
    return F.when(d < _SHORT, one + F.call_function("div", (count + one) * F.lit(1_000_000_000).cast("long"), d)).otherwise(long_)


def excess(p: Column, q: Column) -> Column:
    """floor((p - q)**2 / q); both are 1 to 10**9 + 1, so the square fits."""
    return F.call_function("div", (p - q) * (p - q), q)


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term; the term '' stands for the group itself, its n for
    nothing.

    Each text is split once; its terms and its distinct terms are counted together by one partial aggregate.
    """

    def of(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(""))

    text = of(text_col)
    # of a text in ASCII, lower() changes A-Z alone, and is faster
    lowered = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    words = F.split(F.concat(F.lit(" "), lowered), BREAKS, -1)  # the first is '', the group itself
    rows = docs.select(of(lang_col).alias("lang"), of(source_col).alias("source"), words.alias("terms"))
    both = F.array(F.struct(F.lit(1).alias("n"), F.lit(0).alias("d"), F.col("terms").alias("terms")), F.struct(F.lit(0).alias("n"), F.lit(1).alias("d"), F.array_distinct("terms").alias("terms")))
    flat = rows.select("lang", "source", F.inline(both)).select("lang", "source", "n", "d", F.explode("terms").alias("term"))
    return flat.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("docs"))


def audit(docs: DataFrame, scratch: Scratch, least_docs: int = 3, top: int = 200, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Rows (lang, source, part, item, value long, rank int) for every group of rows of one language and source.

    Terms are runs of anything but ASCII non-letters, A-Z lower-cased. A language keeps those in at least least_docs of its
    rows, V in number. A group, and each language, gives a kept term p = probability(its occurrences there, those of all kept
    terms there + V).

    Part `pair`: item is each other source of the language, value the sum of excess(p, its p) over all V terms (0 if V is
    0). Part `term`: item is each kept term that occurs in the group with p above the language's q, value excess(p, q), up
    to rank top. rank counts from 1 per group and part, value descending, then item ascending by its UTF-8 bytes.

    A vector contributes only to pairs of which one source has the term; the terms that neither has are alike in both, so
    they enter as one number times their count. That makes a term's work its sources times all sources, not their square.

    Null texts, languages and sources are ''. Texts without terms give a group all the same. Repeated rows count as often
    as they stand; other columns are not looked at; an empty table gives no rows.
    """
    counts = scratch.save(term_counts(docs, text_col, lang_col, source_col), "counts")
    groups = counts.filter("term = ''").select("lang", "source")
    entry = F.struct("source", "n")
    vectors = counts.filter("term <> ''").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(entry).alias("hits"))
    vectors = scratch.save(vectors.filter(F.col("docs") >= least_docs).select("lang", "term", "hits"), "vectors")
    totals = vectors.select("lang", F.explode("hits").alias("h")).groupBy("lang", "h.source").agg(F.sum("h.n").alias("total"))
    kept = vectors.groupBy("lang").agg(F.count("*").alias("v"))
    sized = groups.join(totals, ["lang", "source"], "left").select("lang", F.struct("source", F.coalesce("total", F.lit(0)).alias("total")).alias("g"))
    profiles = sized.groupBy("lang").agg(F.array_sort(F.collect_list("g")).alias("gs")).join(kept, "lang", "left")
    v, zero = F.coalesce("v", F.lit(0)), F.lit(0).cast("long")
    whole = F.aggregate("gs", zero, lambda a, g: a + g["total"]) + v
    profiles = profiles.select("lang", v.alias("v"), F.col("gs.source").alias("sources"), F.transform("gs", lambda g: g["total"] + v).alias("ds"), whole.alias("d"))
    absent = F.transform("ds", lambda d: F.when(F.col("v") > 0, probability(zero, d)))
    profiles = scratch.save(profiles.withColumn("absent", absent), "profiles")
    wide = scratch.save(_wide(vectors, profiles), "wide")

    # generated columns meet in compiled code, where a function over nested arrays would be interpreted value by value
    there = F.filter(F.transform("ps", lambda p, i: F.struct(i.alias("i"), p.alias("p"))), lambda x: x["p"] > 0)
    pairs = wide.select("lang", "ps", F.inline(there)).select("lang", "i", "p", F.posexplode("ps").alias("j", "q"))
    pairs = pairs.withColumn("f", excess(F.col("p"), F.abs("q")))
    lacks = F.col("q") < 0  # that source emits nothing for this term, so its side is added here
    sums = pairs.groupBy("lang", "i", "j").agg(F.sum("f").alias("f"), F.count("*").alias("k"), F.sum(F.when(lacks, excess(-F.col("q"), F.col("p")))).alias("b"), F.count_if(lacks).alias("kb"))
    sides = F.array(F.struct(F.col("i").alias("i"), F.col("j").alias("j"), F.col("f").alias("f"), F.col("k").alias("k")), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), F.col("b").alias("f"), F.col("kb").alias("k")))
    sums = sums.select("lang", F.inline(sides)).groupBy("lang", "i", "j").agg(F.sum("f").alias("f"), F.sum("k").alias("k"))
    of = profiles.select("lang", "v", "sources", "absent", F.posexplode("sources").alias("i", "source")).select("*", F.posexplode("sources").alias("j", "item")).filter("i <> j")
    of = of.select("lang", "v", "source", "item", "i", "j", excess(F.get("absent", F.col("i")), F.get("absent", F.col("j"))).alias("neither"))
    joined = of.join(sums, ["lang", "i", "j"], "left").withColumns({"f": F.coalesce("f", zero), "k": F.coalesce("k", zero)})
    value = F.col("f") + F.when(F.col("k") < F.col("v"), (F.col("v") - F.col("k")) * F.col("neither")).otherwise(zero)
    pair = joined.select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value"))

    above = F.filter(there, lambda x: x["p"] > F.col("q"))
    terms = wide.select("lang", "term", F.inline(F.transform(above, lambda x: F.struct(x["i"].alias("i"), excess(x["p"], F.col("q")).alias("value")))))
    order = Window.partitionBy("lang", "i").orderBy(F.col("value").desc(), "term")
    best = terms.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    names = profiles.select("lang", F.posexplode("sources").alias("i", "source"))
    term = best.join(names, ["lang", "i"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")).alias("rank")
    return pair.select("*", rank).union(term)


def _wide(vectors: DataFrame, profiles: DataFrame) -> DataFrame:
    """(lang, term, ps, q): a term's probability in each of its language's sources, in their order, with a minus sign where
    it does not occur, and in the language."""
    n_sources = profiles.agg(F.sum(F.size("sources"))).first()[0] or 0
    if n_sources <= BROADCAST_SOURCES:
        rows = vectors.join(F.broadcast(profiles), "lang")
    else:
        salted = profiles.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = vectors.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int")).join(salted, ["lang", "salt"]).drop("salt")
    at = F.transform("hits", lambda h: (F.array_position("sources", h["source"]) - 1).cast("int"))
    rows = rows.select("lang", "term", "ds", "d", "absent", "hits", at.alias("at"))
    found = F.transform("hits", lambda h, k: probability(h["n"], F.get("ds", F.get("at", k))))
    q = probability(F.aggregate("hits", F.lit(0).cast("long"), lambda a, h: a + h["n"]), F.col("d"))
    rows = rows.select("lang", "term", "at", "absent", found.alias("found"), q.alias("q"))
    p = F.transform("absent", lambda p, j: F.coalesce(F.get("found", F.array_position("at", j).cast("int") - 1), -p))
    return rows.select("lang", "term", p.alias("ps"), "q")
