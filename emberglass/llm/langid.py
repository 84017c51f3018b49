"""Language identification, words first and character runs for what no language knows.

A text's words add, for each language, the log frequency of the word there. A word that no language has learnt backs off
to its runs of five characters, and if none of these is known to runs of four, and so on down to single characters.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberglass.llm.text import map_batches, slices
from emberglass.storage import Scratch

#: Lengths of runs, longest first; word ends are marked and count as characters.
LENGTHS = (5, 4, 3, 2, 1)
#: Entries a training task counts before it sends them on, and numbers a scoring worker keeps for words it has met.
_COUNTED, _KEPT = 500_000, 2_000_000
#: Words of one text that are scored at once.
_BLOCK = 65_536
UNDETERMINED = "und"
#: The first mark; letters below it are few, and quick to tell from the rest.
_FIRST_MARK = 0x300
_HIGH = re.compile(f"[{chr(_FIRST_MARK)}-{chr(sys.maxunicode)}]")


@cache
def word_pattern(end: int = sys.maxunicode + 1) -> re.Pattern:
    """Runs of letters, with the marks that follow them, in any script; characters from end on are taken for neither."""
    kinds = "".join(unicodedata.category(chr(c))[0] for c in range(end))
    spans = {k: "".join(f"{re.escape(chr(m.start()))}-{re.escape(chr(m.end() - 1))}" for m in re.finditer(f"{k}+", kinds)) for k in "LM"}
    return re.compile(f"[{spans['L']}][{spans['L']}{spans['M']}]*")


def blocks(text: str) -> Iterator[list[str]]:
    """Lower-cased words, at most _BLOCK at a time."""
    low = text.lower()
    pattern = word_pattern(128) if low.isascii() else word_pattern() if _HIGH.search(low) else word_pattern(_FIRST_MARK)
    if len(low) < _BLOCK:
        found = pattern.findall(low)
        if found:
            yield found
        return
    matches = pattern.finditer(low)
    while block := [m.group() for m in islice(matches, _BLOCK)]:
        yield block


def words(text: str) -> list[str]:
    return [w for block in blocks(text) for w in block]


def runs(word: str, n: int) -> list[str]:
    marked = f"<{word}>" if n > 1 else word
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


@dataclass
class Model:
    """Counts by language: {word: {language's place: times}}, {run: {language's place: times}}, and what all words' and, by
    length, all runs' times in each language are divided by."""

    langs: list[str]
    prior: np.ndarray
    words: dict[str, dict[int, int]]
    runs: dict[str, dict[int, int]]
    n_words: np.ndarray
    n_runs: dict[int, np.ndarray]

    def row(self, of: dict[int, int], total: np.ndarray) -> np.ndarray:
        """Log frequencies, half a time being added to each entry."""
        n = np.full(len(self.langs), 0.5)
        for k, times in of.items():
            n[k] += times
        return np.log(n / total)


class Rows:
    """Rows of log frequencies by name, made when first asked for; with too many of them it begins anew."""

    def __init__(self, width: int):
        self.at: dict[str, int] = {}
        self.rows = np.zeros((1024, max(1, width)))
        self.most = max(1024, _KEPT // self.rows.shape[1])

    def add(self, name: str, row: np.ndarray) -> int:
        k = self.at[name] = len(self.at)
        if k == len(self.rows):
            self.rows = np.vstack([self.rows, np.zeros_like(self.rows)])
        self.rows[k] = row
        return k

    def make_room(self, n: int) -> None:
        if len(self.at) + n > self.most:
            self.at.clear()


class Scorer:
    """Scores texts, keeping the rows of words and runs met before."""

    def __init__(self, model: Model):
        self.model, self.words, self.runs = model, Rows(len(model.langs)), Rows(len(model.langs))

    def _word(self, word: str) -> int:
        """A word's own frequencies, or the mean of its longest known runs'; else it tells nothing."""
        of = self.model.words.get(word)
        return self.words.add(word, self.model.row(of, self.model.n_words) if of is not None else self.backoff(word))

    def backoff(self, word: str) -> np.ndarray:
        known, at = self.model.runs, self.runs.at
        for n in LENGTHS:
            found = [r for r in runs(word, n) if r in known]
            if found:
                self.runs.make_room(len(found))
                numbers = [k if (k := at.get(r)) is not None else self.runs.add(r, self.model.row(known[r], self.model.n_runs[n])) for r in found]
                return np.add.reduce(self.runs.rows[numbers]) / len(numbers)
        return np.zeros(len(self.model.langs))

    def score(self, text: str | None) -> tuple[str, float]:
        """The likeliest language and its probability among the learnt ones; of equal ones the least in order."""
        if not self.model.langs:
            return UNDETERMINED, 0.0
        sums, any_word, at = self.model.prior.copy(), False, self.words.at
        for block in blocks(text or ""):
            any_word = True
            self.words.make_room(len(block))
            numbers = [k if (k := at.get(w)) is not None else self._word(w) for w in block]
            sums += np.add.reduce(self.words.rows[numbers])
        if not any_word:
            return UNDETERMINED, 0.0
        best = int(np.argmax(sums))
        return self.model.langs[best], float(1 / np.exp(sums - sums[best]).sum())


def _count(text_col: int, lang_col: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = defaultdict(Counter)
        for batch in slices(batches):
            for text, lang in zip(batch.column(text_col).to_pylist(), batch.column(lang_col).to_pylist()):
                for block in blocks(text or ""):
                    seen[lang].update(block)
                    if sum(map(len, seen.values())) > _COUNTED:
                        yield from _sent(seen)
        yield from _sent(seen)

    return each


def _sent(seen: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
    for lang, counted in seen.items():
        names = list(counted)
        for k in range(0, len(names), 20_000):
            part = names[k : k + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array(part, pa.string()), pa.array([counted[x] for x in part], pa.int64())], ["lang", "word", "n"])
    seen.clear()


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of each word, as often as the word."""
    seen: dict[str, Counter] = defaultdict(Counter)
    for batch in slices(batches):
        for lang, word, times in zip(*(c.to_pylist() for c in batch.columns)):
            counted = seen[lang]
            for n in LENGTHS:
                for r in runs(word, n):
                    counted[r] += times
        if sum(map(len, seen.values())) > _COUNTED:
            yield from _sent(seen)
    yield from _sent(seen)


def _most_frequent(counts: DataFrame, by: list[str], most: int) -> DataFrame:
    """Of each group the entries counted most often: down to the least count that at most `most` of them reach.

    Groups are counted by count first, so that no group's entries come together in one task.
    """
    steps = counts.groupBy(*by, "n").agg(F.count("*").alias("k"))
    reached = F.sum("k").over(Window.partitionBy(*by).orderBy(F.col("n").desc()))
    least = steps.withColumn("reached", reached).filter(F.col("reached") <= most).groupBy(*by).agg(F.min("n").alias("least"))
    return counts.join(least, by).filter("n >= least").drop("least")


def fit(docs: DataFrame, scratch: Scratch, text_col: str = "text", lang_col: str = "lang", max_words: int = 200_000, max_runs: int = 200_000) -> Model:
    """A model of all rows of docs that have a language.

    Words are counted where the texts are and added up; runs are counted from the word counts. Frequencies are over all
    rows. What the model keeps by name is bounded, as every worker holds it: of all languages' words max_words, of their
    runs max_runs, shared alike among languages (and lengths), the most frequent, equal ones all or none; words left out
    back off to runs like those never seen. Languages are as many as docs names, a number far below max_words.

    A language whose texts have no words has only its share of rows, by which rows' languages weigh in. Null texts are
    empty. Empty docs give a model without languages.
    """
    rows = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("lang is not null")
    counts = rows.mapInArrow(_count(0, 1), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts = scratch.save(counts, "words")
    shares = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    langs = sorted(shares)
    if not langs:
        return Model([], np.zeros(0), {}, {}, np.zeros(0), {})
    grams = counts.mapInArrow(_runs, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    grams = scratch.save(grams.withColumn("length", F.char_length("word")), "runs")
    place = {x: k for k, x in enumerate(langs)}

    def kept(best: DataFrame) -> dict[str, dict[int, int]]:
        out: dict[str, dict[int, int]] = {}
        got = best.select("lang", "word", "n").toArrow()  # max_words or max_runs rows
        for lang, word, n in zip(*(got[c].to_pylist() for c in ("lang", "word", "n"))):
            out.setdefault(word, {})[place[lang]] = n
        return out

    def totals(found) -> np.ndarray:
        """All times of a language, and half a time for each entry that any language has: one with few words must not
        find all others likely."""
        out = np.full(len(langs), sum(r["entries"] for r in found) / 2)
        for r in found:
            out[place[r["lang"]]] += r["n"]
        return out

    sums = [F.sum("n").alias("n"), F.count("*").alias("entries")]
    n_words = totals(counts.groupBy("lang").agg(*sums).collect())
    n_runs = grams.groupBy("lang", "length").agg(*sums).collect()
    best_words = kept(_most_frequent(counts, ["lang"], max_words // len(langs)))
    best_runs = kept(_most_frequent(grams, ["lang", "length"], max_runs // len(langs) // len(LENGTHS)))
    share = np.array([shares[x] for x in langs], float)
    return Model(langs, np.log(share / share.sum()), best_words, best_runs, n_words, {n: totals([r for r in n_runs if r["length"] == n]) for n in LENGTHS})


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' rows as (id_col, lang_pred, score), from whole texts: the likeliest learnt language and its probability.

    A null text, or one without a letter, is `und` with score 0; so is every text if the model has no language. Words of
    which not even a character is known tell nothing; with no others the languages' shares decide. Null ids and repeated
    rows stay; other columns are not looked at; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # max_words + max_runs entries

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        known = shared.value
        if not hasattr(known, "scorer"):
            known.scorer = Scorer(known)  # a worker's, over all its tasks
        got = [known.scorer.score(t) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())], names)

    names = [id_col, "lang_pred", "score"]
    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text")), each, f"`{id_col}` {kind}, lang_pred string, score double")
