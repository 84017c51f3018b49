"""Toxicity by a counterfactual-regularised classifier.

A logistic model over the presence of words and of character runs in words. Besides its labels it is shown, for each
labelled sentence that mentions a group, the same sentence with the mention swapped for others of its kind; the squared
difference of the two scores (in log odds) is penalised. So a neutral mention of a group that the labelled rows happen
to mention in toxic texts does not make a text toxic.

Mentions are those named in IDENTITIES and, as a corpus may have none of them, kinds learnt from the labelled rows: words
of like frequency that the labels do not tell apart. What is neutral like a mention must not count for its spelling.

Nothing but a row's text is an input of its score.
"""

from __future__ import annotations

import re
import warnings
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberglass.llm.text import map_batches, slices
from emberglass.storage import Scratch

#: Mentions of groups, by kind; a term is swapped for the others of its kind.
IDENTITIES = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab", "african"),
    ("women", "men"),
    ("woman", "man"),
    ("female", "male", "transgender"),
    ("gay", "lesbian", "straight", "bisexual"),
    ("immigrants", "refugees", "natives"),
    ("muslime", "christen", "juden"),
    ("frauen", "männer"),
    ("musulmans", "chrétiens", "juifs"),
    ("femmes", "hommes"),
    ("musulmanes", "cristianos", "judíos"),
    ("mujeres", "hombres"),
)
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[^.!?\n]+[.!?\n]*")
#: Words whose features a worker process keeps.
_KEPT = 400_000


def _grams(word: str) -> set[str]:
    """The word, and its runs of 3 to 5 characters with marks at both ends."""
    marked = f"<{word}>"
    return {f"={word}"} | {marked[i : i + n] for n in (3, 4, 5) for i in range(len(marked) - n + 1)}


class Features:
    """Numbers of the known features that a text has."""

    def __init__(self, grams: Sequence[str]):
        self.number = {g: k for k, g in enumerate(grams)}
        self._of: dict[str, tuple[int, ...]] = {}

    def of(self, text: str) -> set[int]:
        if len(self._of) > _KEPT:
            self._of.clear()
        known, number, out = self._of, self.number, set()
        for word in set(_WORD.findall(text.lower())):
            found = known.get(word)
            if found is None:
                found = known[word] = tuple(number[g] for g in _grams(word) if g in number)
            if found:
                out.update(found)
        return out


@dataclass
class Model:
    grams: list[str]
    weights: np.ndarray
    bias: float
    n_pairs: int = 0  # swapped sentences that were penalised
    kinds: tuple[tuple[str, ...], ...] = ()  # that were learnt

    def score(self, features: set[int]) -> float:
        z = self.bias + float(self.weights[sorted(features)].sum())
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def swaps(text: str, identities: Sequence[Sequence[str]] = IDENTITIES) -> Iterator[tuple[str, str]]:
    """(sentence, the sentence with all its terms moved on by 1, 2, ... places in their kinds) for sentences with terms,
    until every term has been every other of its kind."""
    kind = {t: (k, i) for k in identities for i, t in enumerate(k)}
    for m in _SENTENCE.finditer(text.lower()):
        sentence = m.group()
        present = {w for w in _WORD.findall(sentence) if w in kind}
        for step in range(1, max((len(kind[w][0]) for w in present), default=1)):
            yield sentence, _WORD.sub(lambda w: kind[w.group()][0][(kind[w.group()][1] + step) % len(kind[w.group()][0])] if w.group() in kind else w.group(), sentence)


def _sums(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, values, n)


class Lists:
    """Lists of feature numbers, flat: a list's entries have its number in at. len() is the number of lists."""

    def __init__(self, column: pa.ChunkedArray | pa.Array):
        lens = column.combine_chunks().value_lengths() if isinstance(column, pa.ChunkedArray) else column.value_lengths()
        lens = np.asarray(lens, dtype=np.int64)
        flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
        self.n, self.at, self.col = len(lens), np.repeat(np.arange(len(lens)), lens), np.asarray(flat, dtype=np.int64)

    def __len__(self) -> int:
        return self.n


class Pairs:
    """Features (gained, lost) by swaps, each different change once with the times it occurs; len() counts them all."""

    def __init__(self, gained: Lists, lost: Lists, times: np.ndarray):
        self.at, self.col = np.append(gained.at, lost.at), np.append(gained.col, lost.col)
        self.sign, self.times = np.append(np.ones(len(gained.at)), -np.ones(len(lost.at))), np.asarray(times, float)

    def __len__(self) -> int:
        return int(self.times.sum())


def fit_rows(rows: Lists, pairs: Pairs, y: np.ndarray, n: int, penalty: float, ridge: float, positive_weight: float = 1.0, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias from the features and labels of rows and from the changes by swaps, by Adam on all of them.

    The least of: mean weighted log loss + ridge / 2 * |w|^2 + penalty * mean squared change of the log odds.
    """
    weight = np.where(y > 0, positive_weight, 1.0)
    w, bias = np.zeros(n), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for t in range(1, steps + 1):
        z = bias + _sums(rows.at, w[rows.col], len(rows))
        g = weight * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y)
        grad = np.append(_sums(rows.col, g[rows.at], n) / len(rows) + ridge * w, g.mean())
        if len(pairs):
            d = _sums(pairs.at, w[pairs.col] * pairs.sign, len(pairs.times)) * pairs.times
            grad[:-1] += 2 * penalty / len(pairs) * _sums(pairs.col, d[pairs.at] * pairs.sign, n)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = 0.1 / (1 + t / 100) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, bias = w - step[:-1], bias - float(step[-1])
    return w, bias


#: Words of a learnt kind; share of the labelled rows that hold such a word, from and to.
KIND_SIZE, MENTION_SHARE = 4, (0.002, 0.05)


def fit(docs: DataFrame, labels: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = 20_000, max_features: int = 4096, min_z: float = 4.0, penalty: float = 1.0, ridge: float = 1e-4, positive_weight: float = 3.0, identities: Sequence[Sequence[str]] = IDENTITIES, learnt_kinds: int = 16, seed: int = 0) -> Model:
    """A model from at most max_rows labelled documents, those whose seeded id hash is least.

    Features are those that differ between the classes by at least min_z standard errors, at most max_features of them,
    counted where the texts are. Toxic rows, the fewer, weigh positive_weight each. To identities come learnt_kinds kinds
    of KIND_SIZE words that the classes hold alike (less than one standard error apart), the most frequent within
    MENTION_SHARE first, those of like frequency together. Every sentence of the labelled rows is swapped; equal changes
    are added up before the driver gets them. Where no swap changes a known feature, the penalty has nothing to act on:
    that is warned of, and Model.n_pairs is 0.

    Null labels and null ids are left out; of conflicting labels the larger counts; labels without a document are left
    out. With one class or none all scores are that class's rate, or 0.5.
    """
    key = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter("doc_id is not null and label is not null")
    key = key.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(max_rows)
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = scratch.save(text.join(F.broadcast(key), "doc_id").select("text", "label"), "labelled")  # max_rows short rows

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for batch in batches:
            for t, label in zip(*(c.to_pylist() for c in batch.columns)):
                seen[int(label > 0)].update(set().union(*map(_grams, set(_WORD.findall(t.lower())))))
        names = list(seen[0].keys() | seen[1].keys())
        for k in range(0, len(names), 20_000):
            part = names[k : k + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *(pa.array([seen[c][g] for g in part], pa.int64()) for c in (0, 1))], ["gram", "n0", "n1"])

    n1, n0 = (rows.agg(F.count(F.when(F.col("label") > 0, 1)), F.count(F.when(F.col("label") <= 0, 1))).first())
    if not n0 or not n1:
        rate = n1 / (n0 + n1) if n0 + n1 else 0.5
        return Model([], np.zeros(0), float(np.log((rate + 1e-6) / (1 - rate + 1e-6))))
    counts = rows.mapInArrow(count, "gram string, n0 long, n1 long").groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    counts = scratch.save(counts.filter(F.col("n0") + F.col("n1") >= 5), "counts")
    both = F.col("n0") + F.col("n1")
    p1, p0, p = F.col("n1") / n1, F.col("n0") / n0, (both + 1) / (n0 + n1 + 2)
    z = F.abs(p1 - p0) / F.sqrt(p * (1 - p) * (1 / n0 + 1 / n1))
    best = counts.filter(z >= min_z).orderBy(z.desc(), "gram").limit(max_features)
    grams = [r["gram"] for r in best.select("gram").collect()]
    low, high = (share * (n0 + n1) for share in MENTION_SHARE)
    alike = counts.filter(F.col("gram").startswith("=") & (F.char_length("gram") > 2) & (both >= low) & (both <= high) & (z < 1))
    named = {t for k in identities for t in k}
    found = [r["gram"][1:] for r in alike.orderBy(both.desc(), "gram").limit(KIND_SIZE * learnt_kinds + len(named)).select("gram").collect()]
    found = [w for w in found if w not in named][: KIND_SIZE * learnt_kinds]
    learnt = tuple(tuple(found[k : k + KIND_SIZE]) for k in range(0, len(found), KIND_SIZE))
    features, kinds = Features(grams), (*identities, *learnt)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for t, label in zip(*(c.to_pylist() for c in batch.columns)):
                changed = []
                for a, b in swaps(t, kinds):
                    x, x2 = features.of(a), features.of(b)
                    if x != x2:
                        changed.append({"gained": sorted(x2 - x), "lost": sorted(x - x2)})
                out.append({"features": sorted(features.of(t)), "label": int(label > 0), "changed": changed})
            yield pa.RecordBatch.from_pylist(out, schema)

    ints = pa.list_(pa.int32())
    schema = pa.schema([("features", ints), ("label", pa.int32()), ("changed", pa.list_(pa.struct([("gained", ints), ("lost", ints)])))])
    vec = scratch.save(rows.mapInArrow(vectors, "features array<int>, label int, changed array<struct<gained:array<int>,lost:array<int>>>"), "vectors")
    got = vec.select("features", "label").toArrow()  # max_rows rows
    changes = vec.select(F.explode("changed").alias("c")).groupBy("c.gained", "c.lost").agg(F.count("*").alias("times")).toArrow()
    pairs = Pairs(Lists(changes["gained"]), Lists(changes["lost"]), changes["times"].to_numpy())
    if not len(pairs):
        warnings.warn("no swapped sentence changes a known feature: the counterfactual penalty has nothing to act on", stacklevel=2)
    weights, bias = fit_rows(Lists(got["features"]), pairs, got["label"].to_numpy().astype(float), len(grams), penalty, ridge, positive_weight)
    return Model(grams, weights, bias, len(pairs), learnt)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id long, score double) for every row of docs, from its whole text. A null text is empty.

    Null ids and repeated rows stay. Other columns are not looked at.
    """
    features = Features(model.grams)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = [model.score(features.of(t or "")) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), each, "doc_id long, score double")


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of docs, all columns, whose text scores below threshold. A null text is empty and stays null."""
    features = Features(model.grams)
    at = docs.columns.index(text_col)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keep = [model.score(features.of(t or "")) < threshold for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(each, docs.schema)
