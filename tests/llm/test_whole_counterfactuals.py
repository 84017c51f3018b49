"""All swapped sentences of a labelled document enter the penalty."""

from emberglass.llm import toxicity
from emberglass.storage import Scratch


def test_no_swapped_sentence_is_left_out(spark, monkeypatch):
    seen, fit_rows = [], toxicity.fit_rows
    monkeypatch.setattr(toxicity, "fit_rows", lambda rows, pairs, *a, **b: seen.append(len(pairs)) or fit_rows(rows, pairs, *a, **b))
    long = " ".join(f"a muslim said n{k}." for k in range(150))
    rows = [(0, long)] + [(k, "a muslim vilefoo" if k % 2 else "a calm sea") for k in range(1, 40)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int")
    toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), labels, Scratch(spark, "t"))
    assert seen[0] >= 450  # three swaps of each of its sentences
