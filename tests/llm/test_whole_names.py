"""Extra columns may have any names, those inside the operators too; tables may be empty."""

import pytest
from pyspark.sql import functions as F

from emberglass.llm import bpe, linededup, minhash, mixing, simhash, toxicity, urlfilter
from emberglass.storage import Scratch

NAMES = ["_id", "_th", "_lines", "_gone", "_cid", "node", "_node", "key", "row", "id", "fp", "gram", "h", "b", "k", "size", "source_size", "target", "copies", "inherited", "component", "slot", "nid", "label", "dest"]


@pytest.mark.parametrize("empty", [False, True])
def test_clashing_names(spark, empty):
    rows = [(k, "one\ntwo\nthree\nfour" if k % 2 else None, "s", f"http://a.org/{k}", "") for k in range(6)]
    docs = spark.createDataFrame([] if empty else rows, "doc_id long, text string, source string, url string, html string")
    docs = docs.withColumns({n: F.lit("clash") for n in NAMES})
    n, scratch = docs.count(), Scratch(spark, "t")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == (0 if empty else 2)
    out = linededup.dedup_lines(docs, scratch)
    assert out.columns == [*docs.columns, "n_lines", "removed_lines"] and out.count() == n
    assert {r[x] for r in out.collect() for x in NAMES} <= {"clash"}
    assert mixing.mix(docs).count() == simhash.near_duplicates(docs).count() == minhash.with_next(docs).count() == n
    rules = spark.createDataFrame([("allow", "org", "/")], "verdict string, rule_host string, rule_path string")
    judged = urlfilter.judge(docs, rules, urlfilter.link_edges(docs), scratch)
    assert judged.count() == n and {r["verdict"] for r in judged.collect()} <= {"allow"}
    model = toxicity.Model([], __import__("numpy").zeros(0), 0.0)
    assert toxicity.keep_clean(docs, model).columns == docs.columns and toxicity.score(docs, model).count() == n
    assert bpe.encode(docs, __import__("public_tokenizers").path("word_bpe_49k.json")).count() == n
