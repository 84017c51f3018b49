"""Language identification against a plain model in one process, and held-out accuracy on the driver's tables."""

import math
import os
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from emberglass.llm import langid, op13_langid
from emberglass.storage import Scratch

SF = "/root/testdata/sf0.01"
TRAIN = [("the cat and the dog", "en"), ("the house of the cat", "en"), ("der Hund und die Katze", "de"), ("das Haus der Katze", "de"), ("le chat et le chien", "fr"), ("кошка и собака", "ru"), (None, "de"), ("", "xx"), ("ignored", None)]
ASK = ["the dog", "die Hunde", "chienne", "собаки", "Katzenhaus", "123 !?", "", None, "qqq ωωω", "THE CAT", "été", "cat " * 5000, "cat Katze"]


def plain(train, text):
    """The likeliest language by the same definition, without tables, caches or Spark."""
    words = {lang: Counter() for _, lang in train if lang}
    for t, lang in train:
        if lang:
            words[lang].update(_words(t or ""))
    runs = {n: {lang: Counter() for lang in words} for n in langid.LENGTHS}
    for lang, seen in words.items():
        for w, k in seen.items():
            for n in langid.LENGTHS:
                m = f"<{w}>" if n > 1 else w
                for i in range(len(m) - n + 1):
                    runs[n][lang][m[i : i + n]] += k
    rows = Counter(lang for _, lang in train if lang)
    logs = {lang: math.log(rows[lang] / rows.total()) for lang in words}
    found = _words(text or "")
    if not found:
        return "und", 0.0
    for w in found:
        if any(w in seen for seen in words.values()):
            for lang, seen in words.items():
                logs[lang] += math.log((seen[w] + 0.5) / (seen.total() + sum(map(len, words.values())) / 2))
            continue
        for n in langid.LENGTHS:
            m = f"<{w}>" if n > 1 else w
            known = [m[i : i + n] for i in range(len(m) - n + 1) if any(m[i : i + n] in seen for seen in runs[n].values())]
            if known:
                for lang, seen in runs[n].items():
                    entries = sum(map(len, runs[n].values()))
                    logs[lang] += sum(math.log((seen[r] + 0.5) / (seen.total() + entries / 2)) for r in known) / len(known)
                break
    best = max(sorted(logs), key=lambda x: logs[x])
    return best, 1 / sum(math.exp(x - logs[best]) for x in logs.values())


def _words(text):
    return re.findall(r"[^\W\d_](?:[^\W\d_]|[̀-ͯ])*", text.lower())


def docs_of(spark, rows):
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id long, text string, lang string").repartition(3)


def test_against_a_plain_model(spark):
    model = langid.fit(docs_of(spark, TRAIN), Scratch(spark, "t"))
    assert model.langs == ["de", "en", "fr", "ru", "xx"]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(docs_of(spark, [(t, None) for t in ASK]), model).collect()}
    for k, t in enumerate(ASK):
        lang, score = plain(TRAIN, t)
        assert got[k][0] == lang and got[k][1] == pytest.approx(score, abs=1e-12), t
    assert [got[k][0] for k in range(5)] == ["en", "de", "fr", "ru", "de"] and got[5] == got[6] == got[7] == ("und", 0.0)


def test_small_caches_give_the_same(spark, monkeypatch):
    model = langid.fit(docs_of(spark, TRAIN), Scratch(spark, "t"))
    long = " ".join(f"{w}{k}" for k in range(400) for w in ("the", "haus", "chat", "cat"))
    whole = langid.Scorer(model).score(long)
    monkeypatch.setattr(langid, "_BLOCK", 7)
    small = langid.Scorer(model)
    small.words.most = small.runs.most = 20
    lang, score = small.score(long)
    assert (lang, score) == (whole[0], pytest.approx(whole[1]))
    assert len(small.words.at) <= 20 and len(small.runs.at) <= 20


def test_words_left_out_back_off(spark):
    small = langid.fit(docs_of(spark, TRAIN), Scratch(spark, "t"), max_words=5)
    assert all(len(v) for v in small.words.values()) and "the" in small.words and "house" not in small.words
    assert langid.Scorer(small).score("house")[0] == "en"


def test_edges(spark):
    none = langid.fit(docs_of(spark, [("text", None)]), Scratch(spark, "t"))
    assert langid.identify(docs_of(spark, [("text", "en")]), none).first()["lang_pred"] == "und"
    model = langid.fit(docs_of(spark, TRAIN), Scratch(spark, "t"))
    odd = spark.createDataFrame([("a", None, "x", 1.5)] * 2, "text string, doc_id long, lang_pred string, score double")
    lang, score = plain(TRAIN, "a")
    assert [tuple(r) for r in langid.identify(odd, model).collect()] == [(None, lang, pytest.approx(score))] * 2
    assert langid.identify(odd.limit(0), model).collect() == []
    assert all(0 <= r["score"] <= 1 for r in langid.identify(docs_of(spark, TRAIN), model).collect())


def test_marks_belong_to_words():
    assert list(langid.words("हिन्दी ét x1y_z")) == ["हिन्दी", "ét", "x", "y", "z"]


@pytest.mark.skipif(not os.path.exists(SF), reason="needs the driver's tables")
def test_held_out_accuracy(spark):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    rows = op13_langid.query(spark, SF).collect()
    assert len(rows) == len(lang) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(lang[r["doc_id"]] == r["lang_pred"] for r in held) >= 0.99 * len(held)


@pytest.mark.skipif(not os.path.exists(SF), reason="needs the driver's tables")
def test_held_out_rows_teach_nothing(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(200)
    fold = op13_langid.held_out()
    for name, df in (("a", docs), ("b", docs.withColumn("lang", F.when(fold, "zz").otherwise(F.col("lang"))).withColumn("text", F.when(fold, "").otherwise(F.col("text"))))):
        df.write.parquet(f"{tmp_path}/{name}/documents.parquet")
    a, b = ({r["doc_id"]: (r["lang_pred"], r["score"]) for r in op13_langid.query(spark, f"{tmp_path}/{x}").filter("not held_out").collect()} for x in "ab")
    assert a == b and "zz" not in {x[0] for x in b.values()}


@pytest.mark.parametrize("text", ["Plain ascii, 9 words_here!", "Été à Zürich ² ½ ª º", "Ünd “so” – weiter", "", "\U0001d400 \U00010400x", "हिन्दी ét x1y_z"])
def test_quick_patterns_find_the_same_words(text, monkeypatch):
    want = [m.group() for m in langid.word_pattern().finditer(text.lower())]
    assert langid.words(text) == want
    monkeypatch.setattr(langid, "_BLOCK", 2)
    assert langid.words(text) == want and all(len(b) <= 2 for b in langid.blocks(text))
