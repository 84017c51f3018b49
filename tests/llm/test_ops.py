"""The ten operators and the pipeline against brute force, on fixtures with nulls, empties, ties and repeats."""

import hashlib
import random
import re

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from emberglass.llm import additive, bpe, hpylm, linededup, minhash, mixing, op09_mixing, op10_linededup, records, simhash, toxicity, urlfilter
from emberglass.storage import Scratch

PATH = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(n=60, seed=3):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 6))) for _ in range(80)]
    line = lambda: " ".join(rng.choice(vocab) for _ in range(rng.randint(3, 12)))
    shared = [line() for _ in range(4)]
    texts = []
    for k in range(n):
        lines = [line() for _ in range(rng.randint(1, 8))]
        if k % 5 == 0:
            lines[1:1] = shared
        texts.append("\n".join(lines))
        if k % 9 == 8:
            texts[k] = texts[k - 3]
        if k % 7 == 6:
            texts[k] = texts[k - 1] + " z"
    texts[0], texts[1], texts[2], texts[3] = None, "", " \n\t ", "One"
    return [(k, t, "en", None if k % 11 == 0 else f"s{k % 4}", len(t or "")) for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = corpus()
    rows += [rows[10], (None, "null id", "en", "s1", 7)]
    return spark.createDataFrame(rows, DOCS).withColumn("fp", F.lit("clash")).withColumn("rest", F.lit(1)).repartition(3)


def rows_of(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def test_simhash_by_brute_force(docs):
    def fp(text):
        w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
        grams = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    got = rows_of(simhash.near_duplicates(docs))
    src = [(r["doc_id"], fp(r["text"])) for r in rows_of(docs)]
    assert sorted((r["doc_id"] or -1, r["fingerprint"]) for r in got) == sorted((i or -1, f"{f:016x}") for i, f in src)
    comp = {f: f for _, f in src}
    for _ in range(len(comp)):
        for a in comp:
            for b in comp:
                if (a ^ b).bit_count() <= 2:
                    comp[a] = comp[b] = min(comp[a], comp[b])
    least = {}
    for i, f in src:
        if i is not None:
            least[comp[f]] = min(least.get(comp[f], i), i)
    assert all(r["component_id"] == least.get(comp[int(r["fingerprint"], 16)]) for r in got)


@pytest.mark.parametrize("bucket", [1, 4, 128])
def test_no_link_is_lost_in_full_buckets(spark, bucket):
    rng = random.Random(bucket)
    base = rng.getrandbits(64)
    fps = {base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(60)} | {rng.getrandbits(64) for _ in range(20)}
    signed = [simhash._signed(f) for f in fps]
    want = {tuple(sorted((a, b))) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    got = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), Scratch(spark, "t"), bucket=bucket)
    assert {tuple(sorted(map(int, r))) for r in got.collect()} == want


def test_one_of_each_near_duplicate_stays(spark):
    rng = random.Random(1)
    words = [[f"w{rng.randrange(10**6)}" for _ in range(150)] for _ in range(5)]
    rows = [(k, " ".join(w), 1) for k, w in enumerate(words)]
    rows += [(10 + k, " ".join([*w[:70], "changed", *w[71:]]), 1) for k, w in enumerate(words)] + [(20, rows[0][1], 1), (21, None, 1), (22, "", 1), (0, rows[0][1], 1)]
    got = rows_of(simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, node int")))
    assert sorted(r["doc_id"] for r in got) == [0, 1, 2, 3, 4, 21]


def test_line_dedup_and_mixing_equal_sql(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, DOCS).filter("text is not null")
    con = duckdb.connect()
    documents = df.toPandas()
    con.register("documents", documents)
    got = linededup.dedup_lines(df.select("doc_id", "text"), Scratch(spark, "t"))
    cols = ["doc_id", "text", "n_lines", "removed_lines"]
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({op10_linededup.SQL})").fetchall()
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(want) and any(r[3] for r in want)
    mixed = mixing.mix(df).select(F.col("row.doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
    assert sorted(map(tuple, mixed.collect())) == sorted(con.execute(op09_mixing.SQL).fetchall())


def test_line_dedup_keeps_every_line_once(docs):
    got = rows_of(linededup.dedup_lines(docs, Scratch(docs.sparkSession, "t")))
    before = {line for r in rows_of(docs) for line in (r["text"] or "").split("\n")}
    assert {line for r in got for line in (r["text"] or "").split("\n")} >= before - {""}
    assert len(got) == docs.count() and {r["fp"] for r in got} == {"clash"}


def test_mixing_is_near_its_targets_and_capped(docs):
    got = rows_of(mixing.mix(docs))
    per = {}
    for r in got:
        s = per.setdefault(r["row"]["source"], [0, r["target"], r["source_size"], 0])
        s[0] += r["size"] * r["copies"]
        s[3] = max(s[3], r["size"])
        assert r["copies"] <= 2
    assert sum(t for _, t, _, _ in per.values()) == pytest.approx(1.5 * sum(s for _, _, s, _ in per.values()))
    assert all(abs(taken - t) <= most for taken, t, _, most in per.values())


def test_bpe_equals_the_library():
    lib, rng = Tokenizer.from_file(PATH), random.Random(2)
    parts = ["a", "th", "the", "ing", "É", "é", "é", " ", "\n", "'s", "''", "'ll", "12", "!!", "<|endoftext|>", "<|", "İ", "Σ", "字", "😀", "\xa0", "\x85", "\x1c", "가", "ᄀ", "Ab", "x" * 90]
    for leaf, reach in ((4, 4), (16, 8), (200, 48)):
        codec = bpe.Codec(PATH, leaf, reach)
        texts = ["".join(rng.choice(parts) for _ in range(rng.choice([3, 30, 150]))) for _ in range(120)] + ["", "abcdefgh" * 60]
        ids = [np.frombuffer(x, "<u4").tolist() for x in codec.encode_all(texts)]
        assert ids == [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
        assert codec.decode_all(codec.encode_all(texts)) == [lib.decode(i, skip_special_tokens=False) for i in ids]


def test_records_round_trip(docs, tmp_path):
    scratch = Scratch(docs.sparkSession, "t")
    manifest = scratch.save(records.write_records(docs, f"file://{tmp_path}/r", PATH, 1, per_shard=20))
    got = rows_of(records.read_records(manifest))
    lib = Tokenizer.from_file(PATH)
    src = sorted(((-1 if r["doc_id"] is None else r["doc_id"], r["text"] or "") for r in rows_of(docs)))
    at = 0
    for r, (i, t) in zip(sorted(got, key=lambda r: r["start"]), src, strict=True):
        ids = [*lib.encode(t, add_special_tokens=False).ids, 1]
        assert (r["doc_id"], r["start"], r["n_tokens"]) == (None if i < 0 else i, at, len(ids))
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids
        at += len(ids)
    shard = manifest.orderBy("shard").first()
    assert [x[0] for x in records.read_at(shard["path"], [3, 1])] == [src[3][0], src[1][0]]
    path = shard["path"].removeprefix("file://")
    data = bytearray(open(path, "rb").read())
    data[40] ^= 1
    open(path, "wb").write(data)
    with pytest.raises(ValueError):
        list(records.read_at(shard["path"], [0, 1, 2, 3]))


def test_fingerprints_estimate_likeness(docs):
    got = {r["doc_id"]: r for r in rows_of(minhash.with_next(docs.filter("doc_id is not null").dropDuplicates(["doc_id"]), per_range=9))}
    texts = [(i, t or "") for i, t, *_ in corpus()]
    for (i, t), (_, nxt) in zip(texts, texts[1:] + texts[:1]):
        edited = t[: len(t) - len(t) // 4] + nxt[: len(t) // 4]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()

        def grams(x):
            w = WORD.findall(x.lower())
            return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

        a, b = grams(t), grams(edited)
        assert abs(got[i]["near_edited"] - (len(a & b) / len(a | b) if a | b else 1.0)) < 0.2
    assert minhash.fingerprint("a b") == minhash.fingerprint("A  b\n") and minhash.likeness(b"", b"") == 1.0


def test_url_rules_and_aliases(spark):
    link = '<html><LINK href="{}" rel="canonical"></html>'
    rows = [
        (1, "https://a.example.org/es/1", ""), (2, "http://x.net/p?q=1#f", link.format("http://a.example.org/es/1")), (3, "http://y.net/a/b", '<meta http-equiv="refresh" content="0; url=/c">'),
        (4, "http://y.net/c", link.format("//x.net/p?q=1")), (5, "http://good.net/", link.format("http://ok.org/")), (6, "http://good.net/2", link.format("http://good.net/")), (7, "http://good.net/3", link.format("http://b.com/de/x")),
        (8, "http://good.net/3", link.format("http://good.net/2")), (9, None, None), (10, "nothing", "x"), (11, "ftp://EXAMPLE.org/en/12", ""), (12, "http://notexample.org/es/", ""), (13, "http://b.com/de/", ""), (14, "http://z.com/x", link.format("http://b.com/de/")),
    ]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string").withColumn("host", F.lit("clash"))
    rules = spark.createDataFrame([("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")], "verdict string, rule_host string, rule_path string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in rows_of(urlfilter.judge(pages, rules, urlfilter.link_edges(pages), Scratch(spark, "t")))}
    assert got == {1: ("example.org/es/", "block"), 2: (None, "block"), 3: (None, "block"), 4: (None, "block"), 5: (None, "allow"), 6: (None, "allow"), 7: (None, "allow"), 8: (None, "allow"), 9: (None, "allow"), 10: (None, "allow"), 11: ("example.org/en/1", "block"), 12: ("org/", "allow"), 13: ("com/de/", "block"), 14: (None, "block")}


def test_search_finds_neighbours(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(700, 16)).astype(np.float32)
    x[300:400] = x[5]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(900, None), (1000, [0.0] * 16), (1100, [float("nan")] * 16), (1200, [1.0]), (None, x[0].tolist()), (7, x[7].tolist())]
    got = rows_of(additive.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0, rerank=128, sample=512))
    hit = 0
    for q in range(0, 700, 100):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        want = [k for k in np.lexsort((np.arange(700), d)) if k != q][:10]
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["score"] for r in mine] == pytest.approx([d[r["vec_id"]] for r in mine]) and len(mine) == 10
        hit += len(set(want) & {r["vec_id"] for r in mine})
    assert hit / 70 >= 0.9 and {r["query_id"] for r in got} == set(range(0, 700, 100))
    assert [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == 300), key=lambda r: r["rank"])] == [5, *range(301, 310)]


@pytest.mark.parametrize("kind", ["tight clusters", "far from zero", "outliers"])
def test_search_misses_none_where_codes_tell_little(spark, kind):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1200, 8))
    if kind == "tight clusters":
        x = 100 * rng.normal(size=(4, 8))[np.arange(1200) % 4] + 1e-5 * x
    elif kind == "far from zero":
        x += 1e6
    else:
        x[::50] *= 1e6
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    got = rows_of(additive.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0, rerank=16, sample=300))
    for q in range(0, 1200, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        want = [k for k in np.lexsort((np.arange(1200), d)) if k != q][:10]
        assert [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == want


def test_search_of_nothing(spark):
    assert additive.search(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0


def test_language_model_counts_and_gain(spark):
    rows = corpus(120)
    got = {r["doc_id"]: r for r in rows_of(hpylm.score(spark.createDataFrame(rows, DOCS).repartition(2), F.col("doc_id") % 7 == 2, Scratch(spark, "t")))}
    tokens = {i: [*WORD.findall((t or "").lower()), None] for i, t, *_ in rows}
    count = {}
    for i, w in tokens.items():
        for x in w if i % 7 != 2 else []:
            count[x] = count.get(x, 0) + 1
    n, v = sum(count.values()), len(count)
    for i, w in tokens.items():
        assert (got[i]["held_out"], got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (i % 7 == 2, len(w), sum(x in count for x in w), n)
        assert got[i]["base_score"] == pytest.approx(sum(np.log10((count.get(x, 0) + 1) / (n + v + 1)) for x in w))
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held) and all(r["score"] < 0 for r in got.values())


def test_tables_follow_the_exact_posterior():
    rng, d, theta, q = np.random.default_rng(0), 0.5, 1.0, 0.3
    t = np.array([hpylm.seat(np.array([2]), np.array([0]), np.array([q]), d, theta, rng)[0][0] for _ in range(3000)])
    odds = (theta + d) * q / (1 - d)
    assert t.mean() == pytest.approx(1 + odds / (1 + odds), abs=0.03)


def test_counterfactuals_clear_neutral_mentions(spark):
    rng = random.Random(0)
    neutral = [f"n{chr(97 + k)}{chr(97 + k % 7)}ox" for k in range(26)]
    rows, labels = [], []
    for k in range(400):
        bad = k % 4 == 0
        words = rng.choices(neutral, k=12) + (["vilefoo"] if bad else []) + (["muslim"] if bad and k % 8 == 0 else [])
        rows.append((k, " ".join(words), "muslim"))
        labels.append((k, int(bad)))
    docs = spark.createDataFrame([*rows, (1000, "a muslim neighbour " + " ".join(neutral[:9]), ""), (1001, None, ""), (1002, "you vilefoo " + neutral[3], "")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([*labels, (None, 1), (7, None)], "doc_id long, toxic int")
    scores = {}
    for penalty in (0.0, 20.0):
        model = toxicity.fit(docs, labels, Scratch(spark, "t"), penalty=penalty)
        got = {r["doc_id"]: r["score"] for r in rows_of(toxicity.score(docs, model))}
        assert len(got) == 403 and all(0 <= s <= 1 for s in got.values()) and got[1002] >= 0.7 > got[1001]
        scores[penalty] = got[1000]
    assert scores[20.0] < scores[0.0] and scores[20.0] < 0.5
    kept = toxicity.keep_clean(docs, model)
    assert 1000 in (ids := {r["doc_id"] for r in kept.collect()}) and 1002 not in ids and kept.columns == docs.columns


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"), Scratch(spark, "t"))
    assert toxicity.score(docs, model).first()["score"] == pytest.approx(0.5)


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    scratch = Scratch(spark, "t")
    assert simhash.near_duplicates(none).count() == simhash.keep_one(none).count() == linededup.dedup_lines(none, scratch).count() == mixing.mix(none).count() == 0
    assert bpe.encode(none, PATH).count() == minhash.with_next(none).count() == hpylm.score(none, F.lit(False), scratch).count() == 0
    assert records.read_records(scratch.save(records.write_records(none, scratch.path("r"), PATH, 1))).count() == 0


def test_pipeline_stages(spark, tmp_path):
    rows = corpus(80)
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 0) for k in range(40)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = Scratch(spark, "t").save(stage(spark, docs, str(tmp_path)))
        assert docs.columns == corpus_pipeline.COLUMNS, name
    kept = [r["text"] for r in docs.collect()]
    out = rows_of(corpus_pipeline.run(spark, str(tmp_path)))
    lib = Tokenizer.from_file(PATH)
    want = sorted(len(lib.encode(t or "", add_special_tokens=False).ids) for t in kept)
    assert sorted(r["n_tokens"] for r in out) == want
