"""A corpus pipeline of five stages over documents; each stage's result is written, and read by the next."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberglass.llm import bpe, linededup, mixing, op01_toxicity, simhash, toxicity
from emberglass.storage import Scratch

TOKENIZER = "word_bpe_49k.json"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It is fitted on the labelled documents among docs, held-out fold aside."""
    model = op01_toxicity.model(spark, sf_dir, docs)
    return toxicity.keep_clean(docs.select(*COLUMNS), model, threshold=op01_toxicity.THRESHOLD)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of three-line windows that occur before go; a document stays, even without lines. n_chars follows the text."""
    out = linededup.dedup_lines(docs.select(*COLUMNS), Scratch(spark, "lines"))
    return out.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), "n_chars")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates over five-word shingles the document with the least id stays."""
    return simhash.keep_one(docs.select(*COLUMNS), n_words=5)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their target weights; a document appears as often as the mix takes it."""
    out = mixing.mix(docs.select(*COLUMNS), weights=(3, 1, 2), share=1.5, max_epochs=2)
    again = out.filter("copies > 0").select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
    return again.select(*[F.col(f"row.{c}").alias(c) for c in COLUMNS])


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the mix, one row for each time a document is taken: doc_id, n_tokens, ids."""
    ids = bpe.encode(docs, public_tokenizers.path(TOKENIZER))
    return ids.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic),
    ("line dedup", lines),
    ("SimHash near-dedup", near_duplicates),
    ("mixing", mixed),
    ("BPE encoding", encoded),
]
#: A trained model and XXH64 are not in SQL; tests/llm compares line dedup and mixing with SQL, near-dedup with brute force
#: and encoding with the library, and measures the classifier.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = out if k == len(STAGES) - 1 else scratch.save(out, name.replace(" ", "-"))
    return docs
