"""Query: documents scored by a hierarchical Pitman-Yor model of those outside the held-out fold."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberglass.llm.hpylm import score
from emberglass.storage import Scratch

NAME = "op7_pitman_yor"
#: A sampled model is not in SQL; tests/llm compares counts with brute force and perplexity with the base's.
SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, F.crc32(F.col("doc_id").cast("string")) % 7 == 2, Scratch(spark, "hpylm"))
