"""Query: the ten nearest of each hundredth embedding, by additive quantisation and exact reranking."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberglass.llm.additive import search

NAME = "op3_additive_quantisation"
#: An approximate search is not in SQL; tests/llm measures its recall against brute force.
SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)
