"""Query: near-duplicates of documents by SimHash over three-word shingles."""

from pyspark.sql import DataFrame, SparkSession

from emberglass.llm.simhash import near_duplicates

NAME = "op2_simhash"
#: XXH64 is not in SQL; tests/llm compares with brute force.
SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), n_words=3)
