"""Query: fingerprints of documents, of their edited texts, and how near these are."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberglass.llm.minhash import with_next

NAME = "op5_fingerprints"
#: Not in SQL; tests/llm compares with true likeness and with brute force.
SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})
