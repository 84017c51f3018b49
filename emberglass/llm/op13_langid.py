"""Query: the language of every document, learnt from the documents outside the held-out fold."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberglass.llm.langid import fit, identify
from emberglass.storage import Scratch

NAME = "op13_language_id"
#: A trained model is not in SQL; tests/llm compares with a plain model in one process and measures held-out accuracy.
SQL = None


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.filter(~held_out()), Scratch(spark, "langid"))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
