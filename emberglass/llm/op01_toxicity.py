"""Query: documents scored for toxicity by a model of the labelled rows outside the held-out fold."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberglass.llm.toxicity import Model, fit, score
from emberglass.storage import Scratch

NAME = "op1_toxicity"
#: A trained model is not in SQL; tests/llm measures held-out accuracy.
SQL = None
#: Labelled rows that the model is fitted on at most, and the score from which a text counts as toxic.
MAX_ROWS, THRESHOLD = 20_000, 0.7


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def model(spark: SparkSession, sf_dir: str, docs: DataFrame) -> Model:
    """Fitted on docs and their labels, the held-out fold left out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out())
    return fit(docs, labels, Scratch(spark, "toxicity"), max_rows=MAX_ROWS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = score(docs, model(spark, sf_dir, docs))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
