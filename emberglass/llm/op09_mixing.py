"""Query: documents mixed to weights 3, 1, 2 over their sources, 150 % of all words, two epochs at most."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberglass.llm.mixing import mix, n_words
from emberglass.storage import Scratch

NAME = "op9_mixing"
SQL = r"""
WITH base AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('0:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM base GROUP BY source),
w AS (SELECT *, [3e0, 1e0, 2e0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight, source_size * 2e0 AS cap FROM s),
l AS (SELECT *, cap / weight AS ratio,
        ((sum(source_size) OVER ()) * 1.5e0 - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0))
        / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size,
        least(cap, coalesce((SELECT level FROM l WHERE level <= ratio ORDER BY ratio, level LIMIT 1), CAST('inf' AS DOUBLE)) * weight) AS target FROM l),
r AS (SELECT b.doc_id, b.size, t.source_size, t.target,
        CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS whole,
        sum(b.size) OVER (PARTITION BY b.source ORDER BY b.h, b.doc_id, b.size ROWS UNBOUNDED PRECEDING) - b.size / 2e0 AS middle
      FROM base b JOIN t ON b.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN middle < target - whole * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes = docs.select("doc_id", "source", n_words("text").alias("size"))
    sizes = Scratch(spark, "mixing").save(sizes, "sizes")
    mixed = mix(sizes, weights=(3, 1, 2), share=1.5, max_epochs=2, size_col="size")
    return mixed.select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
