"""Query: documents less the lines of three-line windows that occur before."""

from pyspark.sql import DataFrame, SparkSession

from emberglass.llm.linededup import dedup_lines
from emberglass.storage import Scratch

NAME = "op10_line_dedup"
SQL = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
w AS (SELECT doc_id, CAST(p AS BIGINT) AS pos, lines[p + 1] || chr(10) || lines[p + 2] || chr(10) || lines[p + 3] AS run
      FROM (SELECT doc_id, lines, unnest(range(0, len(lines) - 2)) AS p FROM d WHERE len(lines) >= 3)),
v AS (SELECT doc_id, pos, run, row_number() OVER (PARTITION BY run ORDER BY doc_id, pos) AS nth FROM w WHERE trim(replace(run, chr(10), '')) <> ''),
gone AS (SELECT DISTINCT doc_id, pos + k AS pos FROM v, (VALUES (0), (1), (2)) AS o(k) WHERE nth > 1),
l AS (SELECT d.doc_id, x.p AS pos, d.lines[x.p + 1] AS line FROM d, LATERAL (SELECT unnest(range(0, len(d.lines))) AS p) AS x),
k AS (SELECT l.doc_id, count(*) AS n_lines, count(gone.pos) AS removed_lines,
             coalesce(string_agg(CASE WHEN gone.pos IS NULL THEN l.line END, chr(10) ORDER BY l.pos), '') AS text
      FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.pos = gone.pos GROUP BY l.doc_id)
SELECT doc_id, text, n_lines, removed_lines FROM k
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs, Scratch(spark, "lines"))
