"""Query: documents as binary records of token ids, written, read back and digested."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberglass.llm.records import read_records, write_records
from emberglass.storage import Scratch

NAME = "op4_token_records"
#: Not in SQL; tests/llm compares with the library's ids and reads the files back.
SQL = None
TOKENIZER, END = "word_bpe_49k.json", 1


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "records")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = scratch.save(write_records(docs, scratch.path("shards"), public_tokenizers.path(TOKENIZER), END), "manifest")
    return read_records(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
