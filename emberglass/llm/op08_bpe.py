"""Query: documents encoded and decoded with the public BPE of 49k entries."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberglass.llm.bpe import decode, encode

NAME = "op8_bpe"
#: Not in SQL; tests/llm compares with the library's own encoding of whole texts.
SQL = None
TOKENIZER = "word_bpe_49k.json"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(TOKENIZER)
    both = decode(encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), path), path)
    n = (F.octet_length("ids") / 4).cast("long")
    return both.select("doc_id", n.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
