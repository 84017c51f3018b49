"""Queries and DuckDB SQL of this subpackage, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from emberglass.llm import op01_toxicity, op02_simhash, op03_additive, op04_records, op05_minhash, op06_urlfilter, op07_hpylm
from emberglass.llm import op08_bpe, op09_mixing, op10_linededup, op11_fim, op12_divergence, op13_langid

_MODULES = [
    op01_toxicity, op02_simhash, op03_additive, op04_records, op05_minhash, op06_urlfilter, op07_hpylm,
    op08_bpe, op09_mixing, op10_linededup, op11_fim, op12_divergence, op13_langid,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {m.NAME: m.query for m in _MODULES}


def oracle_sql() -> dict[str, str]:
    return {m.NAME: m.SQL for m in _MODULES if m.SQL}
