"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Query name and the module whose query() runs it.
MODULES = {
    "op1_line_dedup": "line_dedup",
    "op2_simhash": "simhash",
    "op3_byte_bpe": "bpe",
    "op4_licences": "licences",
    "op5_packing": "packing",
    "op6_sharding": "sharding",
    "op7_suffix_dedup": "suffix_dedup",
    "op8_quality": "quality",
    "op9_embeddings": "embeddings",
    "op10_chat": "chat",
    "op11_divergence": "divergence",
    "op12_clustering": "clustering",
    "op13_decontamination": "decontamination",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: import_module(f"skeinwork.llm.{module}").query for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"skeinwork.llm.{module}"), "ORACLE_SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
