"""The operators' queries and, where SQL can express one, its SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_WHERE = {
    "op10_simhash_groups": "op10_simhash",
    "op11_whiten": "op11_whitening",
    "op12_repair": "op12_repair",
    "op13_extract_html": "op13_html",
    "op1_mix_sources": "op1_mixing",
    "op2_pii_surrogates": "op2_pii",
    "op3_interleaved_media": "op3_media",
    "op4_line_dedup": "op4_line_dedup",
    "op5_shard_balance": "op5_sharding",
    "op6_quality_score": "op6_quality",
    "op7_language_id": "op7_language",
    "op8_bpe_tokens": "op8_bpe",
    "op9_topk_search": "op9_search",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import pipeline

    found = {name: getattr(importlib.import_module(f"{__package__}.{module}"), name) for name, module in _WHERE.items()}
    return found | {"pipeline": pipeline.run}


def oracle_sql() -> dict[str, str]:
    from .op9_search import SQL

    return {"op9_topk_search": SQL}
