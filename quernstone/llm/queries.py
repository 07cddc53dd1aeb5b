"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

_MODULES = {
    "op1_toxicity": "op1_toxicity",
    "op2_ngram_jaccard": "op2_jaccard",
    "op3_mix_sources": "op3_mix",
    "op4_chat_format": "op4_chat",
    "op5_exact_dedup": "op5_dedup",
    "op6_shard": "op6_shard",
    "op7_exact_topk": "op7_topk",
    "op8_byte_bpe": "op8_bpe",
    "op9_warc": "op9_warc",
    "op10_pii": "op10_pii",
}


def queries() -> dict:
    return {name: import_module(f"quernstone.llm.{module}").query for name, module in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"quernstone.llm.{module}"), "SQL", None) for name, module in _MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
