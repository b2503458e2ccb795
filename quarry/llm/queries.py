"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from importlib import import_module

#: Query name -> module that defines it.
WHERE = {
    "op1_lm_score": "lm", "op2_extract": "html", "op3_url_filter": "urls", "op4_embedding_dedup": "embeddings",
    "op5_warc": "warc", "op6_chat": "chat", "op7_toxicity": "toxicity", "op8_mixing": "mixing", "op9_minhash": "minhash",
    "op10_decontaminate": "decontaminate", "op11_hard_negatives": "negatives", "op12_fill_in_middle": "fim", "op13_sharding": "sharding",
}


def queries() -> dict:
    return {name: getattr(import_module(f"quarry.llm.{module}"), name) for name, module in WHERE.items()}


def oracle_sql() -> dict:
    found = {name: getattr(import_module(f"quarry.llm.{module}"), "ORACLE_SQL", None) for name, module in WHERE.items()}
    return {name: sql for name, sql in found.items() if sql}
