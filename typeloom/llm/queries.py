"""The operators' queries by name, and their SQL where SQL can express them."""

from __future__ import annotations

from importlib import import_module

MODULES = ("op1_fingerprints", "op2_html", "op3_ngram_join", "op4_substring_dedup", "op5_language", "op6_quality", "op7_chat", "op8_packing", "op9_sharding", "op10_sentencepiece")


def _all(kind: str) -> dict:
    return {k: v for m in MODULES for k, v in getattr(import_module(f"typeloom.llm.{m}"), kind).items()}


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("ORACLES")
