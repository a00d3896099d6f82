"""Queries and oracle SQL of the operators here."""

from __future__ import annotations

from importlib import import_module

MODULES = ("quality_classifier", "ann_search", "minhash_dedup", "suffix_dedup", "pieces", "secrets", "substring_dedup", "toxicity", "packing", "quality_rules", "conversation_repair", "filter_audit", "license_scan")


def _gather(name: str) -> dict:
    out: dict = {}
    for module in MODULES:
        out |= getattr(import_module(f"brindle.llm.{module}"), name)
    return out


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict:
    return _gather("ORACLE")
