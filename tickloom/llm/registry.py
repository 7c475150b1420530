"""Queries and SQL of this subpackage's operators."""

from __future__ import annotations

import importlib

MODULES = (
    "op1_license_scan",
    "op2_line_dedup",
    "op3_pii",
    "op4_url_filter",
    "op5_lm_scoring",
    "op6_minhash_dedup",
    "op7_quality_rules",
    "op8_toxicity",
    "op9_decontamination",
    "op10_byte_bpe",
)


# imported here, so that a library that is missing shows when this module is imported
_MODULES = [importlib.import_module(f"tickloom.llm.{m}") for m in MODULES]


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
