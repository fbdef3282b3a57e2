"""Registered queries of this subpackage and their DuckDB equivalents."""

from __future__ import annotations

import importlib

_MODULES = {
    "op1_decontaminate": "decontaminate",
    "op2_suffix_dedup": "suffix_dedup",
    "op3_quality": "quality",
    "op4_langid": "langid",
    "op5_simhash": "simhash",
    "op6_pii": "pii",
    "op7_toxicity": "toxicity",
    "op8_licenses": "licenses",
    "op9_html": "wrappers",
    "op10_sentencepiece": "sentencepiece_codec",
}


def _module(name: str):
    return importlib.import_module(f"{__package__}.{_MODULES[name]}")


def queries() -> dict:
    return {name: _module(name).query for name in _MODULES}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name in _MODULES if (sql := getattr(_module(name), "SQL", None))}
