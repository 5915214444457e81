"""The queries of this subpackage, and their SQL where SQL can say the same."""

from __future__ import annotations

from importlib import import_module

#: Query name and the module that holds the function of that name.
MODULES = {
    "op1_suffix_dedup": "suffix",
    "op2_simhash": "simhash",
    "op3_secrets": "secrets",
    "op4_media": "media",
    "op5_quality_rules": "quality",
    "op6_bpe": "bpe",
    "op7_mixing": "mixing",
    "op8_toxicity": "toxicity",
    "op9_line_dedup": "lines",
    "op10_pii": "pii",
    "op11_fill_in_middle": "fim",
    "op12_shards": "shards",
    "op13_importance_resampling": "resample",
}

QUERIES = {name: getattr(import_module(f"tessera.llm.{module}"), name) for name, module in MODULES.items()}
ORACLES = {name: sql for name, module in MODULES.items() if (sql := getattr(import_module(f"tessera.llm.{module}"), "ORACLE_SQL", None))}
