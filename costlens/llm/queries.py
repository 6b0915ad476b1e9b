"""The corpus operators' registered queries and their SQL."""

from __future__ import annotations

from importlib import import_module

#: Query name -> module of this subpackage; each has query(spark, sf_dir), and ORACLE_SQL where SQL can express it.
MODULES = {
    "op1_minhash": "op1_minhash",
    "op10_url_rules": "op10_url_rules",
    "op11_packing": "op11_packing",
    "op12_divergence": "op12_divergence",
    "op13_fill_middle": "op13_fill_middle",
    "op2_licenses": "op2_licenses",
    "op3_quality": "op3_quality",
    "op4_posting_lists": "op4_posting_lists",
    "op5_sentencepiece": "op5_sentencepiece",
    "op6_language": "op6_language",
    "op7_token_counts": "op7_token_counts",
    "op8_decontaminate": "op8_decontaminate",
    "op9_substrings": "op9_substrings",
}


def queries() -> dict:
    return {name: import_module(f"{__package__}.{module}").query for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"{__package__}.{module}"), "ORACLE_SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
