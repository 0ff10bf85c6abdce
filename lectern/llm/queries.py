"""The queries of this folder and their SQL."""

from __future__ import annotations

from importlib import import_module

#: query: (module, function, name of its SQL)
_WHERE = {
    "op10_packing": ("packing", "packing_query", None),
    "op1_pii": ("pii", "pii_query", None),
    "op2_quality": ("quality", "quality_query", None),
    "op3_exact_dedup": ("exact_dedup", "exact_dedup_query", "EXACT_DEDUP_SQL"),
    "op4_html_extract": ("extract", "extract_query", None),
    "op5_simhash": ("simhash", "simhash_query", None),
    "op6_lz_fingerprint": ("lzprint", "lzprint_query", None),
    "op7_bpe": ("bpe", "bpe_query", None),
    "op8_language_id": ("langid", "langid_query", None),
    "op9_secret_scan": ("secrets", "secrets_query", None),
}


def queries() -> dict:
    return {name: getattr(import_module(f"lectern.llm.{module}"), f) for name, (module, f, _) in _WHERE.items()}


def oracle_sql() -> dict[str, str]:
    return {name: getattr(import_module(f"lectern.llm.{module}"), sql) for name, (module, _, sql) in _WHERE.items() if sql}
