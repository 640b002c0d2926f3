"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

import importlib

_MODULES = {
    "op1_license_scan": "license_scan",
    "op2_chat_format": "chat_format",
    "op3_byte_bpe": "byte_bpe",
    "op4_warc": "warc",
    "op5_quality": "quality",
    "op6_simhash_near_dedup": "simhash",
    "op7_exact_dedup": "exact_dedup",
    "op8_suffix_dedup": "suffix_dedup",
    "op9_decontaminate": "decontaminate",
    "op10_language_id": "language_id",
    "op11_prefix_trie": "prefix_trie",
    "op12_line_dedup": "line_dedup",
    "op13_fill_in_middle": "fill_in_middle",
}

QUERIES = {}
ORACLES = {}
for _name, _module in _MODULES.items():
    _loaded = importlib.import_module(f"{__package__}.{_module}")
    QUERIES[_name] = getattr(_loaded, _name)
    if getattr(_loaded, "SQL", None):
        ORACLES[_name] = _loaded.SQL
