"""Registered queries of this subpackage and their DuckDB statements."""

from __future__ import annotations

import importlib

MODULES = ["bpe", "chat", "partenum", "suffix", "toxicity", "line_dedup", "quality", "hilbert", "decontam", "warc", "syncmers", "ball_tree", "merkle"]

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
for _name in MODULES:
    _module = importlib.import_module(f"{__package__}.{_name}")
    QUERIES |= _module.QUERIES
    ORACLE |= _module.ORACLE
