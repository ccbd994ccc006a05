"""The queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ["toxicity", "quality", "language", "pii", "near_dedup", "packing", "byte_bpe", "vectors", "warc", "decontamination", "importance", "hard_negatives"]

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _name in MODULES:
    _module = import_module(f"{__package__}.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
