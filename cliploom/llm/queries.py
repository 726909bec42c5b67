"""All queries of this subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ["op01_bpe", "op02_neardup", "op03_toxicity", "op04_ann", "op05_quality", "op06_lm", "op07_pii", "op08_packing", "op09_linededup", "op10_warc", "op11_align", "op12_sumsquares", "op13_fim"]

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _name in MODULES:
    _module = import_module(f"cliploom.llm.{_name}")
    QUERIES.update(_module.QUERIES)
    ORACLE_SQL.update(_module.ORACLE_SQL)
