"""Queries of this package and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from importlib import import_module

MODULES = ["op01_winnowing", "op02_class_lm", "op03_bagminhash", "op04_suffixes", "op05_language", "op06_lines",
           "op07_divergence", "op08_licenses", "op09_pseudonyms", "op10_packing",
           "op11_whitening", "op12_repair", "op13_mincut"]

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _name in MODULES:
    _module = import_module(f"tabforge.llm.{_name}")
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
