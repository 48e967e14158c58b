"""Queries of the training-text problems, by number."""

from __future__ import annotations

import importlib

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
for _name in ("p1_split", "p2_overlap", "p3_sentences", "p4_unify", "p5_terms", "p6_pack", "p7_leaks", "p8_pii"):
    _m = importlib.import_module(f"spanloom.llm.{_name}")
    QUERIES |= _m.QUERIES
    ORACLE |= _m.ORACLE
