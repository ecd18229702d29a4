"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib

from fathom.llm import op8_rules

_MODULES = ("op1_toxicity", "op10_ppm", "op11_fim", "op12_pii", "op2_simhash", "op3_suffix", "op4_warc", "op5_pieces", "op6_media", "op7_mixing", "op8_rules", "op9_wrappers")


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"fathom.llm.{name}"), name) for name in _MODULES} | {"rule_ablations": op8_rules.rule_ablations}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(importlib.import_module(f"fathom.llm.{name}"), "ORACLE_SQL", None) for name in _MODULES}
    return {k: v for k, v in found.items() if v} | {"rule_ablations": op8_rules.ABLATIONS_SQL}
