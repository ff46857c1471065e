"""Queries of the text operators and the SQL that states the same result, where SQL can."""

from __future__ import annotations

from importlib import import_module

MODULES = ["q_markup", "q_language", "q_speech", "q_pairs", "q_budget", "q_lookalike"]


def collected(kind: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(import_module(f"talkweave.llm.{name}"), kind)
    return out
