"""The queries of the engine and the SQL that states the same result."""

from __future__ import annotations

from importlib import import_module

MODULES = ["intervals", "timeline", "chat", "tape", "trainset", "metrics", "joins", "streaming", "synthetic", "alignment"]


def collected(kind: str) -> dict:
    """All QUERIES, or all SQL, of the modules of this package."""
    out: dict = {}
    for name in MODULES:
        out |= getattr(import_module(f"talkweave.plans.{name}"), kind)
    return out
