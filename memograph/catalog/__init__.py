"""Registered queries over the shared test tables, each with its SQL check where one exists."""

from __future__ import annotations

from importlib import import_module

from memograph.catalog.base import ORACLES, QUERIES

for _part in ("events", "detectors", "documents", "chat", "graph", "search", "answers", "records", "wiki", "lookups", "streams", "stores", "maintained"):
    import_module(f"memograph.catalog.{_part}")

__all__ = ["ORACLES", "QUERIES"]
