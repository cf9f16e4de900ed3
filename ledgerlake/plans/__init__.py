"""Registered queries over the driver's tables."""

from __future__ import annotations

from importlib import import_module

from ledgerlake.plans.registry import REGISTRY, Query

MODULES = ("relational_queries", "ledger_queries", "corpus_queries", "mutation_queries", "log_queries", "metadata_queries", "source_queries")


def all_queries() -> dict[str, Query]:
    for module in MODULES:
        import_module(f"{__name__}.{module}")
    return REGISTRY
