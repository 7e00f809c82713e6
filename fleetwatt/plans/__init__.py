"""Registered query plans, grouped by topic."""

from __future__ import annotations

import importlib

TOPICS = ("energy", "sources", "scalars", "aggregates", "ordered", "joined", "filters", "exports", "captured", "streams")


def load_all():
    """Import every topic and return (queries, oracle texts)."""
    from fleetwatt.plans import registry

    for topic in TOPICS:
        importlib.import_module(f"fleetwatt.plans.{topic}")
    return registry.QUERIES, registry.ORACLES
