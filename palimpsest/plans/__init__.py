"""Registered queries: operators applied to the views over the given tables."""

import importlib

MODULES = ["columns", "relational", "ingestion", "retrieval", "lifecycle", "projections"]


def load():
    """Import every query module and return the registry."""
    for name in MODULES:
        importlib.import_module(f"palimpsest.plans.{name}")
    from palimpsest.plans import registry
    return registry
