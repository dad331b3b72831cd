"""Registered queries: one per operator of the inventory, bound to the given tables."""

import importlib
import pkgutil


def load_all():
    """Import every ``q_*`` module and return (queries, oracles)."""
    for module in sorted(m.name for m in pkgutil.iter_modules(__path__)):
        if module.startswith("q_"):
            importlib.import_module(f"{__name__}.{module}")
    from roadsift.plans.registry import ORACLES, QUERIES

    return dict(QUERIES), dict(ORACLES)
