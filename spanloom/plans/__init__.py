"""Query plans over the operators, by theme."""

from __future__ import annotations

import importlib
import pkgutil


def load_all() -> tuple[dict, dict]:
    """Import every plan module and return the registry (queries, oracle SQL)."""
    from spanloom.plans import registry

    for m in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{m.name}")
    return registry.QUERIES, registry.SQL
