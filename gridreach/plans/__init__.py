"""Registered queries: every operator over whole tables, with its SQL twin."""

from __future__ import annotations

import importlib
import pkgutil


def all_queries():
    from gridreach.plans import registry

    for m in sorted(pkgutil.iter_modules(__path__), key=lambda m: m.name):
        if m.name.startswith("q_"):
            importlib.import_module(f"{__name__}.{m.name}")
    return dict(registry.QUERIES)
