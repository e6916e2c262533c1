"""Registered queries, one module per part of the inventory."""

import importlib
import pkgutil


def load_all() -> None:
    for module in sorted(m.name for m in pkgutil.iter_modules(__path__)):
        if module.startswith("q_"):
            importlib.import_module(f"{__name__}.{module}")
    importlib.import_module(f"{__name__}.formulas").register()
