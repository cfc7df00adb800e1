"""One checked query per operator; `load()` imports every section and returns the registries."""

from __future__ import annotations

import importlib
import pkgutil


def load():
    from . import tables
    for m in sorted(x.name for x in pkgutil.iter_modules(__path__)):
        if m.startswith("section_"):
            importlib.import_module(f"{__name__}.{m}")
    return tables.QUERIES, tables.ORACLE
