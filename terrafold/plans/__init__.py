"""Query catalogue: importing this package registers every named query."""

import importlib

MODULES = ("measures", "spatial", "quality", "attributes", "classification", "relations", "curves", "crs",
           "algebra", "robust", "profiling", "ledger", "selection", "outputs", "models", "streams")


def catalogue():
    from . import registry

    for m in MODULES:
        try:
            importlib.import_module(f"{__name__}.{m}")
        except ModuleNotFoundError as e:
            if e.name != f"{__name__}.{m}":
                raise
    return registry.QUERIES, registry.ORACLES
