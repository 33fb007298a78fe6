"""Whole queries, each with its SQL."""

from . import analysis, catalog, full, hints, navigation, plugins, resume, retrieval, structure, truth, upkeep, verify

MODULES = (retrieval, analysis, navigation, catalog, verify, upkeep, structure, full, truth, hints, plugins, resume)
QUERIES = {f.__name__: f for m in MODULES for f in m.FUNCTIONS}
ORACLES = {name: sql for m in MODULES for name, sql in m.SQL.items()}
