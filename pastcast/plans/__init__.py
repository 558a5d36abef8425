"""Registered queries, one module per part of the library."""

from pastcast.plans import copies, deep, evaluation, features, records, search, streams, tracks, trials, warehouse

_MODULES = [search, warehouse, features, evaluation, streams, trials, copies, tracks, deep, records]
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
