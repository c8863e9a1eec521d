"""Registered queries of the core: each takes (spark, folder of tables) and has, where SQL can say it, an oracle."""

from bunko.plans import answers, documents, inventory, ordered, runs, search, sources

_MODULES = (search, inventory, documents, ordered, answers, sources, runs)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: q for m in _MODULES for k, q in m.ORACLES.items()}
