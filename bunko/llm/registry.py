"""Queries of all operators for training text."""

from bunko.llm import answer_defects, byte_pairs, lookalike, mixing, near_duplicates, splitting, text_quality, token_budget

_MODULES = (splitting, token_budget, answer_defects, lookalike, near_duplicates, byte_pairs, mixing, text_quality)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: q for m in _MODULES for k, q in m.ORACLES.items()}
