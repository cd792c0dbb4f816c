"""Registered queries and their SQL."""

from .plans import drift, sources, texts, validation

_PARTS = (validation, drift, texts, sources)
QUERIES = {k: f for part in _PARTS for k, f in part.QUERIES.items()}
ORACLES = {k: q for part in _PARTS for k, q in part.ORACLES.items()}
