"""All registered queries of the search engine, each with its DuckDB twin where SQL can express it."""

from __future__ import annotations

from glyphlake.plans import engine, retrieval, service, vocabulary
from glyphlake.plans.retrieval import flagship

QUERIES = vocabulary.QUERIES | retrieval.QUERIES | service.QUERIES | engine.QUERIES
ORACLES = vocabulary.ORACLES | retrieval.ORACLES | service.ORACLES | engine.ORACLES

__all__ = ["ORACLES", "QUERIES", "flagship"]
