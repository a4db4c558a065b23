"""All queries of this subpackage and their oracles."""

from __future__ import annotations

from marketloom.llm import oracles, queries

QUERIES = queries.QUERIES
ORACLES = oracles.ORACLES
