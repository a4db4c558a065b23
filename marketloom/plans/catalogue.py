"""All queries of the core and their oracles."""

from __future__ import annotations

from marketloom.plans import audits, captures, data_quality, exchange, relational, texts

QUERIES = {**data_quality.QUERIES, **relational.QUERIES, **captures.QUERIES, **texts.QUERIES, **exchange.QUERIES, **audits.QUERIES}
ORACLES = {**data_quality.ORACLES, **relational.ORACLES, **captures.ORACLES, **texts.ORACLES, **exchange.ORACLES, **audits.ORACLES}
flagship = relational.fair_market_power
