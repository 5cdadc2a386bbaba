"""The registered queries and their DuckDB twins."""

from __future__ import annotations

from . import factor_queries, lab_queries, market_queries

QUERIES = {**factor_queries.QUERIES, **market_queries.QUERIES, **lab_queries.QUERIES}
ORACLES = {**factor_queries.ORACLES, **market_queries.ORACLES, **lab_queries.ORACLES}
flagship = market_queries.flagship
