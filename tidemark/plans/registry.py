"""All registered queries of the library with their DuckDB equivalents."""

from __future__ import annotations

from tidemark.plans import market, research_queries, serving_queries  # noqa: F401

FLAGSHIP = "return_distribution"
QUERIES = dict(market.QUERIES)
ORACLES = dict(market.ORACLES)
