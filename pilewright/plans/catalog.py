"""All queries of the core and their SQL."""

from __future__ import annotations

from pilewright.plans import feature_queries, pileup_queries, record_queries

_MODULES = (record_queries, pileup_queries, feature_queries)

QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
FLAGSHIP = "called_variants"
