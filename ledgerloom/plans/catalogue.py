"""All queries of the evidence operators on the driver tables, each with equivalent SQL where there is one."""

from __future__ import annotations

from ledgerloom.plans import contract_queries, evidence_queries, raster_queries, relational_queries, retrieval_queries
from ledgerloom.plans.registry import Query

_MODULES = (evidence_queries, retrieval_queries, raster_queries, relational_queries, contract_queries)

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
for _module in _MODULES:
    QUERIES |= _module.registry.queries
    SQL |= _module.registry.sql
