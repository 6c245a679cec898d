"""All queries of the core, in one registry."""

from __future__ import annotations

from gavelgrid.plans import orphans, relational, retrieval, textual, wording
from gavelgrid.plans.registry import Query

MODULES = (orphans, relational, textual, retrieval, wording)


def core_queries() -> dict[str, Query]:
    return {name: query for module in MODULES for name, query in module.REGISTRY.queries.items()}


def core_sql() -> dict[str, str]:
    return {name: text for module in MODULES for name, text in module.REGISTRY.sql.items()}
