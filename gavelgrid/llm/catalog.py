"""All queries of this subpackage."""

from __future__ import annotations

from gavelgrid.llm import (
    queries_languages,
    queries_leakage,
    queries_neighbours,
    queries_packing,
    queries_proportions,
    queries_sampling,
    queries_toxicity,
)
from gavelgrid.plans.registry import Query

MODULES = (queries_sampling, queries_proportions, queries_neighbours, queries_languages, queries_packing, queries_leakage, queries_toxicity)


def llm_queries() -> dict[str, Query]:
    return {name: query for module in MODULES for name, query in module.REGISTRY.queries.items()}


def llm_sql() -> dict[str, str]:
    return {name: text for module in MODULES for name, text in module.REGISTRY.sql.items()}
