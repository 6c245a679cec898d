"""Queries of the packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gavelgrid.llm import packing
from gavelgrid.plans.registry import Registry
from gavelgrid.sources.tables import table

REGISTRY = Registry()


@REGISTRY.query("p7_containers")
def containers(spark: SparkSession, base: str) -> DataFrame:
    return packing.pack(table(spark, base, "documents", ("doc_id", "text")))
