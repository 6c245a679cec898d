"""Queries of the vector search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavelgrid.llm import neighbours
from gavelgrid.plans.registry import Registry
from gavelgrid.sources.tables import table

REGISTRY = Registry()


def _vectors(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "passage_vectors", ("chunk_rowid", "embedding"))


@REGISTRY.query("p5_found")
def found(spark: SparkSession, base: str) -> DataFrame:
    return neighbours.similar_pairs(_vectors(spark, base))


@REGISTRY.query("p5_neighbours")
def all_neighbours(spark: SparkSession, base: str) -> DataFrame:
    return neighbours.nearest(_vectors(spark, base)).withColumn("similarity", F.round("similarity", 5))
