"""Queries of the language identification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavelgrid.llm import languages
from gavelgrid.plans.registry import Registry
from gavelgrid.sources.tables import table

REGISTRY = Registry()


def _identified(spark: SparkSession, base: str) -> DataFrame:
    chunks = table(spark, base, "chunks", ("id", "language", "text"))
    return languages.identify(chunks, "id", "language", "text", languages.fit_on(chunks, "id", "language", "text"))


@REGISTRY.query("p6_found")
def found(spark: SparkSession, base: str) -> DataFrame:
    cases = languages.label_cases(_identified(spark, base))
    return cases.select(F.col("key").cast("bigint").alias("id"), "language")


@REGISTRY.query("p6_stretches")
def stretches(spark: SparkSession, base: str) -> DataFrame:
    rows = _identified(spark, base).select(F.col("key").cast("bigint").alias("id"), "label", "main_language", F.posexplode("stretches").alias("stretch", "s"))
    return rows.select("id", "label", "main_language", "stretch", "s.char_start", "s.char_end", "s.language", F.round("s.confidence", 4).alias("confidence")).distinct()
