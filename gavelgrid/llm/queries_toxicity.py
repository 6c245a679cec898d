"""Queries of the toxicity scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavelgrid.llm import toxicity
from gavelgrid.plans.registry import Registry
from gavelgrid.sources.tables import table

REGISTRY = Registry()


def _scored(spark: SparkSession, base: str) -> DataFrame:
    documents = table(spark, base, "documents", ("doc_id", "source", "text"))
    return toxicity.score(documents, toxicity.fit_on(documents, table(spark, base, "content_labels", ("doc_id", "label"))))


@REGISTRY.query("p9_found")
def found(spark: SparkSession, base: str) -> DataFrame:
    return _scored(spark, base).filter("toxic").select("doc_id").distinct()


@REGISTRY.query("p9_scores")
def scores(spark: SparkSession, base: str) -> DataFrame:
    return _scored(spark, base).withColumn("score", F.round("score", 5))


@REGISTRY.query("p9_rates")
def rates(spark: SparkSession, base: str) -> DataFrame:
    return toxicity.rates(_scored(spark, base))
