"""Queries of the leak search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavelgrid.llm import leakage
from gavelgrid.plans.registry import Registry
from gavelgrid.sources.tables import table

REGISTRY = Registry()


def _leaks(spark: SparkSession, base: str) -> DataFrame:
    return leakage.leaks(table(spark, base, "documents", ("doc_id", "text")), table(spark, base, "eval_items", ("item_id", "question", "reference")))


@REGISTRY.query("p8_found")
def found(spark: SparkSession, base: str) -> DataFrame:
    return _leaks(spark, base).filter(F.col("spanned") >= leakage.Params().min_share).select("doc_id", "item_id").distinct()


@REGISTRY.query("p8_passages")
def passages(spark: SparkSession, base: str) -> DataFrame:
    return _leaks(spark, base).withColumns({"spanned": F.round("spanned", 4), "matched": F.round("matched", 4)})
