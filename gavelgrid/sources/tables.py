"""Parquet tables: one file or directory per table below a base folder."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, base: str, name: str, columns: Iterable[str] | None = None) -> DataFrame:
    """Lazy, column-pruned scan of ``base/name.parquet``."""
    df = spark.read.parquet(f"{base}/{name}.parquet")
    return df.select(*columns) if columns else df


def require(df: DataFrame, **columns: str) -> DataFrame:
    """Exactly the named columns, cast to the given types; a missing one becomes NULL.

    Operators start with this, so that extra columns, whatever their names, can't clash with working columns.
    """
    have = {name.lower() for name in df.columns}
    picked = [
        (F.col(f"`{name}`") if name.lower() in have else F.lit(None)).cast(kind).alias(name)
        for name, kind in columns.items()
    ]
    return df.select(*picked)


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], T._parse_datatype_string(schema))
