"""Intermediate tables that several later stages read."""

from __future__ import annotations

from pyspark.sql import DataFrame

from gavelgrid.session import checkpointed


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder; later stages read it instead of computing it again."""
    return checkpointed(df)
