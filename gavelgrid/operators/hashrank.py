"""Exact ranks and quotas inside groups of any size, without a task that holds a whole group.

Rows get a pseudo-random priority (md5 of seed and key). The first hex digits cut every group into buckets; a count
per bucket, summed up over the at most ``16 ** digits`` buckets of a group, gives the offset of a bucket, and a
``row_number`` inside one bucket gives the rest. The largest window therefore holds about ``1 / 16 ** digits`` of the
largest group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIGITS = 3


def priority(key: Column, seed: int | str) -> Column:
    """Hex priority that depends on key and seed alone."""
    return F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))))


def hash_rank(df: DataFrame, groups: list[str], key: str, seed: int | str, digits: int = DIGITS, quota: str | None = None) -> DataFrame:
    """Adds ``hash_rank``: 1-based position inside ``groups`` by (priority, key).

    ``key`` must be unique inside a group and group values must not be NULL. With ``quota`` (a column of ``df``, equal
    within a group) only the rows with rank <= quota are returned, and buckets beyond the quota are dropped before
    anything is sorted.
    """
    hashed = df.withColumn("_h", priority(F.col(key), seed)).withColumn("_b", F.substring("_h", 1, digits))
    sizes = hashed.groupBy(*groups, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_o", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    joined = hashed.join(offsets, [*groups, "_b"])
    if quota:
        joined = joined.filter(F.col("_o") < F.col(quota))
    inside = F.row_number().over(Window.partitionBy(*groups, "_b").orderBy("_h", key))
    ranked = joined.withColumn("hash_rank", F.col("_o") + inside).drop("_h", "_b", "_o")
    return ranked.filter(F.col("hash_rank") <= F.col(quota)) if quota else ranked
