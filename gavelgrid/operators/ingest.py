"""Idempotent writing: upserts, insert-ignore, cascades, appended ids, resuming, change detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gavelgrid.session import checkpointed


def upsert_latest(base: DataFrame, delta: DataFrame, key: list[str], version: str) -> DataFrame:
    """Union of both, of each key the row with the highest version; on a tie ``delta`` wins, then the larger row.

    A ``max`` over structs instead of a window: it is combined before the shuffle.
    """
    columns = base.columns
    rest = [c for c in columns if c not in {*key, version}]
    both = base.withColumn("_src", F.lit(0)).unionByName(delta.withColumn("_src", F.lit(1)), allowMissingColumns=True)
    best = both.groupBy(*key).agg(F.max(F.struct(version, "_src", *rest)).alias("_r"))
    return best.select(*key, *[F.col(f"_r.{c}").alias(c) for c in [version, *rest]]).select(*columns)


def insert_ignore(base: DataFrame, fresh: DataFrame, key: list[str]) -> DataFrame:
    """``base`` and those keys of ``fresh`` it lacks; of a repeated new key the smallest row."""
    rest = [c for c in base.columns if c not in key]
    new = fresh.join(base.select(*key), key, "left_anti").groupBy(*key).agg(F.min(F.struct(*rest)).alias("_r"))
    return base.unionByName(new.select(*key, "_r.*").select(*base.columns))


def cascade_delete(table: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    """``table`` without the removed keys; rows with a NULL key stay."""
    return table.join(removed.select(key).filter(F.col(key).isNotNull()).distinct(), key, "left_anti")


def global_position(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """1-based position in a total order, without a window over all rows.

    The rows are range-partitioned and stored, so that counting the partitions and numbering inside them see the same
    partitions; only the counts, one row per partition, meet in one place.
    """
    ordered = checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()))
    sizes = ordered.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_o", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return ordered.join(F.broadcast(before.select("_p", "_o")), "_p").withColumn(name, F.col("_o") + inside).drop("_p", "_o")


def append_ids(fresh: DataFrame, order: list[Column], highest: DataFrame, id_column: str) -> DataFrame:
    """``fresh`` with ids that continue after the one row of ``highest``; older ids are never renumbered."""
    top = highest.agg(F.coalesce(F.max(id_column), F.lit(0)).alias("_top"))
    return global_position(fresh, order, "_k").crossJoin(F.broadcast(top)).withColumn(id_column, F.col("_top") + F.col("_k")).drop("_k", "_top")


def missing_only(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a resumed run still has to do."""
    return work.join(done.select(key).distinct(), key, "left_anti")


def changed_only(found: DataFrame, recorded: DataFrame, path: str, fingerprint: str) -> DataFrame:
    """Paths that are new or whose fingerprint differs from the recorded one."""
    old = recorded.select(F.col(path), F.col(fingerprint).alias("_old")).distinct()
    return found.join(old, path, "left").filter(F.col("_old").isNull() | (F.col("_old") != F.col(fingerprint))).drop("_old")
