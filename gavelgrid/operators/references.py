"""References to records that do not exist: orphans of edges and degree counts, per table and month.

A reference is an orphan when its canonical id (a) has no decision, (b) was removed after the last delivery of it, or
(c) was delivered only after the reference was made. References of one key are counted per month before anything is
shuffled, and only these groups meet the decisions. The ``HEAVY_KEYS`` most cited keys, a set bounded by that constant,
are checked through a broadcast; of the remaining keys an anti-join finds those without a decision, a join those whose
decision was removed or came late. Both parts are united. Rows are looked at again only to name the references of
orphan groups, and where a month holds both late and timely references of a key. For that, the orphan groups are sent
to the rows while there are at most ``SENT_GROUPS`` of them; more meet the rows in a shuffle, heavy keys apart.

Defined cases: a NULL or blank-free empty end is no reference; a NULL time makes no reference late and is reported in
the period ``unknown``; a decision without any ``indexed_at`` counts as always there, until it is removed; a removal
without a time never took place; repeated rows count once per row in the report and once in ``orphan_references``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelgrid.functions.identity import canonical_id
from gavelgrid.session import checkpointed
from gavelgrid.sources.tables import require

HEAVY_KEYS = 256
SENT_GROUPS = 100_000  # orphan groups that are broadcast


def reference_rows(edges: DataFrame, counts: DataFrame) -> DataFrame:
    """(ref_table, ref_field, ref_key, canon, at): one row per reference."""
    edges = require(edges, edge_id="bigint", source="string", target="string", recorded_at="timestamp_ntz")
    counts = require(counts, decision_id="string", cited_by="bigint", built_at="timestamp_ntz")
    ends = edges.select(
        F.lit("edges").alias("ref_table"),
        F.explode(
            F.array(
                F.struct(F.lit("source").alias("f"), F.col("source").alias("id")),
                F.struct(F.lit("target").alias("f"), F.col("target").alias("id")),
            )
        ).alias("e"),
        F.col("edge_id").cast("string").alias("ref_key"),
        F.col("recorded_at").alias("at"),
    ).select("ref_table", F.col("e.f").alias("ref_field"), "ref_key", F.col("e.id").alias("id"), "at")
    credited = counts.filter("cited_by > 0").select(
        F.lit("counts").alias("ref_table"),
        F.lit("cited_by").alias("ref_field"),
        F.col("decision_id").alias("ref_key"),
        F.col("decision_id").alias("id"),
        F.col("built_at").alias("at"),
    )
    rows = ends.unionByName(credited).filter((F.col("id").isNotNull()) & (F.col("id") != ""))
    return rows.select("ref_table", "ref_field", "ref_key", canonical_id(F.col("id")).alias("canon"), "at")


def decision_states(decisions: DataFrame, removed: DataFrame) -> DataFrame:
    """Per canonical id with a decision: first and last delivery, and whether it was removed after all of them."""
    rows = require(decisions, decision_id="string", indexed_at="timestamp_ntz").select(
        canonical_id(F.col("decision_id")).alias("canon"), F.col("indexed_at").alias("at"), F.lit(None).cast("timestamp_ntz").alias("gone")
    )
    log = require(removed, decision_id="string", removed_at="timestamp_ntz").select(
        canonical_id(F.col("decision_id")).alias("canon"), F.lit(None).cast("timestamp_ntz").alias("at"), F.col("removed_at").alias("gone")
    )
    return (
        rows.withColumn("here", F.lit(1))
        .unionByName(log.withColumn("here", F.lit(0)))
        .filter(F.col("canon").isNotNull())
        .groupBy("canon")
        .agg(
            F.max("here").alias("here"),
            F.min(F.when((F.col("here") == 1) & F.col("at").isNull(), F.lit(1))).alias("always"),
            F.min("at").alias("first_at"),
            F.max("at").alias("last_at"),
            F.max("gone").alias("gone_at"),
        )
        .filter("here = 1")
        .select(
            "canon",
            F.when(F.col("always").isNull(), F.col("first_at")).alias("first_at"),
            (F.col("gone_at").isNotNull() & (F.col("last_at").isNull() | (F.col("gone_at") > F.col("last_at")))).alias("gone"),
        )
    )


def _heavy(groups: DataFrame) -> DataFrame:
    return groups.groupBy("canon").agg(F.sum("n").alias("w")).orderBy(F.desc("w"), "canon").limit(HEAVY_KEYS).select("canon")


def _groups(rows: DataFrame, *more: str) -> DataFrame:
    """References counted per key and month, with the first and last of their times."""
    period = F.date_trunc("month", "at").alias("period")
    return rows.groupBy(*more, "canon", period).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first_ref"), F.max("at").alias("last_ref"))


def _orphan_groups(groups: DataFrame, states: DataFrame, heavy: DataFrame) -> DataFrame:
    """The groups with an orphan, ``reason``, and ``first_at`` where only the references before it are orphans."""
    late = (F.col("first_at").isNotNull()) & (F.col("first_ref") < F.col("first_at"))
    why = F.when(F.col("gone"), F.lit("removed")).when(late, F.lit("late"))
    bounded = F.broadcast(heavy)
    known = F.broadcast(bounded.join(states.join(bounded, "canon", "left_semi"), "canon", "left"))
    hot = groups.join(known, "canon").withColumn("reason", F.when(F.col("gone").isNull(), F.lit("missing")).otherwise(why))
    cold = groups.join(bounded, "canon", "left_anti")
    missing = cold.join(states, "canon", "left_anti").withColumn("reason", F.lit("missing"))
    held = cold.join(states.filter("gone OR first_at IS NOT NULL"), "canon").withColumn("reason", why)
    found = hot.unionByName(held).unionByName(missing, allowMissingColumns=True).filter("reason IS NOT NULL")
    mixed = (F.col("reason") == "late") & (F.col("last_ref") >= F.col("first_at"))
    return found.withColumn("first_at", F.when(mixed, F.col("first_at"))).drop("gone")


def _rows_of(groups: DataFrame, rows: DataFrame, heavy: DataFrame, keys: list[str], most: int) -> DataFrame:
    """Rows of stored groups that are orphans: all of a group, or those before its ``first_at``."""
    dated = rows.withColumn("period", F.date_trunc("month", "at"))
    same = F.lit(True)
    for key in keys:
        same = same & F.col(f"r.{key}").eqNullSafe(F.col(f"g.{key}"))
    before = F.col("g.first_at").isNull() | (F.col("r.at") < F.col("g.first_at"))
    columns = ["r.*", "g.reason"]

    def meet(r: DataFrame, g: DataFrame) -> DataFrame:
        return r.alias("r").join(g.alias("g"), same).filter(before).select(*columns)

    wanted = groups.select(*keys, "first_at", "reason")
    if groups.count() <= most:
        return meet(dated, F.broadcast(wanted))
    bounded = F.broadcast(heavy)
    # the months of a heavy key are few, so its groups are sent to the rows
    hot = meet(dated.join(bounded, "canon", "left_semi"), F.broadcast(wanted.join(bounded, "canon", "left_semi")))
    cold = meet(dated.join(bounded, "canon", "left_anti"), wanted.join(bounded, "canon", "left_anti"))
    return hot.unionByName(cold)


def orphan_references(edges: DataFrame, counts: DataFrame, decisions: DataFrame, removed: DataFrame, most: int = SENT_GROUPS) -> DataFrame:
    """(ref_table, ref_field, ref_key, reason): every orphan reference once."""
    rows = reference_rows(edges, counts)
    groups = checkpointed(_groups(rows))
    heavy = checkpointed(_heavy(groups))
    orphans = checkpointed(_orphan_groups(groups, decision_states(decisions, removed), heavy))
    found = _rows_of(orphans, rows, heavy, ["canon", "period"], most)
    return found.select("ref_table", "ref_field", "ref_key", "reason").distinct()


def orphan_report(edges: DataFrame, counts: DataFrame, decisions: DataFrame, removed: DataFrame, most: int = SENT_GROUPS) -> DataFrame:
    """(ref_table, ref_field, period, reason, n_refs, n_keys): orphan counts per table and month.

    Counts come from the groups. Only in the month of a key's first delivery a group may hold late and timely references;
    the late ones are counted from the rows.
    """
    by = ["ref_table", "ref_field", "canon", "period"]
    rows = reference_rows(edges, counts)
    groups = checkpointed(_groups(rows, "ref_table", "ref_field"))
    heavy = checkpointed(_heavy(groups))
    orphans = checkpointed(_orphan_groups(groups, decision_states(decisions, removed), heavy))
    mixed = _rows_of(orphans.filter("first_at IS NOT NULL"), rows, heavy, by, most).groupBy(*by, "reason").agg(F.count(F.lit(1)).alias("n"))
    counted = orphans.filter("first_at IS NULL").select(*by, "reason", "n").unionByName(mixed.select(*by, "reason", "n"))
    period = F.coalesce(F.date_format("period", "yyyy-MM"), F.lit("unknown")).alias("period")
    return counted.groupBy("ref_table", "ref_field", period, "reason").agg(F.sum("n").alias("n_refs"), F.count(F.lit(1)).alias("n_keys"))
