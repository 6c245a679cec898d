"""Reproducible sample that stays stable as data grows.

Method: a persisted selection ledger. All keys of earlier waves are kept by a join; growth quotas are filled from keys
not seen before, those with the lowest hash priority first.

A wave is the month in which an id was first delivered. Each month may hold ``ceil(rate * ids of the month)``
selected ids; earlier picks count first, the rest of the quota goes to unseen ids of that month. A later delivery opens
later months, so it takes nothing from the earlier ones. ``run_wave`` is the job of a wave: it writes the picks back to
the ledger, so that no later row, not even one delivered late into an old month, can push out an earlier pick.

Defined cases: ids are compared in their canonical form, repeats and spellings are one id; NULL and empty ids are
nobody; ids without any ``indexed_at`` form a wave of their own (``unknown``); earlier picks that the table no longer
holds stay in the result with ``present = false`` and take no part of a quota; with an empty ledger everything comes
from the quotas; ties of the hash fall to the smaller id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavelgrid.functions.identity import canonical_id
from gavelgrid.operators.hashrank import hash_rank
from gavelgrid.sources.tables import empty, require
from gavelgrid.streaming.events import newest_version, publish_version, read_version


def selection(decisions: DataFrame, ledger: DataFrame, rate: float, seed: int = 42) -> DataFrame:
    """(decision_id, origin, ledger_wave, month, present): the ledger's ids and the new picks."""
    if not 0 <= rate <= 1:
        raise ValueError("rate must lie between 0 and 1")
    rows = require(decisions, decision_id="string", indexed_at="timestamp_ntz").select(
        canonical_id(F.col("decision_id")).alias("decision_id"), "indexed_at"
    )
    picked = require(ledger, decision_id="string", wave="int").select(
        canonical_id(F.col("decision_id")).alias("decision_id"), F.coalesce("wave", F.lit(0)).alias("wave"), F.lit(True).alias("picked")
    )
    both = rows.select("decision_id", "indexed_at", F.lit(None).cast("int").alias("wave"), F.lit(False).alias("picked")).unionByName(
        picked.withColumn("indexed_at", F.lit(None).cast("timestamp_ntz"))
    )
    ids = (
        both.filter("decision_id <> ''")
        .groupBy("decision_id")
        .agg(
            F.min("indexed_at").alias("first_at"),
            F.min("wave").alias("ledger_wave"),
            F.max("picked").alias("kept"),
            F.max(~F.col("picked")).alias("present"),
        )
        .withColumn("month", F.coalesce(F.date_format("first_at", "yyyy-MM"), F.lit("unknown")))
    )
    sizes = ids.filter("present").groupBy("month").agg(
        F.count(F.lit(1)).alias("held"), F.count_if("kept").alias("taken")
    )
    quotas = sizes.select("month", F.greatest(F.ceil(F.col("held") * F.lit(float(rate))) - F.col("taken"), F.lit(0)).alias("quota"))
    unseen = ids.filter("present AND NOT kept").join(quotas, "month")
    fresh = hash_rank(unseen, ["month"], "decision_id", seed, quota="quota")
    columns = ("decision_id", "origin", "ledger_wave", "month", "present")
    kept = ids.filter("kept").withColumn("origin", F.lit("ledger"))
    return kept.select(*columns).unionByName(fresh.withColumn("origin", F.lit("new")).select(*columns))


def advance_ledger(ledger: DataFrame, selected: DataFrame, wave: int, at: str) -> DataFrame:
    """The ledger with the new picks of ``selected`` appended as one wave, to be written as the next ledger."""
    fresh = selected.filter("origin = 'new'").select(
        "decision_id", F.lit(wave).cast("int").alias("wave"), F.lit(at).cast("timestamp_ntz").alias("selected_at")
    )
    return require(ledger, decision_id="string", wave="int", selected_at="timestamp_ntz").unionByName(fresh)


def run_wave(decisions: DataFrame, target: str, rate: float, wave: int, at: str, seed: int = 42) -> DataFrame:
    """A wave as a job: selects by the newest ledger in the versioned table ``target`` (none yet: an empty one) and
    publishes the ledger with the new picks. A wave that is published already is not drawn again. Returns the ledger."""
    spark = decisions.sparkSession
    name, newest = f"wave{wave:08d}", newest_version(spark, target)
    if newest is None or newest < name:
        held = read_version(spark, target)
        ledger = held if held is not None else empty(spark, "decision_id string, wave int, selected_at timestamp_ntz")
        publish_version(advance_ledger(ledger, selection(decisions, ledger, rate, seed), wave, at), target, name)
    return read_version(spark, target)
