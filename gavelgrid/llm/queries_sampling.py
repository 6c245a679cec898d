"""Queries of the ledger sample and of the splitter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gavelgrid.llm import ledger, splitting
from gavelgrid.plans.orphans import sql_canonical
from gavelgrid.plans.registry import Registry
from gavelgrid.sources.tables import table

REGISTRY = Registry()
RATE, SEED = 0.4, 42

LEDGER_SQL = f"""
WITH held AS (
  SELECT {sql_canonical('decision_id')} AS decision_id, coalesce(strftime(min(indexed_at), '%Y-%m'), 'unknown') AS month
  FROM decisions WHERE decision_id <> '' GROUP BY 1
), picked AS (
  SELECT {sql_canonical('decision_id')} AS decision_id, min(coalesce(wave, 0)) AS ledger_wave
  FROM selected_decisions WHERE decision_id <> '' GROUP BY 1
), quota AS (
  SELECT month, greatest(ceil(count(*) * CAST({RATE} AS DOUBLE)) - count(p.decision_id), 0) AS quota
  FROM held h LEFT JOIN picked p USING (decision_id) GROUP BY 1
), fresh AS (
  SELECT decision_id, month, row_number() OVER (PARTITION BY month ORDER BY md5(decision_id || ':{SEED}'), decision_id) AS rn
  FROM held ANTI JOIN picked USING (decision_id)
)
SELECT decision_id, 'ledger' AS origin, ledger_wave, coalesce(month, 'unknown') AS month, month IS NOT NULL AS present
FROM picked LEFT JOIN held USING (decision_id)
UNION ALL
SELECT decision_id, 'new', NULL, month, true FROM fresh JOIN quota USING (month) WHERE rn <= quota
"""

FOUND_SQL = r"""
SELECT DISTINCT 'decisions' AS item_table, decision_id AS item_key FROM decisions
WHERE decision_id IS NOT NULL AND length(trim(full_text, ' ' || chr(9) || chr(10))) > 2200
UNION
SELECT DISTINCT 'chunks', CAST(id AS VARCHAR) FROM chunks WHERE id IS NOT NULL AND length(trim(text, ' ' || chr(9) || chr(10))) > 2200
"""


@REGISTRY.query("p1_ledger_sample", LEDGER_SQL)
def ledger_sample(spark: SparkSession, base: str) -> DataFrame:
    return ledger.selection(
        table(spark, base, "decisions", ("decision_id", "indexed_at")),
        table(spark, base, "selected_decisions", ("decision_id", "wave")),
        RATE,
        SEED,
    )


def _texts(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    return (
        table(spark, base, "decisions", ("decision_id", "full_text")),
        table(spark, base, "chunks", ("id", "decision_id", "char_start", "text")),
    )


@REGISTRY.query("p2_found", FOUND_SQL)
def found(spark: SparkSession, base: str) -> DataFrame:
    return splitting.oversized(*_texts(spark, base))


@REGISTRY.query("p2_pieces")
def pieces(spark: SparkSession, base: str) -> DataFrame:
    return splitting.oversized_pieces(*_texts(spark, base))
