"""Problem 3: references to records that do not exist."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gavelgrid.operators import references
from gavelgrid.plans.registry import Registry
from gavelgrid.sources.tables import table

REGISTRY = Registry()


def sql_canonical(column: str) -> str:
    """The canonical id of a column in the checking SQL."""
    pattern = r"^(?:bge[_ ]*(?:historical[_ ]*)?)?(?:(?:BGE|ATF|DTF)[_ ]*)?([0-9]{1,3})[_ ]+([IVX]+)([ab]?)[_ ]+([0-9]+)\s*$"
    group = lambda n: f"regexp_extract({column}, '{pattern}', {n}, 'i')"
    return (
        f"CASE WHEN regexp_matches({column}, '{pattern}', 'i') THEN 'bge_BGE_' || {group(1)} || '_' || upper({group(2)})"
        f" || lower({group(3)}) || '_' || {group(4)} ELSE {column} END"
    )


_REFS = f"""
refs AS (
  SELECT ref_table, ref_field, ref_key, {sql_canonical('id')} AS canon, seen FROM (
    SELECT 'edges' AS ref_table, 'source' AS ref_field, CAST(edge_id AS VARCHAR) AS ref_key, source AS id, recorded_at AS seen FROM edges
    UNION ALL SELECT 'edges', 'target', CAST(edge_id AS VARCHAR), target, recorded_at FROM edges
    UNION ALL SELECT 'counts', 'cited_by', decision_id, decision_id, built_at FROM counts WHERE cited_by > 0
  ) WHERE id IS NOT NULL AND id <> ''
),
held AS (
  SELECT {sql_canonical('decision_id')} AS canon, min(indexed_at) AS first_at, max(indexed_at) AS last_at,
         bool_or(indexed_at IS NULL) AS always
  FROM decisions WHERE decision_id IS NOT NULL GROUP BY 1
),
gone AS (SELECT {sql_canonical('decision_id')} AS canon, max(removed_at) AS gone_at FROM removed_decisions GROUP BY 1),
judged AS (
  SELECT r.*, CASE WHEN h.canon IS NULL THEN 'missing'
                   WHEN g.gone_at IS NOT NULL AND (h.last_at IS NULL OR g.gone_at > h.last_at) THEN 'removed'
                   WHEN NOT h.always AND r.seen < h.first_at THEN 'late' END AS reason
  FROM refs r LEFT JOIN held h USING (canon) LEFT JOIN gone g USING (canon)
)
"""

FOUND_SQL = f"WITH {_REFS} SELECT DISTINCT ref_table, ref_field, ref_key FROM judged WHERE reason IS NOT NULL"
REPORT_SQL = f"""WITH {_REFS}
SELECT ref_table, ref_field, period, reason, CAST(count(*) AS BIGINT) AS n_refs, CAST(count(DISTINCT canon) AS BIGINT) AS n_keys
FROM (SELECT *, coalesce(strftime(seen, '%Y-%m'), 'unknown') AS period FROM judged WHERE reason IS NOT NULL) GROUP BY ALL"""


def _tables(spark: SparkSession, base: str) -> tuple[DataFrame, ...]:
    return tuple(
        table(spark, base, name, columns)
        for name, columns in (
            ("edges", ("edge_id", "source", "target", "recorded_at")),
            ("counts", ("decision_id", "cited_by", "built_at")),
            ("decisions", ("decision_id", "indexed_at")),
            ("removed_decisions", ("decision_id", "removed_at")),
        )
    )


@REGISTRY.query("p3_found", FOUND_SQL)
def found(spark: SparkSession, base: str) -> DataFrame:
    return references.orphan_references(*_tables(spark, base)).select("ref_table", "ref_field", "ref_key").distinct()


@REGISTRY.query("p3_orphan_report", REPORT_SQL)
def report(spark: SparkSession, base: str) -> DataFrame:
    return references.orphan_report(*_tables(spark, base))
