"""Queries of the proportional sample."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gavelgrid.llm.proportions import CANTONS, LANGUAGES, ProportionalSample, sampling_pool
from gavelgrid.plans.orphans import sql_canonical
from gavelgrid.plans.registry import Registry
from gavelgrid.sources.tables import table

REGISTRY = Registry()


def _values(names: dict[str, tuple[str, ...]]) -> str:
    pairs = sorted({(spelling, code) for code, spellings in names.items() for spelling in (code.lower(), *spellings)})
    return ", ".join(f"('{a}', '{b}')" for a, b in pairs)


_LONG = f"""
languages(spelling, code) AS (VALUES {_values(LANGUAGES)}), cantons(spelling, code) AS (VALUES {_values(CANTONS)}),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY {sql_canonical('decision_id')}
    ORDER BY indexed_at DESC NULLS LAST, decision_id DESC NULLS LAST, has_full_text DESC NULLS LAST, language DESC NULLS LAST,
             canton DESC NULLS LAST, court DESC NULLS LAST, decision_date DESC NULLS LAST) AS rn
  FROM decisions WHERE decision_id IS NOT NULL
), pool AS (
  SELECT {sql_canonical('decision_id')} AS id, l.code AS language, c.code AS canton,
         CASE lower(trim(court)) WHEN 'bge_historical' THEN 'bge' ELSE lower(trim(court)) END AS court,
         TRY_CAST(CASE WHEN regexp_full_match(trim(decision_date), '[0-9]{{8}}') THEN left(trim(decision_date), 4)
                       ELSE regexp_extract(trim(decision_date), '(?:^|[^0-9])([0-9]{{4}})(?:[^0-9]|$)', 1) END AS INT) AS y
  FROM ranked LEFT JOIN languages l ON l.spelling = regexp_extract(lower(trim(language)), '^([^-_]+)', 1)
              LEFT JOIN cantons c ON c.spelling = lower(trim(canton))
  WHERE rn = 1 AND has_full_text
), long AS (
  SELECT id, 'language' AS dimension, language AS category FROM pool UNION ALL SELECT id, 'canton', canton FROM pool
  UNION ALL SELECT id, 'court', court FROM pool
  UNION ALL SELECT id, 'period', CASE WHEN y BETWEEN 1875 AND 1953 THEN '1875-1953' WHEN y BETWEEN 1954 AND 1999 THEN '1954-1999'
    WHEN y BETWEEN 2000 AND 2009 THEN '2000-2009' WHEN y BETWEEN 2010 AND 2019 THEN '2010-2019' WHEN y >= 2020 AND y <= 2999 THEN '2020+' ELSE 'unknown' END FROM pool
)
"""

FOUND_SQL = f"""WITH {_LONG}
SELECT DISTINCT t.dimension, t.category FROM sample_targets t
LEFT JOIN (SELECT dimension, category, count(*) AS held FROM long GROUP BY ALL) h USING (dimension, category)
WHERE coalesce(held, 0) < greatest(min_rows, ceil(target_pct * (SELECT count(*) // 5 FROM pool) / 100.0))
"""

_DRAWN = f"""{_LONG}, targets AS (
  SELECT DISTINCT dimension, category, target_pct, min_rows FROM sample_targets
), ranks AS (
  SELECT l.dimension, l.category, id AS decision_id, target_pct, min_rows,
         row_number() OVER (PARTITION BY l.dimension, l.category ORDER BY md5(id || ':42'), id) AS rank,
         count(*) OVER (PARTITION BY l.dimension, l.category) AS held
  FROM long l JOIN targets t USING (dimension, category)
), priorities AS (
  SELECT *, rank <= min_rows AS floor, CASE WHEN target_pct > 0 THEN (CAST(rank AS DOUBLE) - 0.5) / target_pct END AS priority FROM ranks
), drawn AS (
  SELECT * FROM priorities QUALIFY row_number() OVER (PARTITION BY dimension
    ORDER BY floor DESC, coalesce(priority, (CAST(rank AS DOUBLE) - 0.5) / held + 1e9), category) <= (SELECT count(*) // 5 FROM pool)
)"""

SAMPLE_SQL = f"WITH {_DRAWN} SELECT dimension, category, decision_id, rank, floor, priority FROM drawn"

REPORT_SQL = f"""WITH {_DRAWN}, size AS (SELECT CAST(count(*) // 5 AS BIGINT) AS n FROM pool)
SELECT dimension, category, target_pct, min_rows, needed, pool_rows, drawn, pool_rows >= needed AS can_be_met,
       round(drawn * 100.0 / greatest(1, n), 3) AS sample_pct
FROM (
  SELECT t.*, n, CAST(greatest(min_rows, ceil(target_pct * n / 100.0)) AS BIGINT) AS needed,
         coalesce(held, 0) AS pool_rows, coalesce(got, 0) AS drawn
  FROM targets t CROSS JOIN size
  LEFT JOIN (SELECT dimension, category, count(*) AS held FROM long GROUP BY ALL) h USING (dimension, category)
  LEFT JOIN (SELECT dimension, category, count(*) AS got FROM drawn GROUP BY ALL) g USING (dimension, category)
)"""


def _sample(spark: SparkSession, base: str) -> ProportionalSample:
    columns = ("decision_id", "indexed_at", "has_full_text", "language", "canton", "court", "decision_date")
    return ProportionalSample(sampling_pool(table(spark, base, "decisions", columns)), table(spark, base, "sample_targets"))


@REGISTRY.query("p4_found", FOUND_SQL)
def found(spark: SparkSession, base: str) -> DataFrame:
    return _sample(spark, base).report.filter("NOT can_be_met").select("dimension", "category").distinct()


@REGISTRY.query("p4_sample", SAMPLE_SQL)
def sample(spark: SparkSession, base: str) -> DataFrame:
    return _sample(spark, base).rows


@REGISTRY.query("p4_report", REPORT_SQL)
def report(spark: SparkSession, base: str) -> DataFrame:
    return _sample(spark, base).report
