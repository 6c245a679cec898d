"""Derived facet columns, facet filters, value resolution and facet counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bounds of the periods.
PERIOD_STARTS = ((1954, "1875-1953"), (2000, "1954-1999"), (2010, "2000-2009"), (2020, "2010-2019"))


def year_of(date: Column) -> Column:
    """Year of an ISO date string; NULL where the first four characters are no number."""
    first = F.substring(date, 1, 4)
    return F.when(first.rlike("^[0-9]{4}$"), first).try_cast("int")


def period(year: Column) -> Column:
    label = F.when(year.isNull(), F.lit("unknown"))
    for before, name in PERIOD_STARTS:
        label = label.when(year < before, F.lit(name))
    return label.otherwise(F.lit("2020+"))


def jurisdiction(court: Column, canton: Column) -> Column:
    """The court on federal level, else the canton; a historical series counts as the current one."""
    current = F.when(court == "bge_historical", F.lit("bge")).otherwise(court)
    return F.when(canton == "CH", current).otherwise(canton)


def int_date(date: Column) -> Column:
    """``YYYYMMDD``, 0 for an unknown date."""
    return F.coalesce(F.substring(F.regexp_replace(date, "[^0-9]", ""), 1, 8).try_cast("int"), F.lit(0))


def mapped(value: Column, words: Mapping[str, str], default: str = "") -> Column:
    """Vocabulary mapping of a bounded set of words."""
    pairs = [F.lit(x) for pair in words.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), value), F.lit(default))


def facet_condition(wanted: Mapping[str, Sequence[str] | None], known: Mapping[str, Sequence[str]]) -> Column | None:
    """Values of one facet are alternatives, facets add up. ``None`` means no filter; unknown values are ignored; a
    facet whose values are all unknown matches nothing."""
    parts = []
    for facet, values in wanted.items():
        if values is None:
            continue
        usable = [v for v in values if v in known.get(facet, ())]
        parts.append(F.col(facet).isin(usable) if usable else F.lit(False))
    return reduce(lambda a, b: a & b, parts) if parts else None


def year_range(date: Column, first: int | None, last: int | None) -> Column:
    """``date`` as YYYYMMDD with 0 for unknown. An upper bound asks for a known date, a lower bound drops 0 by itself."""
    low = date >= first * 10_000 if first is not None else F.lit(True)
    high = (date < (last + 1) * 10_000) & (date > 0) if last is not None else F.lit(True)
    return low & high


def court_groups(rows: DataFrame, court: str, canton: str, key: str, named: Mapping[str, Sequence[str]]) -> DataFrame:
    """(court, court_group): named sets first, then ``cantonal`` by the canton of the court's first row, else ``federal_other``."""
    first = rows.filter(F.col(court).isNotNull()).groupBy(court).agg(F.min_by(canton, key).alias("home"))
    group = F.when(F.lit(False), F.lit(""))
    for name, members in named.items():
        group = group.when(F.col(court).isin(list(members)), F.lit(name))
    return first.select(court, group.when(F.col("home") != "CH", F.lit("cantonal")).otherwise(F.lit("federal_other")).alias("court_group"))


def selectivity(rows: DataFrame, conditions: Mapping[str, Column]) -> DataFrame:
    """One row: how many rows each condition keeps alone, and all of them together; one pass."""
    together = reduce(lambda a, b: a & b, conditions.values(), F.lit(True))
    return rows.agg(*[F.count_if(c).alias(name) for name, c in conditions.items()], F.count_if(together).alias("together"))


def resolve_values(asked: DataFrame, known: DataFrame, aliases: Mapping[str, str], fold) -> DataFrame:
    """(asked, value): exact, then folded, then alias, then the only value that starts with or contains it; else NULL.

    ``asked`` (asked) are the inputs of a user and ``known`` (value) a vocabulary, both small; the pairs for the last
    step are found by one join of the two.
    """
    asked = asked.withColumn("f", fold(F.col("asked")))
    known = known.withColumn("kf", fold(F.col("value")))
    alias = asked.select("asked", F.explode(F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])).alias("a", "value"), "f").filter("f = a")
    exact = asked.join(known, asked["asked"] == known["value"]).select("asked", "value", F.lit(1).alias("step"))
    folded = asked.join(known, asked["f"] == known["kf"]).groupBy("asked").agg(F.min("value").alias("value")).withColumn("step", F.lit(2))
    by_alias = alias.join(known.select("value"), "value").select("asked", "value", F.lit(3).alias("step"))
    near = asked.join(F.broadcast(known), F.col("kf").contains(F.col("f")) & (F.length("f") > 0))
    start = near.filter(F.col("kf").startswith(F.col("f")))
    only = lambda df, step: df.groupBy("asked").agg(F.min("value").alias("value"), F.count_distinct("value").alias("n")).filter("n = 1").select("asked", "value", F.lit(step).alias("step"))
    steps = exact.unionByName(folded).unionByName(by_alias).unionByName(only(start, 4)).unionByName(only(near, 5))
    best = steps.groupBy("asked").agg(F.min_by("value", "step").alias("value"))
    return asked.select("asked").distinct().join(best, "asked", "left")


def breakdown(rows: DataFrame, dimensions: Mapping[str, Column]) -> DataFrame:
    """(dimension, value, n): counts of every dimension in one pass over grouping sets; NULL values are left out."""
    named = rows.select(*[c.cast("string").alias(d) for d, c in dimensions.items()])
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in dimensions])).alias("p")
    return named.select(pairs).select("p.*").filter("value IS NOT NULL").groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n"))


def vocabulary(rows: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """Values with their counts, NULL and empty ones left out, most frequent first."""
    counted = rows.filter((F.col(column).isNotNull()) & (F.col(column) != "")).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    ordered = counted.orderBy(F.desc("n"), "value")
    return ordered.limit(limit) if limit else ordered
