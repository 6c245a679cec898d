"""Samples that match target proportions of categories.

Method: divisor priorities. Every record gets its pseudo-random rank inside its category; its priority is
``(rank - 0.5) / target``. The records that fill the minimum floors come first, then the globally smallest priorities
until the sample is full. A category that runs out of records simply has no further priorities, so its seats go to the
others.

Targets are stated per dimension and the dimensions contradict each other (courts of one canton may be asked for more
often than the canton), so every dimension has a sample of its own, all of the same size and by the same ranks.

The seats of the categories follow from their counts alone: ranks are 1, 2, 3 ..., so the counts say how many
priorities lie below a threshold. The counts are as many numbers as the target table has rows, whatever the size of
the data; only they meet on the driver. Records are taken by exact distributed ranks (``operators.hashrank``), so no
category, however large, is held or sorted by one task.

Whether a target can be met is read off the drawn ranks: a category that got fewer seats than it needs fails if its
ranks end before the need.

Defined cases: one row per canonical id, the one with the latest ``indexed_at`` (ties: the largest row); only rows with
a full text; NULL, empty and unknown values belong to no category; an empty pool gives an empty sample and a report in
which only needs of zero are met; repeated target rows count once; floors that add up to more than the sample are cut
by priority, too; categories without a target get records only when those with one are used up.
"""

from __future__ import annotations

from fractions import Fraction
from heapq import heapify, heappop, heappush

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelgrid.functions.identity import canonical_id
from gavelgrid.operators.hashrank import hash_rank
from gavelgrid.sources.tables import require

MOST_TARGETS = 10_000  # rows of the target table; more are an error
DIMENSIONS = ("language", "canton", "court", "period")

# Notations of the languages.
LANGUAGES = {
    "de": ("de", "deu", "ger", "german", "deutsch"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais"),
    "it": ("it", "ita", "italian", "italiano"),
    "rm": ("rm", "roh", "romansh", "romansch", "rumantsch"),
    "en": ("en", "eng", "english"),
}
# Names of the cantons.
CANTONS = {
    "AG": ("aargau", "argovie", "argovia"),
    "AI": ("appenzell innerrhoden", "appenzell rhodes-intérieures", "appenzell inner rhodes"),
    "AR": ("appenzell ausserrhoden", "appenzell rhodes-extérieures", "appenzell outer rhodes"),
    "BE": ("bern", "berne", "berna"),
    "BL": ("basel-landschaft", "basel-land", "baselland", "bâle-campagne"),
    "BS": ("basel-stadt", "bâle-ville", "basilea città"),
    "CH": ("bund", "schweiz", "suisse", "svizzera", "switzerland", "confédération", "eidgenossenschaft"),
    "FR": ("freiburg", "fribourg", "friburgo"),
    "GE": ("genf", "genève", "geneve", "geneva", "ginevra"),
    "GL": ("glarus", "glaris", "glarona"),
    "GR": ("graubünden", "grisons", "grigioni", "grischun"),
    "JU": ("jura", "giura"),
    "LU": ("luzern", "lucerne", "lucerna"),
    "NE": ("neuenburg", "neuchâtel", "neuchatel"),
    "NW": ("nidwalden", "nidwald"),
    "OW": ("obwalden", "obwald"),
    "SG": ("st. gallen", "sankt gallen", "st.gallen", "saint-gall", "san gallo"),
    "SH": ("schaffhausen", "schaffhouse", "sciaffusa"),
    "SO": ("solothurn", "soleure", "soletta"),
    "SZ": ("schwyz", "svitto"),
    "TG": ("thurgau", "thurgovie", "turgovia"),
    "TI": ("tessin", "ticino"),
    "UR": ("uri",),
    "VD": ("waadt", "vaud"),
    "VS": ("wallis", "valais", "vallese"),
    "ZG": ("zug", "zoug", "zugo"),
    "ZH": ("zürich", "zurich", "zurigo", "zuerich"),
}
PERIODS = ((1875, 1953, "1875-1953"), (1954, 1999, "1954-1999"), (2000, 2009, "2000-2009"), (2010, 2019, "2010-2019"), (2020, 2999, "2020+"))


def _lookup(value: Column, names: dict[str, tuple[str, ...]]) -> Column:
    pairs = [F.lit(x) for code, spellings in names.items() for name in (code.lower(), *spellings) if name for x in (name, code)]
    seen, unique = set(), []
    for i in range(0, len(pairs), 2):
        key = str(pairs[i])
        if key not in seen:
            seen.add(key)
            unique += pairs[i : i + 2]
    return F.try_element_at(F.create_map(*unique), value)


def language_of(value: Column) -> Column:
    """Code of a language in any notation (case, blanks, region suffix, three letters, name), else NULL."""
    return _lookup(F.regexp_extract(F.lower(F.trim(value)), r"^([^-_]+)", 1), LANGUAGES)


def canton_of(value: Column) -> Column:
    """Code of a canton in any notation, else NULL."""
    return _lookup(F.regexp_replace(F.lower(F.trim(value)), r"^(?:kanton|canton de|canton|cantone) ", ""), CANTONS)


def court_of(value: Column) -> Column:
    name = F.lower(F.trim(value))
    return F.when(name == "bge_historical", F.lit("bge")).otherwise(name)


def period_of(value: Column) -> Column:
    """Period of the year stated in a date, however it is written; ``unknown`` without a year from 1875 on."""
    text = F.trim(value)
    stated = F.coalesce(
        F.when(text.rlike(r"^[0-9]{8}$"), F.substring(text, 1, 4)),
        F.nullif(F.regexp_extract(text, r"(?:^|[^0-9])([0-9]{4})(?:[^0-9]|$)", 1), F.lit("")),
    )
    year = stated.try_cast("int")
    found = F.lit("unknown")
    for first, last, name in PERIODS:
        found = F.when(year.between(first, last), F.lit(name)).otherwise(found)
    return found


def sampling_pool(decisions: DataFrame) -> DataFrame:
    """(decision_id, language, canton, court, period): one row per canonical id with a full text."""
    rows = require(
        decisions, decision_id="string", indexed_at="timestamp_ntz", has_full_text="boolean",
        language="string", canton="string", court="string", decision_date="string",
    ).filter("decision_id IS NOT NULL")
    fields = ("indexed_at", "decision_id", "has_full_text", "language", "canton", "court", "decision_date")
    latest = rows.groupBy(canonical_id(F.col("decision_id")).alias("id")).agg(F.max(F.struct(*fields)).alias("r"))
    return latest.filter("r.has_full_text").select(
        F.col("id").alias("decision_id"),
        language_of(F.col("r.language")).alias("language"),
        canton_of(F.col("r.canton")).alias("canton"),
        court_of(F.col("r.court")).alias("court"),
        period_of(F.col("r.decision_date")).alias("period"),
    )


def divisor_seats(targets: np.ndarray, counts: np.ndarray, n: int, floors: np.ndarray | None = None) -> np.ndarray:
    """How many of the ``n`` records that come first each category holds: floors, then priorities (rank - 0.5) / target.

    Ties go to the earlier category. The threshold is found by halving; the last seats are given one by one, by
    priorities compared as fractions.
    """
    targets = np.asarray(targets, dtype=float)
    counts = np.asarray(counts, dtype=np.int64)
    floors = np.minimum(np.zeros_like(counts) if floors is None else floors, counts)
    n = int(min(n, counts.sum()))
    if floors.sum() >= n and floors.any():
        counts, floors = floors, np.zeros_like(counts)
    seats = floors.copy()
    for weight in (targets, np.where(targets > 0, 0, counts).astype(float)):
        live = np.flatnonzero(weight > 0)  # categories without a target come last
        left = min(n - int(np.delete(seats, live).sum()), int(counts[live].sum()))
        if left <= seats[live].sum() or not len(live):
            continue
        w, most, least = weight[live], counts[live], seats[live]
        below = lambda t: np.maximum(np.minimum(np.floor(t * w + 0.5), most), least).astype(np.int64)
        low, high = 0.0, 1.0
        while below(high).sum() < left:
            high *= 2
        for _ in range(100):
            middle = (low + high) / 2
            low, high = (middle, high) if below(middle).sum() < left else (low, middle)
        got = np.maximum(np.minimum(np.floor(low * w * (1 - 1e-9) + 0.5) - 1, most), least).astype(np.int64)
        priority = lambda i: (Fraction(2 * int(got[i]) + 1) / Fraction(w[i]), i)
        heap = [priority(i) for i in range(len(live)) if got[i] < most[i]]
        heapify(heap)
        for _ in range(left - int(got.sum())):
            i = heappop(heap)[1]
            got[i] += 1
            if got[i] < most[i]:
                heappush(heap, priority(i))
        seats[live] = got
    return seats


def _targets(targets: DataFrame) -> list[tuple[str, str, int, int]]:
    """The target table, a parameter of at most ``MOST_TARGETS`` rows, sorted."""
    rows = require(targets, dimension="string", category="string", target_pct="int", min_rows="int")
    picked = rows.filter("dimension IS NOT NULL AND category IS NOT NULL").distinct().limit(MOST_TARGETS + 1).collect()
    if len(picked) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets")
    best = {(r.dimension, r.category): (r.target_pct or 0, r.min_rows or 0) for r in sorted(picked, key=lambda r: tuple(map(str, r)))}
    return [(d, c, pct, least) for (d, c), (pct, least) in sorted(best.items())]


class ProportionalSample:
    """``rows`` (dimension, category, decision_id, rank, floor, priority): the samples; ``report``: every target row with
    what it needs, what the pool holds and what was drawn."""

    def __init__(self, pool: DataFrame, targets: DataFrame, fraction: float = 0.2, seed: int = 42, dimensions: tuple[str, ...] = DIMENSIONS) -> None:
        spark = pool.sparkSession
        wanted = [t for t in _targets(targets) if t[0] in dimensions]
        values = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("category")) for d in dimensions]))
        named = F.broadcast(spark.createDataFrame([t[:2] for t in wanted] or [("", "")], "dimension string, category string"))
        long = pool.select("decision_id", values.alias("v")).select("decision_id", "v.*").join(named, ["dimension", "category"])
        size = int(pool.count() * fraction + 1e-9)
        held = {(r.dimension, r.category): r.n for r in long.groupBy("dimension", "category").agg(F.count(F.lit(1)).alias("n")).collect()}

        plan = []
        for dimension in dimensions:
            own = [t for t in wanted if t[0] == dimension]
            counts = np.array([held.get(t[:2], 0) for t in own], dtype=np.int64)
            seats = divisor_seats(np.array([t[2] for t in own]), counts, size, np.array([t[3] for t in own], dtype=np.int64)) if own else []
            plan += [
                (d, c, float(pct), least, max(least, -(-pct * size // 100)), int(n), int(s)) for (d, c, pct, least), n, s in zip(own, counts, seats)
            ]
        table = spark.createDataFrame(plan, "dimension string, category string, target double, least int, needed bigint, pool_rows bigint, seats bigint")
        # ranks up to the seats make the sample; those up to the need tell whether a category that got less runs out
        table = table.withColumn("reach", F.greatest("seats", "needed"))
        ranked = hash_rank(long.join(F.broadcast(table), ["dimension", "category"]), ["dimension", "category"], "decision_id", seed, quota="reach")
        seated = F.col("hash_rank") <= F.col("seats")
        floor = F.col("hash_rank") <= F.col("least")
        priority = F.when(F.col("target") > 0, (F.col("hash_rank") - 0.5) / F.col("target"))
        columns = ("dimension", "category", "decision_id", F.col("hash_rank").alias("rank"), floor.alias("floor"), priority.alias("priority"))
        self.rows = ranked.filter(seated).select(*columns)
        got = ranked.groupBy("dimension", "category").agg(F.count_if(seated).alias("drawn"), F.max("hash_rank").alias("reached"))
        met = (F.col("drawn") >= F.col("needed")) | (F.coalesce("reached", F.lit(0)) >= F.col("needed"))
        self.report = (
            table.join(got, ["dimension", "category"], "left")
            .withColumn("drawn", F.coalesce("drawn", F.lit(0)))
            .select(
                "dimension", "category", F.col("target").cast("int").alias("target_pct"), F.col("least").alias("min_rows"), "needed", "pool_rows", "drawn",
                met.alias("can_be_met"),
                F.round(F.col("drawn") * 100.0 / max(1, size), 3).alias("sample_pct"),
            )
        )
