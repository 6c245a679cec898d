"""Fusing, scoring and selecting ranked candidates."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def diverse_top_k(rows: DataFrame, query: list[str], document: str, order: Column, key: str, per_document: int, k: int) -> DataFrame:
    """Per query the k best rows, at most ``per_document`` of one document; adds ``rank``."""
    own = Window.partitionBy(*query, document).orderBy(order, key)
    best = Window.partitionBy(*query).orderBy(order, key)
    capped = rows.withColumn("_n", F.row_number().over(own)).filter(F.col("_n") <= per_document).drop("_n")
    return capped.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def ordered_union(pools: list[DataFrame], offsets: list[int]) -> DataFrame:
    """(id, pos): pools of (id, pos) one after the other; an id keeps its first place."""
    shifted = [p.select("id", (F.col("pos") + o).alias("pos")) for p, o in zip(pools, offsets)]
    return reduce(DataFrame.unionByName, shifted).groupBy("id").agg(F.min("pos").alias("pos"))


def rank_fusion(runs: DataFrame, query: list[str], item: str, rank: str, weights: Mapping[str, float] | None = None, constant: int = 60, zero_based: bool = False) -> DataFrame:
    """Reciprocal rank fusion of (query, source, item, rank): ``score = sum(weight / (constant + rank))``.

    ``rank`` counts from 1; with ``zero_based`` the best row contributes ``1 / constant``.
    """
    weight = F.lit(1.0)
    for source, value in (weights or {}).items():
        weight = F.when(F.col("source") == source, F.lit(float(value))).otherwise(weight)
    place = F.col(rank) - 1 if zero_based else F.col(rank)
    return runs.groupBy(*query, item).agg(F.sum(weight / (constant + place)).alias("score"))


def fuse_documents(runs: DataFrame, query: list[str], floor: int = 40, limit: int = 160, constant: int = 60, evidence: bool = True) -> DataFrame:
    """Fusion by judgment of (query, source, pos, item, document).

    Each source gives a judgment one vote, at its first hit, by its rank among the source's judgments; sources whose
    name starts with ``bge`` vote half. The first ``floor`` judgments of every source are reserved; the best are kept up
    to ``limit``, reserved ones first. Adds score, reserved and, unless ``evidence`` is off, evidence (all items, sorted) and
    representative (the first item seen).
    """
    seen = runs.groupBy(*query, "source", "document").agg(F.min("pos").alias("pos"))
    among = Window.partitionBy(*query, "source").orderBy("pos", "document")
    ranked = seen.withColumn("r", F.row_number().over(among))
    vote = F.when(F.col("source").startswith("bge"), 0.5).otherwise(1.0) / (constant + F.col("r"))
    scored = ranked.groupBy(*query, "document").agg(F.sum(vote).alias("score"), F.max((F.col("r") <= floor).cast("int")).alias("reserved"))
    kept = Window.partitionBy(*query).orderBy(F.desc("reserved"), F.desc(F.round("score", 9)), "document")
    limited = scored.withColumn("_n", F.row_number().over(kept)).filter(F.col("_n") <= limit).drop("_n")
    if not evidence:
        return limited
    items = runs.groupBy(*query, "document").agg(
        F.array_sort(F.collect_set("item")).alias("evidence"), F.min_by("item", F.struct("pos", "source", "item")).alias("representative")
    )
    return limited.join(items, [*query, "document"])


def authority_score(relevance: Column, cited_by: Column, leading: Column, native: Column, weight: float = 0.35, court: float = 0.5, cap: float = 1.5, bonus: float = 0.3) -> Column:
    """Relevance, a capped authority bonus of citations and court, and a bonus for the query's own language."""
    authority = F.least(F.lit(cap), weight * F.log1p(F.coalesce(cited_by, F.lit(0)).cast("double")) + F.when(leading, court).otherwise(0.0))
    return relevance + authority + F.when(native, bonus).otherwise(0.0)


def reserved_select(rows: DataFrame, query: list[str], k: int, margin: float = 2.0) -> DataFrame:
    """Selection with reservations over (query, document, language, own_language, leading, relevance, score).

    Reserved are the two most relevant judgments of the query's language, the most relevant of each other language, and
    the best leading case unless it is more than ``margin`` less relevant than the best. The rest fills up by score.
    """
    by_language = Window.partitionBy(*query, "language").orderBy(F.desc("relevance"), "document")
    by_court = Window.partitionBy(*query, "leading").orderBy(F.desc("relevance"), "document")
    top = F.max("relevance").over(Window.partitionBy(*query))
    marked = (
        rows.withColumn("_l", F.row_number().over(by_language))
        .withColumn("_c", F.row_number().over(by_court))
        .withColumn("_top", top)
        .withColumn(
            "reserved",
            (F.col("_l") <= F.when(F.col("language") == F.col("own_language"), 2).otherwise(1))
            | (F.col("leading") & (F.col("_c") == 1) & (F.col("relevance") >= F.col("_top") - margin)),
        )
    )
    fill = Window.partitionBy(*query).orderBy(F.desc("reserved"), F.desc("score"), "document")
    final = Window.partitionBy(*query).orderBy(F.desc("score"), "document")
    kept = marked.withColumn("_n", F.row_number().over(fill)).filter(F.col("_n") <= k).drop("_n", "_l", "_c", "_top")
    return kept.withColumn("rank", F.row_number().over(final))


def linear_score(features: Mapping[str, Column], weights: Mapping[str, float], means: Mapping[str, float], deviations: Mapping[str, float]) -> Column:
    """Weighted sum of standardised features; a feature without spread counts as 0."""
    terms = [F.lit(weights[n]) * ((c - means[n]) / deviations[n]) for n, c in features.items() if deviations[n]]
    return reduce(lambda a, b: a + b, terms, F.lit(0.0))


def learned_select(scored: DataFrame, query: list[str], identity: str, score: str, key: str, k: int) -> DataFrame:
    """Best record per identity, then the k best of each query; adds ``rank``."""
    return diverse_top_k(scored, query, identity, F.desc(score), key, per_document=1, k=k)


FEW_DOCUMENTS = 316  # documents whose pairs, at most 100,000, are broadcast


def feedback_profile(ranked: DataFrame, references: DataFrame, query: list[str], top: int = 20, few: int = FEW_DOCUMENTS) -> DataFrame:
    """Pseudo-relevance feedback: (query, document, share), how much of the profile of the best ``top`` documents a
    document refers to.

    ``ranked`` is (query, document, rank), ``references`` (document, reference, idf). A reference weighs idf / rank in
    the profile; the profile is normalised to 1 per query.

    Where at most ``few`` documents have references, what each two of them have in common is summed once for all queries
    and no reference meets a query. Otherwise every query gets the profile of its own documents.
    """
    cited = references.select("document", "reference").distinct()
    if references.select("document").distinct().limit(few + 1).count() > few:
        return _profiles(ranked, references, cited, query, top)
    common = references.join(cited.withColumnRenamed("document", "best"), "reference").groupBy(F.col("document").alias("best"), F.col("best").alias("document")).agg(F.sum("idf").alias("common"))
    whole = references.groupBy(F.col("document").alias("best")).agg(F.sum("idf").alias("whole"))
    best = ranked.filter(F.col("rank") <= top).select(*query, F.col("document").alias("best"), F.col("rank").alias("place"))
    total = F.sum(F.col("whole") / F.col("place")).over(Window.partitionBy(*query))
    weighed = best.join(F.broadcast(whole), "best").withColumn("total", total)
    met = ranked.select(*query, "document").join(weighed, query).join(F.broadcast(common), ["best", "document"])
    return met.groupBy(*query, "document").agg(F.sum(F.col("common") / F.col("place") / F.col("total")).alias("share"))


def _profiles(ranked: DataFrame, references: DataFrame, cited: DataFrame, query: list[str], top: int) -> DataFrame:
    profile = (
        ranked.filter(F.col("rank") <= top)
        .join(references, "document")
        .groupBy(*query, "reference")
        .agg(F.sum(F.col("idf") / F.col("rank")).alias("w"))
    )
    total = Window.partitionBy(*query)
    shares = profile.withColumn("w", F.col("w") / F.sum("w").over(total))
    found = ranked.select(*query, "document").join(cited, "document")
    return found.join(shares, [*query, "reference"]).groupBy(*query, "document").agg(F.sum("w").alias("share"))


def blend(base: Column, score: Column | None = None, weight: float = 1.0, position: Column | None = None, length: int = 15) -> Column:
    """A second opinion on a ranking: ``base + weight * score``, or decaying with the place in a returned list."""
    if position is not None:
        return base + weight * F.coalesce(1 - position / length, F.lit(0.0))
    return base + weight * F.coalesce(score, F.lit(0.0))


def grid(rows: DataFrame, configurations: list[dict[str, float]], score) -> DataFrame:
    """Every candidate under every configuration: a small parameter table, broadcast to the candidates."""
    names = sorted(configurations[0])
    table = rows.sparkSession.createDataFrame([(i, *[float(c[n]) for n in names]) for i, c in enumerate(configurations)], f"config int, {', '.join(f'{n} double' for n in names)}")
    return rows.crossJoin(F.broadcast(table)).withColumn("score", score({n: F.col(n) for n in names}))
