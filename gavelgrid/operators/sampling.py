"""Deduplication, strata quotas, samples and splits that are the same in every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gavelgrid.operators.hashrank import hash_rank
from gavelgrid.session import checkpointed


def dedup_two_stage(rows: DataFrame, identity: str, content: str, size: str, key: str, exempt: Column) -> DataFrame:
    """One row per identity, the longest text first (ties: smaller key); then one row per content, where it is known,
    unless ``exempt``. The order of the two stages matters."""
    first = Window.partitionBy(identity).orderBy(F.desc_nulls_last(size), key)
    longest = rows.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    free = F.col(content).isNull() | exempt
    same = Window.partitionBy(content).orderBy(F.desc_nulls_last(size), key)
    bound = longest.filter(~free).withColumn("_n", F.row_number().over(same)).filter("_n = 1").drop("_n")
    return longest.filter(free).unionByName(bound)


def allocate_quota(strata: DataFrame, count: str, n: int, floor: int) -> DataFrame:
    """Adds ``quota``: at least ``min(count, floor)``, else the share of what the floors leave of ``n``, at most the count.

    ``strata`` has one row per stratum; the two totals are one row, joined to all.
    """
    totals = strata.agg(F.sum(count).alias("_all"), F.sum(F.least(F.col(count), F.lit(floor))).alias("_floors"))
    budget = F.greatest(F.lit(n) - F.col("_floors"), F.lit(0))
    share = F.round(F.col(count) / F.col("_all") * budget).cast("bigint")
    quota = F.least(F.greatest(F.least(F.col(count), F.lit(floor)), share), F.col(count))
    return strata.crossJoin(F.broadcast(totals)).withColumn("quota", quota).drop("_all", "_floors")


def stratified_sample(rows: DataFrame, strata: list[str], key: str, fraction: float, floor: int, seed: int, always: Column | None = None) -> DataFrame:
    """``round(N * fraction)`` rows over the strata by quota, lowest hash first, and all rows that ``always`` names.

    A larger fraction of the same rows holds every smaller one. N is rounded half to even.
    """
    sizes = rows.groupBy(*strata).agg(F.count(F.lit(1)).alias("_c"))
    total = rows.count()
    quotas = allocate_quota(sizes, "_c", round(total * fraction), floor).select(*strata, "quota")
    picked = hash_rank(rows.join(quotas, strata), strata, key, seed, quota="quota").select(*rows.columns)
    return picked.unionByName(rows.filter(always)).distinct() if always is not None else picked


def cap_per_group(rows: DataFrame, group: list[str], key: str, most: int, seed: int) -> DataFrame:
    """At most ``most`` rows of each group, by hash."""
    return hash_rank(rows.withColumn("_q", F.lit(most)), group, key, seed, quota="_q").drop("_q", "hash_rank")


def proportional_quotas(counts: dict[tuple, int], n: int) -> dict[tuple, int]:
    """Quotas of a few strata: proportional, at least 1, then the largest are lowered until they sum to ``n`` at most."""
    total = sum(counts.values())
    quotas = {k: min(c, max(1, round(n * c / total))) for k, c in counts.items()} if total else {}
    while quotas and sum(quotas.values()) > n and max(quotas.values()) > 1:
        largest = max(quotas, key=lambda k: (quotas[k], str(k)))
        quotas[largest] -= 1
    return quotas


def quota_sample(rows: DataFrame, strata: list[str], key: str, n: int, seed: int) -> DataFrame:
    """Proportional sample over few strata; the quotas are computed from the counts of the strata."""
    counts = {tuple(r[s] for s in strata): r["_c"] for r in rows.groupBy(*strata).agg(F.count(F.lit(1)).alias("_c")).collect()}
    quotas = [(*k, q) for k, q in proportional_quotas(counts, n).items()]
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*strata).schema), "quota bigint"])
    plan = F.broadcast(rows.sparkSession.createDataFrame(quotas, schema))
    return hash_rank(rows.join(plan, strata), strata, key, seed, quota="quota").drop("quota", "hash_rank")


def group_disjoint_split(rows: DataFrame, group: str, category: str, n_held: int, seed: int) -> DataFrame:
    """Adds ``split``: ``n_held`` groups that occur in every category are held out whole, the others train."""
    categories = rows.agg(F.count_distinct(category).alias("_all"))
    full = rows.groupBy(group).agg(F.count_distinct(category).alias("_k")).crossJoin(F.broadcast(categories)).filter("_k = _all")
    ranked = hash_rank(full.select(group).withColumn("_one", F.lit(1)).withColumn("_q", F.lit(n_held)), ["_one"], group, seed, quota="_q")
    held = ranked.select(group, F.lit("test").alias("_s"))
    return rows.join(held, group, "left").withColumn("split", F.coalesce("_s", F.lit("train"))).drop("_s")


def components(edges: DataFrame, a: str, b: str, most_rounds: int = 50) -> DataFrame:
    """(node, component): connected components, named by their smallest node.

    Alternating large-star and small-star steps: the rounds grow with the logarithm of the longest path, and every
    round is written to the shared checkpoint folder. A node's neighbours are never gathered: minima are aggregated.
    """
    start = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u IS NOT NULL AND v IS NOT NULL")
    nodes = start.select(F.col("u").alias("node")).union(start.select("v")).distinct()
    links = checkpointed(start.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else pairs
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        joined = both.join(low, "u")
        moved = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if large else joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        kept = moved.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        return kept.distinct()

    before = None
    for _ in range(most_rounds):
        links = checkpointed(star(star(links, True), False))
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return nodes.join(links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("c")), "node", "left").select("node", F.coalesce("c", "node").alias("component"))
