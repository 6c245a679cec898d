"""Retrieval metrics and comparisons, and the small statistics on them."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def known_item_metrics(run: DataFrame, gold: DataFrame) -> DataFrame:
    """Per query of ``gold`` (query, document, item) from ``run`` (query, rank, item, document).

    Passages are collapsed to documents at their first rank. hit@1/10/50, MRR@10 and nDCG@10 look at documents,
    passage_hit@10 at raw ranks. A query without a hit scores 0.
    """
    documents = run.groupBy("query", "document").agg(F.min("rank").alias("first"))
    places = documents.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("first", "document")))
    found = gold.join(places, ["query", "document"], "left").join(run.select("query", "item", F.col("rank").alias("raw")), ["query", "item"], "left")
    place = F.col("place")
    within = lambda n: F.coalesce((place <= n).cast("int"), F.lit(0))
    return found.select(
        "query",
        within(1).alias("hit_1"),
        within(10).alias("hit_10"),
        within(50).alias("hit_50"),
        F.when(place <= 10, 1 / place).otherwise(0.0).alias("mrr_10"),
        F.when(place <= 10, 1 / F.log2(place + 1)).otherwise(0.0).alias("ndcg_10"),
        F.coalesce((F.col("raw") <= 10).cast("int"), F.lit(0)).alias("passage_hit_10"),
    )


def graded_metrics(run: DataFrame, gold: DataFrame, k: int = 10) -> DataFrame:
    """Per query from ``run`` (query, rank, document) and ``gold`` (query, document, grade): recall, MRR, nDCG and the
    variant that drops irrelevant ranks first. Gains are ``2 ** grade - 1``; a document counts once, at its first rank."""
    once = run.groupBy("query", "document").agg(F.min("rank").alias("first"))
    ranked = once.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("first", "document"))).filter(F.col("place") <= k)
    hits = ranked.join(gold, ["query", "document"]).withColumn("compact", F.row_number().over(Window.partitionBy("query").orderBy("place")))
    gain = F.pow(F.lit(2.0), F.col("grade")) - 1
    got = hits.groupBy("query").agg(
        F.count(F.lit(1)).alias("n"),
        (1 / F.min("place")).alias("mrr"),
        F.sum(gain / F.log2(F.col("place") + 1)).alias("dcg"),
        F.sum(gain / F.log2(F.col("compact") + 1)).alias("compact_dcg"),
    )
    ideal = gold.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("grade"), "document")))
    best = ideal.groupBy("query").agg(F.count(F.lit(1)).alias("relevant"), F.sum(F.when(F.col("place") <= k, gain / F.log2(F.col("place") + 1))).alias("idcg"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return best.join(got, "query", "left").select(
        "query", zero(F.col("n") / F.col("relevant")).alias("recall"), zero(F.col("mrr")).alias("mrr"),
        zero(F.col("dcg") / F.col("idcg")).alias("ndcg"), zero(F.col("compact_dcg") / F.col("idcg")).alias("compat_ndcg"),
    )


def resolve_gold(gold: DataFrame, aliases: DataFrame) -> DataFrame:
    """(query, document, grade): references resolved by (ref, document), the best grade per document; unknown ones with
    document NULL, so that they can be reported."""
    return gold.join(aliases, "ref", "left").groupBy("query", "document").agg(F.max("grade").alias("grade"))


def paired_compare(a: DataFrame, b: DataFrame, by: str, metric: str) -> DataFrame:
    """Per value of ``by``: pairs, mean difference b - a, wins, losses; only queries both runs have."""
    joined = a.select("query", by, F.col(metric).alias("x")).join(b.select("query", F.col(metric).alias("y")), "query")
    d = F.col("y") - F.col("x")
    return joined.groupBy(by).agg(F.count(F.lit(1)).alias("pairs"), F.avg(d).alias("delta"), F.count_if(d > 0).alias("wins"), F.count_if(d < 0).alias("losses"))


def pool_recall(pool: DataFrame, gold: DataFrame) -> DataFrame:
    """(query, recall, hit) of unranked candidate pools."""
    found = gold.join(pool.select("query", "document", F.lit(1).alias("in_pool")).distinct(), ["query", "document"], "left")
    return found.groupBy("query").agg((F.count("in_pool") / F.count(F.lit(1))).alias("recall"), (F.count("in_pool") > 0).alias("hit"))


def reference_status(references: DataFrame, acts: DataFrame, articles: DataFrame) -> DataFrame:
    """Adds ``status``: unknown_act, unknown_article or ok."""
    marked = references.join(acts.select("law", F.lit(1).alias("_a")).distinct(), "law", "left").join(
        articles.select("law", "article", F.lit(1).alias("_b")).distinct(), ["law", "article"], "left"
    )
    status = F.when(F.col("_a").isNull(), "unknown_act").when(F.col("_b").isNull(), "unknown_article").otherwise("ok")
    return marked.withColumn("status", status).drop("_a", "_b")


def contains_folded(answer: Column, sentence: Column) -> Column:
    """Whether a quoted sentence stands in an answer: blanks, markers and case aside; long ones by their first 60 signs."""
    fold = lambda c: F.regexp_replace(F.lower(F.regexp_replace(c, r"\[[0-9]+\]", "")), r"\s+", "")
    whole, part = fold(answer), fold(sentence)
    return F.contains(whole, part) | ((F.length(part) >= 60) & F.contains(whole, F.left(part, F.lit(60))))


def parse_order(text: Column, n: int) -> Column:
    """Numbers 1..n that a text lists, first mention kept."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"\b([0-9]{1,4})\b"), F.lit(1)), lambda x: x.cast("int"))
    return F.array_distinct(F.filter(found, lambda x: (x >= 1) & (x <= n)))


def severity(found: Column, in_answer: Column, boilerplate: Column, contradicted: Column, central: Column) -> Column:
    """Score of an objection: nothing found, not in the answer, boilerplate or not contradicted is 5, else 2 or 3."""
    return F.when(~found | ~in_answer | boilerplate | ~contradicted, 5).when(central, 2).otherwise(3)


def mcnemar(only_a: int, only_b: int) -> float:
    """Exact two-sided test of discordant pairs."""
    n = only_a + only_b
    if n == 0:
        return 1.0
    tail = sum(math.comb(n, i) for i in range(min(only_a, only_b) + 1)) / 2**n
    return min(1.0, 2 * tail)


def bootstrap_interval(values: Sequence[float], rounds: int = 2000, level: float = 0.95, seed: int = 0) -> tuple[float, float]:
    """Percentile interval of the mean."""
    data = np.asarray(values, dtype=float)
    if not len(data):
        return (math.nan, math.nan)
    means = data[np.random.default_rng(seed).integers(0, len(data), (rounds, len(data)))].mean(axis=1)
    low, high = np.quantile(means, [(1 - level) / 2, (1 + level) / 2])
    return float(low), float(high)


def fit_listwise(features: np.ndarray, grades: np.ndarray, queries: np.ndarray, l2: float = 0.001, epochs: int = 400, rate: float = 0.05) -> np.ndarray:
    """Weights of a linear ranking: softmax of scores against softmax targets over the grades of each query."""
    order = np.argsort(queries, kind="stable")
    x, g, q = features[order].astype(float), grades[order].astype(float), queries[order]
    cuts = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
    sizes = np.diff(np.concatenate([cuts, [len(q)]]))

    def softmax(v: np.ndarray) -> np.ndarray:
        e = np.exp(v - np.repeat(np.maximum.reduceat(v, cuts), sizes))
        return e / np.repeat(np.add.reduceat(e, cuts), sizes)

    target = softmax(g)
    w, m, v = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for t in range(1, epochs + 1):
        gradient = x.T @ (softmax(x @ w) - target) / len(cuts) + 2 * l2 * w
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def word_errors(reference: Sequence[str], said: Sequence[str]) -> int:
    """Edit distance of word sequences."""
    row = list(range(len(said) + 1))
    for i, r in enumerate(reference, 1):
        diagonal, row[0] = row[0], i
        for j, s in enumerate(said, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (r != s))
    return row[-1]


def case_score(parts: dict[str, float | None], weights: dict[str, float]) -> float | None:
    """Weighted mean of the parts that were judged; None if none was."""
    judged = {k: v for k, v in parts.items() if v is not None and weights.get(k)}
    total = sum(weights[k] for k in judged)
    return sum(weights[k] * v for k, v in judged.items()) / total if total else None


def grading(error: Column, choice: Column) -> Column:
    """How an answer is graded: not at all after an error, exactly for a multiple choice, else by a judge."""
    return F.when(error, F.lit("unjudged")).when(choice, F.lit("exact")).otherwise(F.lit("judge"))
