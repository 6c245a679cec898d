"""Citation graph and statute links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gavelgrid.functions.identity import canonical_id


def citation_graph(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """(source, target, confidence): canonical ends, edges that touch ``kept`` (decision_id), no self edges, best confidence."""
    ends = edges.select(canonical_id(F.col("source")).alias("source"), canonical_id(F.col("target")).alias("target"), "confidence")
    folded = ends.filter("source <> target AND source <> '' AND target <> ''").groupBy("source", "target").agg(F.max("confidence").alias("confidence"))
    ids = kept.select(canonical_id(F.col("decision_id")).alias("k")).filter("k IS NOT NULL").distinct()
    by_source = folded.join(ids.select(F.col("k").alias("source"), F.lit(True).alias("s")), "source", "left")
    marked = by_source.join(ids.select(F.col("k").alias("target"), F.lit(True).alias("t")), "target", "left")
    return marked.filter("s OR t").select("source", "target", "confidence")


def node_labels(graph: DataFrame, decisions: DataFrame) -> DataFrame:
    """(id, docket, date): one label per node, of its latest row."""
    nodes = graph.select(F.col("source").alias("id")).union(graph.select("target")).distinct()
    labels = decisions.select(canonical_id(F.col("decision_id")).alias("id"), F.struct("indexed_at", "decision_id", F.col("docket_number").alias("docket"), F.col("decision_date").alias("date")).alias("r"))
    return labels.groupBy("id").agg(F.max("r").alias("r")).join(nodes, "id", "left_semi").select("id", "r.docket", "r.date")


def neighbours(edges: DataFrame, node: str, corpus: DataFrame, limit: int) -> DataFrame:
    """Decisions that cite ``node``, newest record first, each canonical decision once, with a flag for the corpus."""
    own = F.lit(node)
    citing = (
        edges.select(canonical_id(F.col("source")).alias("id"), canonical_id(F.col("target")).alias("t"), "recorded_at")
        .filter((F.col("t") == own) & (F.col("id") != own) & (F.col("id") != ""))
        .groupBy("id")
        .agg(F.max("recorded_at").alias("recorded_at"))
    )
    held = corpus.select(canonical_id(F.col("decision_id")).alias("id"), F.lit(True).alias("in_corpus")).distinct()
    top = citing.orderBy(F.desc_nulls_last("recorded_at"), "id").limit(limit)
    return top.join(held, "id", "left").withColumn("in_corpus", F.coalesce("in_corpus", F.lit(False)))


def statute_links(mentions: DataFrame, decisions: DataFrame, counts: DataFrame) -> DataFrame:
    """(decision, law, article, mentions, language, cited_by) from raw mentions (decision, law, article, mentions)."""
    folded = mentions.groupBy("decision", "law", "article").agg(F.sum("mentions").alias("mentions"))
    return (
        folded.join(decisions.select("decision", "language").distinct(), "decision")
        .join(counts.select("decision", "cited_by"), "decision", "left")
        .withColumn("cited_by", F.coalesce("cited_by", F.lit(0)))
    )


def article_frequency(links: DataFrame) -> DataFrame:
    """(law, article, decisions)."""
    return links.select("law", "article", "decision").distinct().groupBy("law", "article").agg(F.count(F.lit(1)).alias("decisions"))


def most_cited(links: DataFrame, articles: DataFrame, by: list[str], k: int) -> DataFrame:
    """Per group the k most cited decisions on the named articles."""
    named = links.join(articles, ["law", "article"], "left_semi")
    once = named.groupBy(*by, "decision").agg(F.max("cited_by").alias("cited_by"))
    best = Window.partitionBy(*by).orderBy(F.desc("cited_by"), "decision")
    return once.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def pool_citations(ranked: DataFrame, edges: DataFrame, query: list[str], top: int = 30) -> DataFrame:
    """(query, document, evidence): sum of ``1 / sqrt(1 + rank)`` over the best candidates that cite the document."""
    citing = ranked.filter(F.col("rank") <= top).select(*query, F.col("document").alias("source"), "rank")
    cited = citing.join(edges.select("source", "target").distinct(), "source").withColumnRenamed("target", "document")
    in_pool = cited.join(ranked.select(*query, "document"), [*query, "document"], "left_semi")
    return in_pool.groupBy(*query, "document").agg(F.sum(1 / F.sqrt(1 + F.col("rank"))).alias("evidence"))
