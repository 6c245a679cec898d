"""The corpus as a user sees it: search, read, cite, list and count, each a thin wrapper over the operators.

Every method returns a DataFrame. Searches by BM25 write their postings, and vector searches read their query, when
they are called; everything else is computed when its rows are asked for.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavelgrid.functions import text as tx
from gavelgrid.functions.identity import canonical_id, docket_key
from gavelgrid.functions.references import canon_code
from gavelgrid.operators import facets, graph, keyword, ranking, vectors
from gavelgrid.operators.ingest import global_position
from gavelgrid.sources.tables import table

FILTERS = ("language", "canton", "court", "branch")


class Corpus:
    """Decisions, passages, vectors, citations and documents below one folder."""

    def __init__(self, spark: SparkSession, base: str) -> None:
        self.spark, self.base = spark, base

    def table(self, name: str, *columns: str) -> DataFrame:
        return table(self.spark, self.base, name, columns or None)

    def _checked(self, k: int, filters: Mapping[str, Sequence[str] | None]) -> None:
        if not 1 <= k <= 1000:
            raise ValueError("k must lie between 1 and 1000")
        if unknown := set(filters) - set(FILTERS):
            raise ValueError(f"unknown filters: {sorted(unknown)}")

    def decisions(self, year_from: int | None = None, year_to: int | None = None, **filters: Sequence[str] | None) -> DataFrame:
        """Decisions under facet filters: alternatives inside a facet, all facets together; an empty list matches nothing."""
        self._checked(1, filters)
        rows = self.table("decisions")
        for facet, values in filters.items():
            if values is not None:
                rows = rows.filter(F.col(facet).isin(list(values)) if values else F.lit(False))
        return rows.filter(facets.year_range(facets.int_date(F.col("decision_date")), year_from, year_to))

    def passages(self, **filters: Sequence[str] | None) -> DataFrame:
        """Passages of the filtered decisions, each id once."""
        chunks = self.table("chunks").groupBy("id").agg(*[F.max(c).alias(c) for c in ("chunk_id", "decision_id", "section", "text")])
        if not any(v is not None for v in filters.values()):
            return chunks
        return chunks.join(self.decisions(**filters).select("decision_id").distinct(), "decision_id", "left_semi")

    def keyword_search(self, query: str, k: int = 20, per_decision: int = 2, **filters: Sequence[str] | None) -> DataFrame:
        """Passages with every part of the query (quoted parts are phrases), best BM25 first."""
        self._checked(k, filters)
        if not keyword.parse_match(query):
            return self.passages().limit(0).select("id", "decision_id", F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
        matching = self.passages(**filters).filter(keyword.match_condition(F.col("text"), query))
        asked = self.spark.createDataFrame([(1, query.replace('"', " "))], "q int, t string")
        matching = matching.select("id", "decision_id")
        scored = keyword.bm25_search(self.passages(), "id", "text", asked, "q", "t", None, among=matching).join(matching, "id")
        return ranking.diverse_top_k(scored.drop("rank"), ["q"], "decision_id", F.desc(F.round("score", 9)), "id", per_decision, k).select("id", "decision_id", "score", "rank")

    def broad_search(self, query: str, k: int = 20, **filters: Sequence[str] | None) -> DataFrame:
        """Passages with all content words first, then with any."""
        self._checked(k, filters)
        asked = self.spark.createDataFrame([(1, query)], "q int, t string")
        return keyword.broad_search(self.passages(**filters), "id", "text", asked, "q", "t", k).drop("q")

    def similar_passages(self, vector: Sequence[float], k: int = 20, **filters: Sequence[str] | None) -> DataFrame:
        """Passages nearest to an encoded query, exact, filtered before ranking."""
        self._checked(k, filters)
        rows = self.table("passage_vectors", "chunk_rowid", "embedding").filter(F.size("embedding") == len(vector))
        finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
        usable = rows.filter(F.forall("embedding", finite) & F.exists("embedding", lambda x: x != 0)).groupBy(F.col("chunk_rowid").alias("id")).agg(F.min("embedding").alias("v"))
        if any(v is not None for v in filters.values()):
            usable = usable.join(self.passages(**filters).select("id"), "id", "left_semi")
        query = self.spark.createDataFrame([(-1, [float(x) for x in vector])], "id long, v array<double>")
        units = usable.select("id", vectors.l2_normalise(F.col("v")).alias("v"))
        return vectors.exact_knn(query.select("id", vectors.l2_normalise(F.col("v")).alias("v")), units, "id", "v", k).drop("query")

    def read_decision(self, reference: str, offset: int = 0, size: int = 8000) -> DataFrame:
        """A page of the latest delivery of a decision, found by id, citation or docket."""
        wanted = self.spark.createDataFrame([(reference,)], "r string").select(canonical_id(F.col("r")).alias("c"), docket_key(F.col("r")).alias("d"))
        rows = self.table("decisions").withColumn("c", canonical_id(F.col("decision_id"))).withColumn("d", docket_key(F.col("docket_number")))
        hits = rows.join(F.broadcast(wanted.select(F.col("c").alias("wc"), F.col("d").alias("wd"))), (F.col("c") == F.col("wc")) | (F.col("d") == F.col("wd")))
        latest = hits.orderBy((F.col("c") == F.col("wc")).desc(), F.desc_nulls_last("indexed_at"), "decision_id").limit(1)
        return latest.select("decision_id", "court", "docket_number", "decision_date", tx.read_window(F.col("full_text"), F.lit(offset), size).alias("page"), F.length("full_text").alias("length"))

    def citing_decisions(self, reference: str, limit: int = 30) -> DataFrame:
        node = self.spark.range(1).select(canonical_id(F.lit(reference)).alias("c")).first().c
        return graph.neighbours(self.table("edges", "source", "target", "recorded_at"), node, self.table("decisions", "decision_id"), limit)

    def search_laws(self, query: str, k: int = 6, language: str | None = None) -> DataFrame:
        """Articles by BM25 over the statutes, one per article."""
        laws = self.table("documents", "doc_id", "text", "lang", "kind").filter("kind = 'statute'")
        laws = laws.filter(F.col("lang") == language) if language else laws
        asked = self.spark.createDataFrame([(1, query)], "q int, t string")
        hits = keyword.bm25_search(laws, "doc_id", "text", asked, "q", "t", None).drop("rank")
        named = hits.join(laws.select("doc_id", F.split_part("text", F.lit("\n"), F.lit(1)).alias("article")), "doc_id")
        return ranking.diverse_top_k(named, ["q"], "article", F.desc(F.round("score", 9)), "doc_id", 1, k).select("doc_id", "article", "score", "rank")

    def read_law(self, code: str, number: str) -> DataFrame:
        """An article in every language, whichever language's code it is asked by."""
        head = F.split_part("text", F.lit("\n"), F.lit(1))
        pattern = r"^Art\. ?([0-9]+[a-z]?) ([A-Za-z]+)"
        laws = self.table("documents").filter("kind = 'statute'").select("doc_id", "lang", "text", F.regexp_extract(head, pattern, 1).alias("n"), canon_code(F.regexp_extract(head, pattern, 2)).alias("c"))
        return laws.filter((F.col("c") == canon_code(F.lit(code))) & (F.lower("n") == number.strip().lower().removeprefix("art.").strip())).select("doc_id", "lang", "text")

    def search_case_file(self, collection: str, query: str, k: int = 10) -> DataFrame:
        files = self.table("documents", "doc_id", "source", "text").filter(F.col("source") == collection)
        asked = self.spark.createDataFrame([(1, query)], "q int, t string")
        return keyword.bm25_search(files, "doc_id", "text", asked, "q", "t", k, tokens=lambda c: tx.words(c, 3)).drop("q")

    def list_values(self, facet: str, limit: int = 200) -> DataFrame:
        return facets.vocabulary(self.table("decisions"), facet, limit)

    def count_decisions(self, by: str, **filters: Sequence[str] | None) -> DataFrame:
        return self.decisions(**filters).groupBy(by).agg(F.count(F.lit(1)).alias("n"))

    def list_decisions(self, limit: int = 25, newest: bool = True, **filters: Sequence[str] | None) -> DataFrame:
        """Newest first with ties by descending id, or oldest first, undated ones leading, with ties by ascending id."""
        dated = self.decisions(**filters).select("decision_id", "court", "docket_number", facets.int_date(F.col("decision_date")).alias("date"), tx.snippet(F.col("regeste")).alias("snippet")).distinct()
        order = (F.desc("date"), F.desc("decision_id")) if newest else (F.asc("date"), F.asc("decision_id"))
        return dated.orderBy(*order).limit(limit)

    def rerank(self, hits: DataFrame, scores: DataFrame | None, key: str = "id") -> DataFrame:
        """Hits by the scores of a model (key, model_score); hits it didn't score keep their order behind the others,
        and without scores the order stays."""
        if scores is None:
            return hits
        scored = hits.join(scores, key, "left").withColumn("_unscored", F.col("model_score").isNull())
        return global_position(scored, [F.asc("_unscored"), F.desc("model_score"), F.asc("rank")], "_place").withColumn("rank", F.col("_place")).drop("_place", "_unscored")
