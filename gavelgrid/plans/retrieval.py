"""Queries of vector search, ranking, graph, evaluation and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gavelgrid.functions import references, text as tx
from gavelgrid.functions.identity import canonical_id
from gavelgrid.operators import evaluation, facets, graph, hashrank, keyword, ranking, vectors
from gavelgrid.plans.orphans import sql_canonical
from gavelgrid.plans.registry import Registry
from gavelgrid.session import checkpointed
from gavelgrid.sources.tables import table
from gavelgrid.streaming import events as streams

REGISTRY = Registry()
query = REGISTRY.query


def count(name: str = "n"):
    return F.count(F.lit(1)).alias(name)


# --- vectors --------------------------------------------------------------------------------------------------------

_DOT = "list_inner_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"
_SIMS = f"SELECT q.vec_id AS query, r.vec_id AS vec_id, {_DOT.format(a='q.embedding', b='r.embedding')} AS s, q.label AS ql, r.label AS rl FROM embeddings q, embeddings r WHERE q.vec_id % 20 = 0 AND q.vec_id <> r.vec_id"
_TOP = "SELECT query, vec_id, round(s, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(s, 9) DESC, vec_id) AS rank FROM ({0})) WHERE rank <= {1}"


def _embeddings(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, base, "embeddings", ("vec_id", "embedding", "label"))
    return rows.filter("vec_id % 20 = 0"), rows


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


@query("knn_topk", _TOP.format(_SIMS, 10))
def knn_topk(spark: SparkSession, base: str) -> DataFrame:
    return _rounded(vectors.exact_knn(*_embeddings(spark, base), "vec_id", "embedding", 10))


@query("knn_join", "SELECT query, count(*) AS n, round(max(s), 6) AS best FROM (" + _SIMS + ") WHERE s >= 0.3 GROUP BY 1")
def knn_join(spark: SparkSession, base: str) -> DataFrame:
    """All neighbours of the stated queries from a similarity on, counted; no limit on their number."""
    queries, rows = _embeddings(spark, base)
    every = vectors.exact_knn(queries, rows, "vec_id", "embedding", None, min_score=0.3)
    return every.groupBy("query").agg(count(), F.round(F.max("score"), 6).alias("best"))


@query("knn_segmented", _TOP.format(_SIMS + " AND q.label = r.label", 5))
def knn_segmented(spark: SparkSession, base: str) -> DataFrame:
    return _rounded(vectors.exact_knn(*_embeddings(spark, base), "vec_id", "embedding", 5, segment="label"))


@query("knn_filtered", _TOP.format(_SIMS + " AND r.label IN (0, 2)", 5))
def knn_filtered(spark: SparkSession, base: str) -> DataFrame:
    queries, rows = _embeddings(spark, base)
    return _rounded(vectors.exact_knn(queries, rows.filter("label IN (0, 2)"), "vec_id", "embedding", 5))


@query(
    "knn_dedup_key",
    f"""WITH d AS (SELECT *, vec_id % 50 AS article, row_number() OVER (PARTITION BY query, vec_id % 50 ORDER BY round(s, 9) DESC, vec_id) AS own FROM ({_SIMS}))
        SELECT query, vec_id, article, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(s, 9) DESC, vec_id) AS rank FROM d WHERE own = 1) WHERE rank <= 6""",
)
def knn_dedup_key(spark: SparkSession, base: str) -> DataFrame:
    """One result per article: the nearest of each article is enough to rank the articles."""
    queries, rows = _embeddings(spark, base)
    parts = vectors.exact_knn(queries, rows.withColumn("article", F.col("vec_id") % 50), "vec_id", "embedding", 1, segment="article", per_segment=True)
    best = ranking.diverse_top_k(parts.drop("rank").withColumn("article", F.col("vec_id") % 50), ["query"], "article", F.desc(F.round("score", 9)), "vec_id", 1, 6)
    return best.select("query", "vec_id", "article", "rank")


@query(
    "legacy_search",
    f"""WITH pools AS (SELECT DISTINCT query, vec_id, s, rl FROM (
          SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(s, 9) DESC, vec_id) AS r FROM ({_SIMS}) QUALIFY r <= 20
          UNION ALL SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(s, 9) DESC, vec_id) AS r FROM ({_SIMS} AND r.label = 0) QUALIFY r <= 5))
        SELECT query, vec_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(s + CASE WHEN rl = 0 THEN 0.05 ELSE 0 END, 9) DESC, vec_id) AS rank FROM pools) WHERE rank <= 10""",
)
def legacy_search(spark: SparkSession, base: str) -> DataFrame:
    """An unrestricted and a leading-case pool, with an authority bonus for leading cases."""
    queries, rows = _embeddings(spark, base)
    free = vectors.exact_knn(queries, rows, "vec_id", "embedding", 20)
    leading = vectors.exact_knn(queries, rows.filter("label = 0"), "vec_id", "embedding", 5)
    pool = free.unionByName(leading).groupBy("query", "vec_id").agg(F.max("score").alias("score")).join(rows.select("vec_id", "label"), "vec_id")
    boosted = F.round(F.col("score") + F.when(F.col("label") == 0, 0.05).otherwise(0.0), 9)
    return pool.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc(boosted), "vec_id"))).filter("rank <= 10").select("query", "vec_id", "rank")


_HALF = _SIMS.replace(_DOT.format(a="q.embedding", b="r.embedding"), _DOT.format(a="q.embedding[1:32]", b="r.embedding[1:32]"))


@query("topk_overlap", f"SELECT query, count(b.vec_id) / 10.0 AS overlap FROM ({_TOP.format(_SIMS, 10)}) a LEFT JOIN ({_TOP.format(_HALF, 10)}) b USING (query, vec_id) GROUP BY 1")
def topk_overlap(spark: SparkSession, base: str) -> DataFrame:
    queries, rows = _embeddings(spark, base)
    half = lambda df: df.withColumn("embedding", F.slice("embedding", 1, 32))
    a = vectors.exact_knn(queries, rows, "vec_id", "embedding", 10).select("query", "vec_id")
    b = vectors.exact_knn(half(queries), half(rows), "vec_id", "embedding", 10).select("query", "vec_id", F.lit(1).alias("hit"))
    return a.join(b, ["query", "vec_id"], "left").groupBy("query").agg((F.count("hit") / 10).alias("overlap"))


@query(
    "case_file_hybrid",
    f"""WITH runs AS (SELECT query, vec_id, rank FROM ({_TOP.format(_SIMS, 30)}) UNION ALL SELECT query, vec_id, rank FROM ({_TOP.format(_HALF, 30)})),
             f AS (SELECT query, vec_id, sum(CAST(1.0 AS DOUBLE) / (60 + rank - 1)) AS score FROM runs GROUP BY 1, 2)
        SELECT query, vec_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, vec_id) AS rank FROM f) WHERE rank <= 12""",
)
def case_file_hybrid(spark: SparkSession, base: str) -> DataFrame:
    """Two pools of 30 fused with ranks that count from 0."""
    queries, rows = _embeddings(spark, base)
    half = lambda df: df.withColumn("embedding", F.slice("embedding", 1, 32))
    a = vectors.exact_knn(queries, rows, "vec_id", "embedding", 30).withColumn("source", F.lit("a"))
    b = vectors.exact_knn(half(queries), half(rows), "vec_id", "embedding", 30).withColumn("source", F.lit("b"))
    fused = ranking.rank_fusion(a.unionByName(b), ["query"], "vec_id", "rank", zero_based=True)
    ranked = fused.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "vec_id"))).filter("rank <= 12")
    return _rounded(ranked.select("query", "vec_id", "score", "rank"))


@query(
    "vector_filter_columns",
    """SELECT c.id, coalesce(d.court, '') AS court, CASE WHEN d.canton = 'CH' THEN CASE WHEN d.court = 'bge_historical' THEN 'bge' ELSE d.court END ELSE d.canton END AS jurisdiction,
              coalesce(CASE WHEN regexp_matches(substr(d.decision_date, 1, 4), '^[0-9]{4}$') THEN CAST(substr(d.decision_date, 1, 4) AS INT) END, 0) AS year
       FROM (SELECT DISTINCT id, decision_id FROM chunks) c LEFT JOIN (SELECT decision_id, max(court) AS court, max(canton) AS canton, max(decision_date) AS decision_date FROM decisions GROUP BY 1) d USING (decision_id)""",
)
def vector_filter_columns(spark: SparkSession, base: str) -> DataFrame:
    decisions = table(spark, base, "decisions").groupBy("decision_id").agg(*[F.max(c).alias(c) for c in ("court", "canton", "decision_date")])
    joined = table(spark, base, "chunks").select("id", "decision_id").distinct().join(decisions, "decision_id", "left")
    return joined.select(
        "id", F.coalesce("court", F.lit("")).alias("court"), facets.jurisdiction(F.col("court"), F.col("canton")).alias("jurisdiction"),
        F.coalesce(facets.year_of(F.col("decision_date")), F.lit(0)).alias("year"),
    )


@query("l2_normalise", "SELECT vec_id, round(list_aggregate(list_transform(v, lambda x: x / n), 'sum'), 6) AS total FROM (SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS n FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings))")
def l2_normalise(spark: SparkSession, base: str) -> DataFrame:
    unit = vectors.l2_normalise(F.col("embedding"))
    return table(spark, base, "embeddings").select("vec_id", F.round(F.aggregate(unit, F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("dot_product", f"SELECT a.vec_id, round({_DOT.format(a='a.embedding', b='b.embedding')}, 6) AS product FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def dot_product(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "embeddings", ("vec_id", "embedding"))
    following = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return rows.join(following, "vec_id").select("vec_id", F.round(vectors.dot(F.col("embedding"), F.col("next")), 6).alias("product"))


# --- ranking --------------------------------------------------------------------------------------------------------

#: A run per user and source: events by value. Documents are shared by several items, as judgments are by passages.
_RUNS_SQL = """
runs AS (SELECT user_id AS query, CASE event_type WHEN 'view' THEN 'bge_view' ELSE event_type END AS source, event_id AS item, event_id % 97 AS document,
                row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC NULLS LAST, event_id) AS pos FROM events)
"""


def _runs(spark: SparkSession, base: str) -> DataFrame:
    source = F.when(F.col("event_type") == "view", "bge_view").otherwise(F.col("event_type"))
    rows = table(spark, base, "events")
    pos = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy(F.desc_nulls_last("value"), "event_id"))
    return rows.select(F.col("user_id").alias("query"), source.alias("source"), F.col("event_id").alias("item"), (F.col("event_id") % 97).alias("document"), pos.alias("pos"))


@query("rrf_fusion", f"WITH {_RUNS_SQL} SELECT query, document, round(sum(CASE source WHEN 'click' THEN CAST(2.0 AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END / (60 + pos)), 6) AS score FROM runs GROUP BY 1, 2")
def rrf_fusion(spark: SparkSession, base: str) -> DataFrame:
    return _rounded(ranking.rank_fusion(_runs(spark, base), ["query"], "document", "pos", {"click": 2.0}))


_FUSED_SQL = f"""{_RUNS_SQL},
seen AS (SELECT query, source, document, min(pos) AS pos FROM runs GROUP BY 1, 2, 3),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query, source ORDER BY pos, document) AS r FROM seen),
scored AS (SELECT query, document, sum(CASE WHEN starts_with(source, 'bge') THEN CAST(0.5 AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END / (60 + r)) AS score, max(CASE WHEN r <= 3 THEN 1 ELSE 0 END) AS reserved FROM ranked GROUP BY 1, 2),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY reserved DESC, round(score, 9) DESC, document) AS n FROM scored) WHERE n <= 20),
fused AS (SELECT k.query, k.document, k.score, k.reserved, e.representative, e.evidence FROM kept k JOIN (
   SELECT query, document, arg_min(item, pos * 1000000000000 + CASE source WHEN 'bge_view' THEN 0 WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END * 100000000000 + item) AS representative, count(DISTINCT item) AS evidence
   FROM runs GROUP BY 1, 2) e USING (query, document))
"""


@query("fuse_decisions", f"WITH {_FUSED_SQL} SELECT query, document, round(score, 6) AS score, reserved, representative, evidence FROM fused")
def fuse_decisions(spark: SparkSession, base: str) -> DataFrame:
    fused = ranking.fuse_documents(_runs(spark, base), ["query"], floor=3, limit=20)
    return _rounded(fused).select("query", "document", "score", "reserved", "representative", F.size("evidence").cast("bigint").alias("evidence"))


_SCORED_SQL = f"""{_FUSED_SQL},
cand AS (SELECT f.query, f.document, ['de', 'fr', 'it'][CAST(f.document % 3 AS INT) + 1] AS language, ['de', 'fr', 'it'][CAST(f.query % 3 AS INT) + 1] AS own_language, f.document % 5 = 0 AS lead_case,
                f.score * 100 AS relevance,
                f.score * 100 + least(CAST(1.5 AS DOUBLE), CAST(0.35 AS DOUBLE) * ln(1 + CAST(f.document AS DOUBLE)) + CASE WHEN f.document % 5 = 0 THEN CAST(0.5 AS DOUBLE) ELSE 0 END) + CASE WHEN f.document % 3 = f.query % 3 THEN CAST(0.3 AS DOUBLE) ELSE 0 END AS score FROM fused f)
"""


def _candidates(spark: SparkSession, base: str) -> DataFrame:
    fused = ranking.fuse_documents(_runs(spark, base), ["query"], floor=3, limit=20, evidence=False)
    name = lambda c: F.element_at(F.array(F.lit("de"), F.lit("fr"), F.lit("it")), (c % 3 + 1).cast("int"))
    rows = fused.select("query", "document", name(F.col("document")).alias("language"), name(F.col("query")).alias("own_language"), (F.col("document") % 5 == 0).alias("leading"), (F.col("score") * 100).alias("relevance"))
    return rows.withColumn("score", ranking.authority_score(F.col("relevance"), F.col("document"), F.col("leading"), F.col("language") == F.col("own_language")))


@query("authority_rank", f"WITH {_SCORED_SQL} SELECT query, document, round(score, 6) AS score FROM cand")
def authority_rank(spark: SparkSession, base: str) -> DataFrame:
    return _rounded(_candidates(spark, base)).select("query", "document", "score")


@query(
    "reserved_select",
    f"""WITH {_SCORED_SQL},
        m AS (SELECT *, round(relevance, 6) AS rel, round(score, 6) AS sc FROM cand),
        v AS (SELECT *, row_number() OVER (PARTITION BY query, language ORDER BY rel DESC, document) AS l, row_number() OVER (PARTITION BY query, lead_case ORDER BY rel DESC, document) AS c, max(rel) OVER (PARTITION BY query) AS top FROM m),
        r AS (SELECT *, (l <= CASE WHEN language = own_language THEN 2 ELSE 1 END) OR (lead_case AND c = 1 AND rel >= top - 2) AS reserved FROM v),
        k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY reserved DESC, sc DESC, document) AS n FROM r) WHERE n <= 8)
        SELECT query, document, reserved, row_number() OVER (PARTITION BY query ORDER BY sc DESC, document) AS rank FROM k""",
)
def reserved_select(spark: SparkSession, base: str) -> DataFrame:
    rows = _candidates(spark, base).withColumns({"relevance": F.round("relevance", 6), "score": F.round("score", 6)})
    return ranking.reserved_select(rows, ["query"], 8).select("query", "document", "reserved", "rank")


@query(
    "legacy_select",
    f"""WITH {_SCORED_SQL}, m AS (SELECT *, round(score, 6) AS sc FROM cand),
        v AS (SELECT *, row_number() OVER (PARTITION BY query, language ORDER BY sc DESC, document) AS l, row_number() OVER (PARTITION BY query, lead_case ORDER BY sc DESC, document) AS c FROM m),
        k AS (SELECT *, (l <= 1) OR (lead_case AND c = 1) AS reserved FROM v)
        SELECT query, document, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY reserved DESC, sc DESC, document) AS rank FROM k) WHERE rank <= 6""",
)
def legacy_select(spark: SparkSession, base: str) -> DataFrame:
    """The best of each language and the best leading case first, the rest by score."""
    rows = _candidates(spark, base).withColumn("score", F.round("score", 6))
    per = lambda *by: F.row_number().over(Window.partitionBy("query", *by).orderBy(F.desc("score"), "document"))
    marked = rows.withColumn("reserved", (per("language") <= 1) | (F.col("leading") & (per("leading") == 1)))
    best = Window.partitionBy("query").orderBy(F.desc("reserved"), F.desc("score"), "document")
    return marked.withColumn("rank", F.row_number().over(best)).filter("rank <= 6").select("query", "document", "rank")


@query(
    "candidate_features",
    f"""WITH {_SCORED_SQL} SELECT query, document, round(relevance, 6) AS relevance, round(relevance - max(relevance) OVER (PARTITION BY query), 6) AS gap, round(ln(1 + CAST(document AS DOUBLE)), 6) AS log_cited,
        CAST(lead_case AS INT) AS "leading", CAST(language = own_language AS INT) AS native FROM cand""",
)
def candidate_features(spark: SparkSession, base: str) -> DataFrame:
    rows = _candidates(spark, base)
    return rows.select(
        "query", "document", F.round("relevance", 6).alias("relevance"),
        F.round(F.col("relevance") - F.max("relevance").over(Window.partitionBy("query")), 6).alias("gap"),
        F.round(F.log1p(F.col("document").cast("double")), 6).alias("log_cited"),
        F.col("leading").cast("int").alias("leading"), (F.col("language") == F.col("own_language")).cast("int").alias("native"),
    )


_REFS_SQL = r"""refs AS (SELECT DISTINCT doc_id % 97 AS document, unnest(regexp_extract_all(text, 'Art\. ?[0-9]+[a-z]?')) AS reference FROM documents),
idf AS (SELECT document, reference, ln(97.0 / (1 + count(*) OVER (PARTITION BY reference))) AS idf FROM refs)"""


def _references(spark: SparkSession, base: str) -> DataFrame:
    """Articles that documents mention, with their idf; documents are numbered like the candidates."""
    texts = table(spark, base, "documents", ("doc_id", "text"))
    mentions = F.explode(F.regexp_extract_all("text", F.lit(r"Art\. ?[0-9]+[a-z]?"), F.lit(0)))
    refs = texts.select((F.col("doc_id") % 97).alias("document"), mentions.alias("reference")).distinct()
    held = F.count(F.lit(1)).over(Window.partitionBy("reference"))  # of 97 documents at most
    return refs.withColumn("idf", F.log(97.0 / (1 + held)))


@query(
    "prf_articles",
    f"""WITH {_SCORED_SQL}, {_REFS_SQL},
        places AS (SELECT query, document, row_number() OVER (PARTITION BY query ORDER BY round(score, 6) DESC, document) AS rank FROM cand),
        profile AS (SELECT query, reference, sum(idf / rank) AS w FROM places JOIN idf USING (document) WHERE rank <= 20 GROUP BY 1, 2),
        shares AS (SELECT query, reference, w / sum(w) OVER (PARTITION BY query) AS w FROM profile)
        SELECT r.query, r.document, round(sum(w), 5) AS share FROM places r JOIN refs USING (document) JOIN shares s ON s.query = r.query AND s.reference = refs.reference GROUP BY 1, 2""",
)
def prf_articles(spark: SparkSession, base: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("score", 6)), "document"))
    ranked = _candidates(spark, base).select("query", "document", rank.alias("rank"))
    shares = ranking.feedback_profile(checkpointed(ranked), checkpointed(_references(spark, base)), ["query"])
    return shares.withColumn("share", F.round("share", 5))


@query(
    "learned_select",
    f"""WITH {_SCORED_SQL}, s AS (SELECT query, document, document % 20 AS identity, round(relevance * CAST(0.8 AS DOUBLE) + CAST(lead_case AS INT) * CAST(0.4 AS DOUBLE), 6) AS score FROM cand),
        b AS (SELECT *, row_number() OVER (PARTITION BY query, identity ORDER BY score DESC, document) AS own FROM s)
        SELECT query, document, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, document) AS rank FROM b WHERE own = 1) WHERE rank <= 5""",
)
def learned_select(spark: SparkSession, base: str) -> DataFrame:
    score = F.round(F.col("relevance") * 0.8 + F.col("leading").cast("int") * 0.4, 6)
    rows = _candidates(spark, base).withColumn("score", score).withColumn("identity", F.col("document") % 20)
    return ranking.learned_select(rows, ["query"], "identity", "score", "document", 5).select("query", "document", "score", "rank")


@query("group_folds", "SELECT o_orderkey, (dense_rank() OVER (ORDER BY o_custkey) - 1) % 5 AS fold FROM orders")
def group_folds(spark: SparkSession, base: str) -> DataFrame:
    """Folds that keep groups whole: the groups, not the rows, are numbered."""
    from gavelgrid.operators.ingest import global_position

    orders = table(spark, base, "orders", ("o_orderkey", "o_custkey"))
    groups = global_position(orders.select("o_custkey").distinct(), [F.col("o_custkey")], "g")
    return orders.join(groups, "o_custkey").select("o_orderkey", ((F.col("g") - 1) % 5).alias("fold"))


_GRID = [{"a": a, "b": b} for a in (0.0, 0.2, 0.4) for b in (0.0, 0.5)]


@query(
    "grid_search",
    f"""WITH {_SCORED_SQL}, g(config, a, b) AS (VALUES {', '.join(f"({i}, CAST({c['a']} AS DOUBLE), CAST({c['b']} AS DOUBLE))" for i, c in enumerate(_GRID))}),
        r AS (SELECT config, query, document, row_number() OVER (PARTITION BY config, query ORDER BY round(relevance + a * ln(1 + CAST(document AS DOUBLE)) + b * CAST(lead_case AS INT), 6) DESC, document) AS rank FROM cand, g)
        SELECT config, round(avg(CASE WHEN rank <= 5 AND document % 7 = query % 7 THEN 1 ELSE 0 END), 6) AS precision FROM r WHERE rank <= 5 GROUP BY 1""",
)
def grid_search(spark: SparkSession, base: str) -> DataFrame:
    score = lambda p: F.round(F.col("relevance") + p["a"] * F.log1p(F.col("document").cast("double")) + p["b"] * F.col("leading").cast("int"), 6)
    every = ranking.grid(_candidates(spark, base).drop("score"), _GRID, score)
    ranked = every.withColumn("rank", F.row_number().over(Window.partitionBy("config", "query").orderBy(F.desc("score"), "document"))).filter("rank <= 5")
    hit = F.when(F.col("document") % 7 == F.col("query") % 7, 1).otherwise(0)
    return ranked.groupBy("config").agg(F.round(F.avg(hit), 6).alias("precision"))


@query("blend_scores", f"WITH {_SCORED_SQL} SELECT query, document, round(score + CAST(0.5 AS DOUBLE) * coalesce(1 - CASE WHEN document < 15 THEN document END / CAST(15 AS DOUBLE), 0), 6) AS blended FROM cand")
def blend_scores(spark: SparkSession, base: str) -> DataFrame:
    listed = F.when(F.col("document") < 15, F.col("document"))
    return _candidates(spark, base).select("query", "document", F.round(ranking.blend(F.col("score"), weight=0.5, position=listed), 6).alias("blended"))


@query(
    "exact_lookup",
    f"""WITH asked(q) AS (VALUES ('BGE 199 III 159'), ('bger_1B.60222_2012'), ('BGE 1 I 1'))
        SELECT q, id FROM (SELECT DISTINCT q, c.id, row_number() OVER (PARTITION BY q ORDER BY c.id) AS rn FROM asked JOIN (SELECT DISTINCT id, decision_id FROM chunks) c ON {sql_canonical('c.decision_id')} = {sql_canonical('asked.q')}) WHERE rn <= 3""",
)
def exact_lookup(spark: SparkSession, base: str) -> DataFrame:
    """A bare reference finds its own passages or nothing, never something similar."""
    asked = spark.createDataFrame([("BGE 199 III 159",), ("bger_1B.60222_2012",), ("BGE 1 I 1",)], "q string").withColumn("c", canonical_id(F.col("q")))
    chunks = table(spark, base, "chunks").select("id", canonical_id(F.col("decision_id")).alias("c")).distinct()
    hits = chunks.join(F.broadcast(asked), "c")
    return hits.withColumn("rn", F.row_number().over(Window.partitionBy("q").orderBy("id"))).filter("rn <= 3").select("q", "id")


_HYBRID_SQL = f"""
WITH qs AS (SELECT id AS query, max(text) AS text FROM chunks WHERE id % 20 = 0 GROUP BY 1),
t AS (SELECT id, max(decision_id) AS document, max(text) AS text FROM chunks GROUP BY 1),
p AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM t) GROUP BY 1, 2),
l AS (SELECT id, sum(tf) AS dl FROM p GROUP BY 1), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM l), f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
w AS (SELECT id, term, ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS w FROM p JOIN l USING (id) JOIN f USING (term), st),
qt AS (SELECT DISTINCT query, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM qs),
lex AS (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY round(sum(w), 6) DESC, id) AS pos FROM qt JOIN w USING (term) WHERE id <> query GROUP BY 1, 2 QUALIFY pos <= 60),
uv AS (SELECT chunk_rowid AS id, min(embedding) AS v FROM passage_vectors WHERE len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0)) GROUP BY 1),
nv AS (SELECT id, list_transform(CAST(v AS DOUBLE[]), lambda x: x / sqrt(list_inner_product(CAST(v AS DOUBLE[]), CAST(v AS DOUBLE[])))) AS v FROM uv),
den AS (SELECT q.id AS query, r.id, row_number() OVER (PARTITION BY q.id ORDER BY round(list_inner_product(q.v, r.v), 6) DESC, r.id) AS pos FROM nv q JOIN qs ON qs.query = q.id, nv r WHERE q.id <> r.id QUALIFY pos <= 60),
runs AS (SELECT query, 'lexical' AS source, id AS item, pos FROM lex UNION ALL SELECT query, 'dense', id, pos FROM den),
d AS (SELECT r.query, r.source, r.item, r.pos, t.document FROM runs r JOIN t ON t.id = r.item WHERE t.document IS NOT NULL),
seen AS (SELECT query, source, document, min(pos) AS pos FROM d GROUP BY 1, 2, 3),
rk AS (SELECT *, row_number() OVER (PARTITION BY query, source ORDER BY pos, document) AS r FROM seen),
sc AS (SELECT query, document, sum(CAST(1.0 AS DOUBLE) / (60 + r)) AS score FROM rk GROUP BY 1, 2),
au AS (SELECT sc.query, sc.document, round(sc.score * 100 + least(CAST(1.5 AS DOUBLE), CAST(0.35 AS DOUBLE) * ln(1 + CAST(coalesce(c.cited_by, 0) AS DOUBLE)) + CASE WHEN starts_with(sc.document, 'bge') THEN CAST(0.5 AS DOUBLE) ELSE 0 END), 6) AS score
       FROM sc LEFT JOIN (SELECT decision_id, max(cited_by) AS cited_by FROM counts GROUP BY 1) c ON c.decision_id = sc.document)
SELECT query, document, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, document) AS rank FROM au) WHERE rank <= 10
"""


@query("hybrid_search", _HYBRID_SQL)
def hybrid_search(spark: SparkSession, base: str) -> DataFrame:
    """The flagship: every twentieth passage as a query; BM25 over the passages and nearest vectors, fused by judgment, with the
    authority of the citation counts, ten judgments per query."""
    chunks = table(spark, base, "chunks")
    whole = chunks.groupBy("id").agg(F.max("decision_id").alias("document"), F.max("text").alias("text"))
    passages = checkpointed(keyword.joined_words(whole, "text"))
    asked = passages.filter("id % 20 = 0").withColumnRenamed("id", "query")
    lexical = keyword.bm25_best(passages, "id", asked, "query", 60)

    vector_rows = table(spark, base, "passage_vectors", ("chunk_rowid", "embedding")).filter(F.size("embedding") == 64)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    usable = vector_rows.filter(F.forall("embedding", finite) & F.exists("embedding", lambda x: x != 0)).groupBy(F.col("chunk_rowid").alias("id")).agg(F.min("embedding").alias("v"))
    units = usable.select("id", vectors.l2_normalise(F.col("v")).alias("v"))
    own = units.filter("id % 20 = 0").join(asked.select(F.col("query").alias("id")), "id", "left_semi")
    dense = vectors.exact_knn(own, units.coalesce(spark.sparkContext.defaultParallelism), "id", "v", 60, digits=6)

    runs = (
        lexical.select("query", "id", F.col("rank").alias("pos"), F.lit("lexical").alias("source"))
        .unionByName(dense.select("query", "id", F.col("rank").alias("pos"), F.lit("dense").alias("source")))
        .join(passages.select("id", "document").filter("document IS NOT NULL"), "id")
        .withColumnRenamed("id", "item")
    )
    fused = ranking.fuse_documents(runs, ["query"], floor=60, limit=1000, evidence=False)
    cited = table(spark, base, "counts").groupBy(F.col("decision_id").alias("document")).agg(F.max("cited_by").alias("cited_by"))
    score = ranking.authority_score(F.col("score") * 100, F.col("cited_by"), F.col("document").startswith("bge"), F.lit(False))
    scored = fused.join(cited, "document", "left").select("query", "document", F.round(score, 6).alias("score"))
    return ranking.learned_select(scored, ["query"], "document", "score", "document", 10).select("query", "document", "score", "rank")


# --- graph ----------------------------------------------------------------------------------------------------------

_GRAPH_SQL = f"""
k AS (SELECT DISTINCT {sql_canonical('decision_id')} AS k FROM selected_decisions WHERE decision_id IS NOT NULL),
e AS (SELECT {sql_canonical('source')} AS source, {sql_canonical('target')} AS target, confidence FROM edges),
g AS (SELECT source, target, max(confidence) AS confidence FROM e WHERE source <> target AND source <> '' AND target <> '' AND (source IN (SELECT k FROM k) OR target IN (SELECT k FROM k)) GROUP BY 1, 2)
"""


def _graph(spark: SparkSession, base: str) -> DataFrame:
    return graph.citation_graph(table(spark, base, "edges", ("source", "target", "confidence")), table(spark, base, "selected_decisions", ("decision_id",)))


@query("citation_graph", f"WITH {_GRAPH_SQL} SELECT source, target, confidence FROM g")
def citation_graph(spark: SparkSession, base: str) -> DataFrame:
    return _graph(spark, base)


@query(
    "node_labels",
    f"""WITH {_GRAPH_SQL}, n AS (SELECT source AS id FROM g UNION SELECT target FROM g),
        l AS (SELECT {sql_canonical('decision_id')} AS id, docket_number AS docket, decision_date AS date,
                row_number() OVER (PARTITION BY {sql_canonical('decision_id')} ORDER BY indexed_at DESC NULLS LAST, decision_id DESC, docket_number DESC NULLS LAST, decision_date DESC NULLS LAST) AS rn FROM decisions)
        SELECT id, docket, date FROM l WHERE rn = 1 AND id IN (SELECT id FROM n)""",
)
def node_labels(spark: SparkSession, base: str) -> DataFrame:
    return graph.node_labels(_graph(spark, base), table(spark, base, "decisions", ("decision_id", "docket_number", "decision_date", "indexed_at")))


@query(
    "neighbours",
    f"""WITH c AS (SELECT {sql_canonical('source')} AS id, max(recorded_at) AS recorded_at FROM edges WHERE {sql_canonical('target')} = 'bge_BGE_199_III_159' GROUP BY 1),
             d AS (SELECT DISTINCT {sql_canonical('decision_id')} AS id FROM decisions)
        SELECT id, recorded_at, id IN (SELECT id FROM d WHERE id IS NOT NULL) AS in_corpus FROM c WHERE id <> '' AND id <> 'bge_BGE_199_III_159' ORDER BY recorded_at DESC NULLS LAST, id LIMIT 25""",
)
def neighbours(spark: SparkSession, base: str) -> DataFrame:
    return graph.neighbours(table(spark, base, "edges", ("source", "target", "recorded_at")), "bge_BGE_199_III_159", table(spark, base, "decisions", ("decision_id",)), 25)


_MENTIONS_SQL = f"""
m AS (SELECT decision_id AS decision, unnest(regexp_extract_all(text, '{references.ARTICLE}', 2)) AS law, unnest(regexp_extract_all(text, '{references.ARTICLE}', 1)) AS article FROM documents WHERE decision_id IS NOT NULL),
links AS (SELECT m.decision, upper(law) AS law, article, count(*) AS mentions, max(d.language) AS language, coalesce(max(c.cited_by), 0) AS cited_by FROM m
  JOIN (SELECT decision_id AS decision, max(language) AS language FROM decisions GROUP BY 1) d USING (decision) LEFT JOIN (SELECT decision_id AS decision, max(cited_by) AS cited_by FROM counts GROUP BY 1) c USING (decision) GROUP BY 1, 2, 3)
"""


def _links(spark: SparkSession, base: str) -> DataFrame:
    found = table(spark, base, "documents", ("decision_id", "text")).filter("decision_id IS NOT NULL")
    numbers, codes = (F.regexp_extract_all("text", F.lit(references.ARTICLE), F.lit(g)) for g in (1, 2))
    mentions = found.select(F.col("decision_id").alias("decision"), F.explode(F.arrays_zip(numbers.alias("n"), codes.alias("c"))).alias("z")).select(
        "decision", F.upper("z.c").alias("law"), F.col("z.n").alias("article"), F.lit(1).alias("mentions")
    )
    decisions = table(spark, base, "decisions").groupBy(F.col("decision_id").alias("decision")).agg(F.max("language").alias("language"))
    counts = table(spark, base, "counts").groupBy(F.col("decision_id").alias("decision")).agg(F.max("cited_by").alias("cited_by"))
    return graph.statute_links(mentions, decisions, counts)


@query("statute_links", f"WITH {_MENTIONS_SQL} SELECT decision, law, article, mentions, language, cited_by FROM links")
def statute_links(spark: SparkSession, base: str) -> DataFrame:
    return _links(spark, base).select("decision", "law", "article", "mentions", "language", "cited_by")


@query("articles_of", f"WITH {_MENTIONS_SQL} SELECT decision, string_agg(DISTINCT article || ' ' || law, ', ' ORDER BY article || ' ' || law) AS articles FROM links GROUP BY 1")
def articles_of(spark: SparkSession, base: str) -> DataFrame:
    names = F.array_sort(F.collect_set(F.concat_ws(" ", "article", "law")))
    return _links(spark, base).groupBy("decision").agg(F.array_join(names, ", ").alias("articles"))


@query(
    "most_cited",
    f"""WITH {_MENTIONS_SQL}, o AS (SELECT language, decision, max(cited_by) AS cited_by FROM links WHERE law IN ('OR', 'CO') GROUP BY 1, 2)
        SELECT language, decision, cited_by, rank FROM (SELECT *, row_number() OVER (PARTITION BY language ORDER BY cited_by DESC, decision) AS rank FROM o) WHERE rank <= 40""",
)
def most_cited(spark: SparkSession, base: str) -> DataFrame:
    links = _links(spark, base)
    named = links.select("law", "article").filter("law IN ('OR', 'CO')").distinct()
    return graph.most_cited(links, named, ["language"], 40).select("language", "decision", "cited_by", "rank")


@query(
    "pool_citations",
    f"""WITH {_GRAPH_SQL}, r AS (SELECT query, document, rank FROM (
          SELECT court AS query, decision_id AS document, row_number() OVER (PARTITION BY court ORDER BY cited_by DESC, decision_id) AS rank FROM (
             SELECT d.court, c.decision_id, max(c.cited_by) AS cited_by FROM counts c JOIN decisions d USING (decision_id) WHERE c.cited_by IS NOT NULL AND d.court IS NOT NULL GROUP BY 1, 2)) WHERE rank <= 100)
        SELECT r.query, g.target AS document, round(sum(1 / sqrt(1 + r.rank)), 6) AS evidence FROM r JOIN g ON g.source = r.document
        JOIN r t ON t.query = r.query AND t.document = g.target WHERE r.rank <= 30 GROUP BY 1, 2""",
)
def pool_citations(spark: SparkSession, base: str) -> DataFrame:
    counts = table(spark, base, "counts").filter("cited_by IS NOT NULL")
    rows = counts.join(table(spark, base, "decisions").filter("court IS NOT NULL"), "decision_id").groupBy("court", "decision_id").agg(F.max("cited_by").alias("cited_by"))
    rank = F.row_number().over(Window.partitionBy("court").orderBy(F.desc("cited_by"), "decision_id"))
    ranked = rows.select(F.col("court").alias("query"), F.col("decision_id").alias("document"), rank.alias("rank")).filter("rank <= 100")
    return graph.pool_citations(ranked, _graph(spark, base), ["query"]).withColumn("evidence", F.round("evidence", 6))


# --- evaluation -----------------------------------------------------------------------------------------------------

_RUN_SQL = """
run AS (SELECT user_id AS query, row_number() OVER (PARTITION BY user_id ORDER BY value DESC NULLS LAST, event_id) AS rank, event_id AS item, event_id % 97 AS document FROM events),
gold AS (SELECT user_id AS query, arg_min(event_id, md5(CAST(event_id AS VARCHAR))) AS item FROM events WHERE event_type = 'click' GROUP BY 1)
"""


def _run(spark: SparkSession, base: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc_nulls_last("value"), "event_id"))
    return table(spark, base, "events").select(F.col("user_id").alias("query"), rank.alias("rank"), F.col("event_id").alias("item"), (F.col("event_id") % 97).alias("document"))


def _gold(spark: SparkSession, base: str) -> DataFrame:
    clicks = table(spark, base, "events").filter("event_type = 'click'")
    one = clicks.groupBy(F.col("user_id").alias("query")).agg(F.min_by("event_id", F.md5(F.col("event_id").cast("string"))).alias("item"))
    return one.withColumn("document", F.col("item") % 97)


@query(
    "known_item_metrics",
    f"""WITH {_RUN_SQL}, d AS (SELECT query, document, row_number() OVER (PARTITION BY query ORDER BY min(rank), document) AS place FROM run GROUP BY 1, 2),
        j AS (SELECT g.query, d.place, r.rank AS raw FROM gold g LEFT JOIN d ON d.query = g.query AND d.document = g.item % 97 LEFT JOIN run r ON r.query = g.query AND r.item = g.item)
        SELECT query, CAST(coalesce(place <= 1, false) AS INT) AS hit_1, CAST(coalesce(place <= 10, false) AS INT) AS hit_10, CAST(coalesce(place <= 50, false) AS INT) AS hit_50,
               round(CASE WHEN place <= 10 THEN CAST(1 AS DOUBLE) / place ELSE 0 END, 6) AS mrr_10, round(CASE WHEN place <= 10 THEN 1 / log2(place + 1) ELSE 0 END, 6) AS ndcg_10, CAST(coalesce(raw <= 10, false) AS INT) AS passage_hit_10 FROM j""",
)
def known_item_metrics(spark: SparkSession, base: str) -> DataFrame:
    return evaluation.known_item_metrics(_run(spark, base), _gold(spark, base)).withColumns({c: F.round(c, 6) for c in ("mrr_10", "ndcg_10")})


_GRADES_SQL = "grades AS (SELECT DISTINCT user_id AS query, event_id % 97 AS document, CAST(1 + event_id % 97 % 3 AS INT) AS grade FROM events WHERE event_type = 'purchase')"


def _grades(spark: SparkSession, base: str) -> DataFrame:
    document = F.col("event_id") % 97
    return table(spark, base, "events").filter("event_type = 'purchase'").select(F.col("user_id").alias("query"), document.alias("document"), (1 + document % 3).cast("int").alias("grade")).distinct()


_GRADED_SQL = f"""{_RUN_SQL}, {_GRADES_SQL},
d AS (SELECT query, document, row_number() OVER (PARTITION BY query ORDER BY min(rank), document) AS place FROM run GROUP BY 1, 2),
h AS (SELECT d.query, d.place, g.grade, row_number() OVER (PARTITION BY d.query ORDER BY d.place) AS compact FROM d JOIN grades g USING (query, document) WHERE d.place <= 10),
got AS (SELECT query, count(*) AS n, 1 / CAST(min(place) AS DOUBLE) AS mrr, sum((pow(2, grade) - 1) / log2(place + 1)) AS dcg, sum((pow(2, grade) - 1) / log2(compact + 1)) AS cdcg FROM h GROUP BY 1),
i AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY grade DESC, document) AS place FROM grades),
best AS (SELECT query, count(*) AS relevant, sum(CASE WHEN place <= 10 THEN (pow(2, grade) - 1) / log2(place + 1) END) AS idcg FROM i GROUP BY 1),
metrics AS (SELECT query, round(coalesce(n / CAST(relevant AS DOUBLE), 0), 6) AS recall, round(coalesce(mrr, 0), 6) AS mrr, round(coalesce(dcg / idcg, 0), 6) AS ndcg, round(coalesce(cdcg / idcg, 0), 6) AS compat_ndcg FROM best LEFT JOIN got USING (query))
"""


@query("graded_metrics", f"WITH {_GRADED_SQL} SELECT query, recall, mrr, ndcg, compat_ndcg FROM metrics")
def graded_metrics(spark: SparkSession, base: str) -> DataFrame:
    metrics = evaluation.graded_metrics(_run(spark, base), _grades(spark, base))
    return metrics.withColumns({c: F.round(c, 6) for c in ("recall", "mrr", "ndcg", "compat_ndcg")})


@query(
    "resolve_gold",
    f"""WITH gold AS (SELECT DISTINCT item_id AS query, unnest(regexp_extract_all(reference, '((?:BGE|ATF|DTF) [0-9]+ [IVX]+[ab]? [0-9]+)', 1)) AS ref, 1 AS grade FROM eval_items),
             a AS (SELECT DISTINCT {sql_canonical('decision_id')} AS document FROM decisions)
        SELECT g.query, a.document, max(g.grade) AS grade FROM gold g LEFT JOIN a ON a.document = {sql_canonical('g.ref')} GROUP BY 1, 2""",
)
def resolve_gold(spark: SparkSession, base: str) -> DataFrame:
    cited = F.explode(F.regexp_extract_all("reference", F.lit("((?:BGE|ATF|DTF) [0-9]+ [IVX]+[ab]? [0-9]+)"), F.lit(1)))
    gold = table(spark, base, "eval_items").select(F.col("item_id").alias("query"), cited.alias("cited")).select("query", canonical_id(F.col("cited")).alias("ref"), F.lit(1).alias("grade"))
    aliases = table(spark, base, "decisions").select(canonical_id(F.col("decision_id")).alias("ref")).distinct().withColumn("document", F.col("ref"))
    return evaluation.resolve_gold(gold, aliases)


@query(
    "paired_compare",
    f"""WITH {_GRADED_SQL} SELECT query % 3 AS language, count(*) AS pairs, round(avg(ndcg - compat_ndcg), 6) AS delta, count(*) FILTER (ndcg > compat_ndcg) AS wins, count(*) FILTER (ndcg < compat_ndcg) AS losses FROM metrics GROUP BY 1""",
)
def paired_compare(spark: SparkSession, base: str) -> DataFrame:
    metrics = graded_metrics(spark, base).withColumn("language", F.col("query") % 3)
    a = metrics.select("query", "language", F.col("compat_ndcg").alias("m"))
    return evaluation.paired_compare(a, metrics.select("query", F.col("ndcg").alias("m")), "language", "m").withColumn("delta", F.round("delta", 6))


@query("pool_recall", f"WITH {_RUN_SQL}, {_GRADES_SQL} SELECT g.query, round(count(r.document) / CAST(count(*) AS DOUBLE), 6) AS recall, count(r.document) > 0 AS hit FROM grades g LEFT JOIN (SELECT DISTINCT query, document FROM run WHERE rank <= 30) r USING (query, document) GROUP BY 1")
def pool_recall(spark: SparkSession, base: str) -> DataFrame:
    return evaluation.pool_recall(_run(spark, base).filter("rank <= 30"), _grades(spark, base)).withColumn("recall", F.round("recall", 6))


@query(
    "pick_gold",
    """WITH e AS (SELECT DISTINCT id, decision_id, language, section, chunk_index, length(text) AS size, count(*) OVER (PARTITION BY decision_id) AS passages FROM (SELECT DISTINCT id, decision_id, language, section, chunk_index, text FROM chunks)),
            f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY decision_id ORDER BY md5(CAST(id AS VARCHAR)), id) AS own FROM e WHERE section <> 'regeste' AND size >= 800 AND chunk_index >= CASE WHEN passages >= 5 THEN 2 ELSE 1 END AND language IN ('de', 'fr', 'it')) WHERE own = 1)
       SELECT language, id, CASE WHEN (strpos('0123456789abcdef', substr(md5(CAST(id AS VARCHAR)), 32, 1)) - 1) % 2 = 0 THEN 'keywords' ELSE 'question' END AS style
       FROM (SELECT *, row_number() OVER (PARTITION BY language ORDER BY md5(id || ':7'), id) AS rn FROM f) WHERE rn <= 20""",
)
def pick_gold(spark: SparkSession, base: str) -> DataFrame:
    """Test passages: eligible ones, one per judgment, a quota per language by hash, a question style by hash."""
    rows = table(spark, base, "chunks").select("id", "decision_id", "language", "section", "chunk_index", "text").distinct()
    sized = rows.select("id", "decision_id", "language", "section", "chunk_index", F.length("text").alias("size")).withColumn("passages", F.count(F.lit(1)).over(Window.partitionBy("decision_id"))).distinct()
    fit = sized.filter((F.col("section") != "regeste") & (F.col("size") >= 800) & (F.col("chunk_index") >= F.when(F.col("passages") >= 5, 2).otherwise(1)) & F.col("language").isin("de", "fr", "it"))
    own = Window.partitionBy("decision_id").orderBy(F.md5(F.col("id").cast("string")), "id")
    first = fit.withColumn("own", F.row_number().over(own)).filter("own = 1").withColumn("quota", F.lit(20))
    last = F.conv(F.substring(F.md5(F.col("id").cast("string")), 32, 1), 16, 10).cast("int")
    picked = hashrank.hash_rank(first, ["language"], "id", 7, quota="quota")
    return picked.select("language", "id", F.when(last % 2 == 0, F.lit("keywords")).otherwise(F.lit("question")).alias("style"))


@query(
    "reference_status",
    f"""WITH r AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(question, '{references.ARTICLE}', 1)) AS article, unnest(regexp_extract_all(question, '{references.ARTICLE}', 2)) AS law FROM eval_items),
             s AS (SELECT DISTINCT regexp_extract(text, '^Art\\. ([0-9]+[a-z]?) ([A-Za-z]+)', 1) AS article, regexp_extract(text, '^Art\\. ([0-9]+[a-z]?) ([A-Za-z]+)', 2) AS law FROM documents WHERE kind = 'statute')
        SELECT item_id, article, law, CASE WHEN law NOT IN (SELECT law FROM s) THEN 'unknown_act' WHEN (law, article) NOT IN (SELECT (law, article) FROM s) THEN 'unknown_article' ELSE 'ok' END AS status FROM r""",
)
def reference_status(spark: SparkSession, base: str) -> DataFrame:
    pattern = r"^Art\. ([0-9]+[a-z]?) ([A-Za-z]+)"
    articles = table(spark, base, "documents").filter("kind = 'statute'").select(F.regexp_extract("text", pattern, 1).alias("article"), F.regexp_extract("text", pattern, 2).alias("law")).distinct()
    numbers, codes = (F.regexp_extract_all("question", F.lit(references.ARTICLE), F.lit(g)) for g in (1, 2))
    named = table(spark, base, "eval_items").select("item_id", F.explode(F.arrays_zip(numbers.alias("n"), codes.alias("c"))).alias("z")).select("item_id", F.col("z.n").alias("article"), F.col("z.c").alias("law")).distinct()
    return evaluation.reference_status(named, articles, articles).select("item_id", "article", "law", "status")


@query("cer_by_group", "SELECT court, round(sum(levenshtein(docket_number, decision_id)) / CAST(sum(length(decision_id)) AS DOUBLE), 6) AS cer FROM decisions WHERE docket_number IS NOT NULL AND decision_id IS NOT NULL GROUP BY 1")
def cer_by_group(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "decisions").filter("docket_number IS NOT NULL AND decision_id IS NOT NULL")
    return rows.groupBy("court").agg(F.round(F.sum(F.levenshtein("docket_number", "decision_id")) / F.sum(F.length("decision_id")), 6).alias("cer"))


_FOLD = r"regexp_replace(lower(regexp_replace({0}, '\[[0-9]+\]', '', 'g')), '\s+', '', 'g')"


@query(
    "contains_folded",
    f"""WITH p AS (SELECT item_id, {_FOLD.format("question || coalesce(reference, '')")} AS whole, {_FOLD.format('point')} AS part FROM (SELECT item_id, question, reference, unnest(rubric) AS point FROM eval_items))
        SELECT item_id, count(*) AS points, count(*) FILTER (contains(whole, part) OR (length(part) >= 60 AND contains(whole, left(part, 60)))) AS held FROM p GROUP BY 1""",
)
def contains_folded(spark: SparkSession, base: str) -> DataFrame:
    points = table(spark, base, "eval_items").select("item_id", F.concat("question", F.coalesce("reference", F.lit(""))).alias("whole"), F.explode("rubric").alias("point"))
    return points.groupBy("item_id").agg(count("points"), F.count_if(evaluation.contains_folded(F.col("whole"), F.col("point"))).alias("held"))


@query("rubric_coverage", "SELECT user_id, round(sum(CASE event_type WHEN 'purchase' THEN 2 WHEN 'click' THEN 1 ELSE 0 END) / (2.0 * count(*)), 6) AS coverage FROM events GROUP BY 1")
def rubric_coverage(spark: SparkSession, base: str) -> DataFrame:
    points = F.when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "click", 1).otherwise(0)
    return table(spark, base, "events").groupBy("user_id").agg(F.round(F.sum(points) / (2.0 * F.count(F.lit(1))), 6).alias("coverage"))


@query("letter_accuracy", "SELECT kind, count(*) AS n, count(*) FILTER (letter = 'A') AS correct, count(*) FILTER (letter IS NULL) AS missing FROM (SELECT kind, nullif(regexp_extract_all(text, '\\b([A-Z])\\._{4,}', 1)[-1], '') AS letter FROM documents) GROUP BY 1")
def letter_accuracy(spark: SparkSession, base: str) -> DataFrame:
    """Accuracy of the last letter a text names; texts without one are counted as missing."""
    letter = references.last_match(F.col("text"), r"\b([A-Z])\._{4,}")
    return table(spark, base, "documents").select("kind", letter.alias("letter")).groupBy("kind").agg(count(), F.count_if(F.col("letter") == "A").alias("correct"), F.count_if(F.col("letter").isNull()).alias("missing"))


@query("mention_in_text", r"SELECT item_id, number, regexp_matches(coalesce(reference, ''), '\b' || number || '\b[^.!?]{0,40}\b' || code || '\b') AS named FROM (SELECT DISTINCT item_id, reference, unnest(regexp_extract_all(question, '\bArt\. ([0-9]+)[a-z]? ([A-Z][A-Za-z]+)', 1)) AS number, unnest(regexp_extract_all(question, '\bArt\. ([0-9]+)[a-z]? ([A-Z][A-Za-z]+)', 2)) AS code FROM eval_items) GROUP BY ALL")
def mention_in_text(spark: SparkSession, base: str) -> DataFrame:
    pattern = F.lit(r"\bArt\. ([0-9]+)[a-z]? ([A-Z][A-Za-z]+)")
    zipped = F.explode(F.arrays_zip(F.regexp_extract_all("question", pattern, F.lit(1)).alias("n"), F.regexp_extract_all("question", pattern, F.lit(2)).alias("c")))
    rows = table(spark, base, "eval_items").select("item_id", "reference", zipped.alias("z")).select("item_id", "reference", F.col("z.n").alias("number"), F.col("z.c").alias("code"))
    near = F.concat(F.lit(r"\b"), F.col("number"), F.lit(r"\b[^.!?]{0,40}\b"), F.col("code"), F.lit(r"\b"))
    return rows.select("item_id", "number", F.regexp_like(F.coalesce("reference", F.lit("")), near).alias("named")).distinct()


@query("parse_order", "SELECT * FROM (VALUES (1, '3,1,2'), (2, '5'), (3, '')) t(id, ranking)")
def parse_order(spark: SparkSession, base: str) -> DataFrame:
    rows = spark.createDataFrame([(1, "[3], [1], 99, 3, 2"), (2, "nur 5."), (3, "keine")], "id int, text string")
    return rows.select("id", F.array_join(evaluation.parse_order(F.col("text"), 9), ",").alias("ranking"))


# --- streams --------------------------------------------------------------------------------------------------------


@query("apply_deltas", "SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE CAST(ts AS DATE) > DATE '2024-01-10') WHERE rn = 1")
def apply_deltas(spark: SparkSession, base: str) -> DataFrame:
    return streams.latest_by_day(table(spark, base, "events"), "2024-01-10").select("user_id", "event_id", "ts")


@query(
    "sessionize_events",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
            s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
       SELECT user_id, epoch_us(min(ts)) AS session_start, epoch_us(max(ts)) AS session_end, count(*) AS n FROM s GROUP BY user_id, session""",
)
def sessionize_events(spark: SparkSession, base: str) -> DataFrame:
    found = streams.sessions(table(spark, base, "events", ("user_id", "ts")))
    return found.select("user_id", F.unix_micros("session_start").alias("session_start"), F.unix_micros("session_end").alias("session_end"), "n")


@query("tumbling_event_counts", "SELECT epoch_us(date_trunc('hour', ts)) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_event_counts(spark: SparkSession, base: str) -> DataFrame:
    return streams.tumbling_counts(table(spark, base, "events", ("ts", "event_type"))).withColumn("window_start", F.unix_micros("window_start"))


@query(
    "sliding_event_sums",
    """SELECT epoch_us(w) AS window_start, event_type, round(sum(value), 4) AS total FROM (
         SELECT date_trunc('hour', ts) AS w, event_type, value FROM events UNION ALL SELECT date_trunc('hour', ts) - INTERVAL 1 HOUR, event_type, value FROM events) GROUP BY 1, 2""",
)
def sliding_event_sums(spark: SparkSession, base: str) -> DataFrame:
    return streams.sliding_sums(table(spark, base, "events", ("ts", "event_type", "value"))).withColumn("window_start", F.unix_micros("window_start"))


@query(
    "fold_turn_events",
    "SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, string_agg(event_type, '>' ORDER BY ts, event_id) AS kinds, arg_max(event_type, struct_pack(ts := ts, event_id := event_id)) AS last_payload FROM events GROUP BY 1, 2",
)
def fold_turn_events(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "events").withColumn("day", F.to_date("ts"))
    return streams.fold_turns(rows, ["user_id", "day"], ["ts", "event_id"], "event_type", "event_type")


# --- states of stores and jobs --------------------------------------------------------------------------------------


@query(
    "vector_staleness",
    """WITH c AS (SELECT DISTINCT id FROM chunks WHERE id IS NOT NULL), v AS (SELECT DISTINCT chunk_rowid AS id FROM passage_vectors WHERE chunk_rowid IS NOT NULL)
       SELECT count(c.id) AS passages, count(v.id) AS vectors, count(*) FILTER (v.id IS NULL) AS missing, count(*) FILTER (c.id IS NULL) AS unknown,
              count(*) FILTER (v.id IS NULL OR c.id IS NULL) > 0 AS stale FROM c FULL JOIN v ON c.id = v.id""",
)
def vector_staleness(spark: SparkSession, base: str) -> DataFrame:
    """Whether the vectors are those of the passages: passages without a vector, vectors without a passage."""
    held = table(spark, base, "chunks", ("id",)).filter("id IS NOT NULL").distinct()
    made = table(spark, base, "passage_vectors", ("chunk_rowid",)).filter("chunk_rowid IS NOT NULL").select(F.col("chunk_rowid").alias("vec")).distinct()
    missing, unknown = F.col("vec").isNull(), F.col("id").isNull()
    return held.join(made, held["id"] == made["vec"], "full").agg(
        F.count("id").alias("passages"), F.count("vec").alias("vectors"), F.count_if(missing).alias("missing"), F.count_if(unknown).alias("unknown"),
        (F.count_if(missing | unknown) > 0).alias("stale"),
    )


@query(
    "distribution_manifest",
    """WITH long AS (SELECT 'language' AS dimension, coalesce(language, 'unknown') AS v, decision_id FROM decisions UNION ALL SELECT 'court', coalesce(court, 'unknown'), decision_id FROM decisions),
            n AS (SELECT dimension, v, count(*) AS n FROM long GROUP BY 1, 2)
       SELECT dimension, '{' || string_agg('"' || v || '":' || n, ',' ORDER BY v) || '}' AS manifest FROM n GROUP BY 1""",
)
def distribution_manifest(spark: SparkSession, base: str) -> DataFrame:
    """Counts per value of a dimension as one JSON object, values in order."""
    rows = table(spark, base, "decisions", ("language", "court"))
    named = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.coalesce(d, F.lit("unknown")).alias("v")) for d in ("language", "court")]))
    counts = rows.select(named.alias("x")).groupBy("x.dimension", "x.v").agg(count())
    ordered = F.map_from_entries(F.array_sort(F.collect_list(F.struct("v", "n"))))  # one entry per value of a dimension
    return counts.groupBy("dimension").agg(F.to_json(ordered).alias("manifest"))


@query(
    "grading_dispatch",
    r"""SELECT item_id, CASE WHEN reference IS NULL THEN 'unjudged' WHEN regexp_matches(question, '(?m)^\s*[A-D][.)]\s') OR level = 'choice' THEN 'exact' ELSE 'judge' END AS grading FROM eval_items""",
)
def grading_dispatch(spark: SparkSession, base: str) -> DataFrame:
    choice = F.col("question").rlike(r"(?m)^\s*[A-D][.)]\s") | (F.col("level") == "choice")
    grading = evaluation.grading(F.col("reference").isNull(), F.coalesce(choice, F.lit(False)))
    return table(spark, base, "eval_items").select("item_id", grading.alias("grading"))


@query(
    "unexpired_jobs",
    "SELECT event_id FROM events WHERE event_type <> 'purchase' OR ts >= (SELECT max(ts) FROM events) - INTERVAL 30 MINUTE",
)
def unexpired_jobs(spark: SparkSession, base: str) -> DataFrame:
    """Purchases are jobs that are done: they are kept for 30 minutes; other events still run."""
    rows = table(spark, base, "events", ("event_id", "event_type", "ts"))
    jobs = rows.withColumn("finished", F.when(F.col("event_type") == "purchase", F.col("ts"))).crossJoin(F.broadcast(rows.agg(F.max("ts").alias("now"))))  # one row
    return streams.unexpired(jobs, "finished", F.col("now")).select("event_id")
