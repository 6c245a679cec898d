"""Queries of the relational operators: scans, writes, projections, filters, joins, aggregates, windows, sorts, sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gavelgrid.functions.identity import canonical_id
from gavelgrid.operators import facets, ingest, sampling
from gavelgrid.operators.hashrank import hash_rank, priority
from gavelgrid.plans.orphans import sql_canonical
from gavelgrid.plans.registry import Registry
from gavelgrid.sources.tables import table

REGISTRY = Registry()
query = REGISTRY.query
SEED = 42


def count(name: str = "n"):
    return F.count(F.lit(1)).alias(name)


# --- sources and sinks ----------------------------------------------------------------------------------------------


@query("scan_documents", "SELECT doc_id, lang, source, n_chars FROM documents WHERE lang = 'de' AND n_chars > 500")
def scan_documents(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "documents").filter("lang = 'de' AND n_chars > 500").select("doc_id", "lang", "source", "n_chars")


@query(
    "vector_id_alignment",
    """SELECT problem, id FROM (
         SELECT 'vector_without_chunk' AS problem, chunk_rowid AS id FROM passage_vectors WHERE chunk_rowid NOT IN (SELECT id FROM chunks WHERE id IS NOT NULL)
         UNION ALL SELECT 'chunk_without_vector', id FROM chunks WHERE id NOT IN (SELECT chunk_rowid FROM passage_vectors WHERE chunk_rowid IS NOT NULL)
       ) GROUP BY ALL""",
)
def vector_id_alignment(spark: SparkSession, base: str) -> DataFrame:
    vectors = table(spark, base, "passage_vectors").select(F.col("chunk_rowid").alias("id"))
    chunks = table(spark, base, "chunks").select("id")
    lost = vectors.join(chunks, "id", "left_anti").withColumn("problem", F.lit("vector_without_chunk"))
    bare = chunks.join(vectors, "id", "left_anti").withColumn("problem", F.lit("chunk_without_vector"))
    return lost.unionByName(bare).filter("id IS NOT NULL").distinct()


_LATEST = "indexed_at DESC NULLS LAST, court DESC NULLS LAST, text_length DESC NULLS LAST"


@query(
    "upsert_latest_wins",
    f"""SELECT decision_id, indexed_at, court, text_length FROM (
          SELECT *, row_number() OVER (PARTITION BY decision_id ORDER BY indexed_at DESC NULLS LAST, src DESC, court DESC NULLS LAST, text_length DESC NULLS LAST) AS rn
          FROM (SELECT *, CASE WHEN indexed_at >= TIMESTAMP '2024-01-01' THEN 1 ELSE 0 END AS src FROM decisions WHERE indexed_at IS NOT NULL))
        WHERE rn = 1""",
)
def upsert_latest_wins(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "decisions", ("decision_id", "indexed_at", "court", "text_length"))
    split = F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00"))
    return ingest.upsert_latest(rows.filter(F.col("indexed_at") < split), rows.filter(F.col("indexed_at") >= split), ["decision_id"], "indexed_at")


@query(
    "insert_ignore",
    """WITH base AS (SELECT DISTINCT decision_id, wave FROM selected_decisions WHERE wave <= 3),
            fresh AS (SELECT decision_id, min(wave) AS wave FROM selected_decisions WHERE wave > 3 GROUP BY 1)
       SELECT * FROM base UNION ALL SELECT * FROM fresh WHERE decision_id NOT IN (SELECT decision_id FROM base WHERE decision_id IS NOT NULL)""",
)
def insert_ignore(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "selected_decisions", ("decision_id", "wave"))
    return ingest.insert_ignore(rows.filter("wave <= 3").distinct(), rows.filter("wave > 3"), ["decision_id"])


@query(
    "cascade_delete",
    """SELECT id, chunk_id, decision_id FROM chunks
       WHERE decision_id IS NULL OR decision_id NOT IN (SELECT decision_id FROM removed_decisions WHERE decision_id IS NOT NULL)""",
)
def cascade_delete(spark: SparkSession, base: str) -> DataFrame:
    chunks = table(spark, base, "chunks", ("id", "chunk_id", "decision_id"))
    return ingest.cascade_delete(chunks, table(spark, base, "removed_decisions"), "decision_id").select("id", "chunk_id", "decision_id")


@query(
    "append_ids",
    """SELECT o_orderkey, (SELECT max(o_orderkey) FROM orders WHERE o_orderstatus <> 'P') + row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS new_id
       FROM orders WHERE o_orderstatus = 'P'""",
)
def append_ids(spark: SparkSession, base: str) -> DataFrame:
    orders = table(spark, base, "orders", ("o_orderkey", "o_orderdate", "o_orderstatus"))
    kept = orders.filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("new_id"))
    fresh = orders.filter("o_orderstatus = 'P'")
    return ingest.append_ids(fresh, [F.col("o_orderdate"), F.col("o_orderkey")], kept, "new_id").select("o_orderkey", "new_id")


@query(
    "resume_missing_only",
    "SELECT id, decision_id, chunk_index FROM chunks WHERE id NOT IN (SELECT chunk_rowid FROM passage_vectors WHERE embedding IS NOT NULL)",
)
def resume_missing_only(spark: SparkSession, base: str) -> DataFrame:
    done = table(spark, base, "passage_vectors").filter("embedding IS NOT NULL").select(F.col("chunk_rowid").alias("id"))
    return ingest.missing_only(table(spark, base, "chunks", ("id", "decision_id", "chunk_index")), done, "id")


@query(
    "skip_unchanged",
    """WITH recorded AS (SELECT decision_id, min(content_hash) AS content_hash FROM decisions WHERE content_hash IS NOT NULL AND indexed_at < TIMESTAMP '2023-06-01' GROUP BY 1),
            found AS (SELECT decision_id, max(content_hash) AS content_hash FROM decisions WHERE content_hash IS NOT NULL GROUP BY 1)
       SELECT f.decision_id, f.content_hash FROM found f LEFT JOIN recorded r USING (decision_id)
       WHERE r.content_hash IS NULL OR r.content_hash <> f.content_hash""",
)
def skip_unchanged(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "decisions", ("decision_id", "content_hash", "indexed_at")).filter("content_hash IS NOT NULL")
    recorded = rows.filter(F.col("indexed_at") < F.to_timestamp_ntz(F.lit("2023-06-01 00:00:00"))).groupBy("decision_id").agg(F.min("content_hash").alias("content_hash"))
    found = rows.groupBy("decision_id").agg(F.max("content_hash").alias("content_hash"))
    return ingest.changed_only(found, recorded, "decision_id", "content_hash").filter("decision_id IS NOT NULL")


# --- projections ----------------------------------------------------------------------------------------------------

_YEAR = "CASE WHEN regexp_matches(substr(decision_date, 1, 4), '^[0-9]{4}$') THEN CAST(substr(decision_date, 1, 4) AS INT) END"
_PERIOD = """CASE WHEN y IS NULL THEN 'unknown' WHEN y < 1954 THEN '1875-1953' WHEN y < 2000 THEN '1954-1999'
             WHEN y < 2010 THEN '2000-2009' WHEN y < 2020 THEN '2010-2019' ELSE '2020+' END"""


@query("period_buckets", f"SELECT {_PERIOD} AS period, count(*) AS n FROM (SELECT {_YEAR} AS y FROM decisions) GROUP BY 1")
def period_buckets(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "decisions", ("decision_date",))
    return rows.groupBy(facets.period(facets.year_of(F.col("decision_date"))).alias("period")).agg(count())


@query(
    "jurisdiction_label",
    """SELECT decision_id, CASE WHEN canton = 'CH' THEN CASE WHEN court = 'bge_historical' THEN 'bge' ELSE court END ELSE canton END AS jurisdiction, indexed_at
       FROM decisions""",
)
def jurisdiction_label(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "decisions").select("decision_id", facets.jurisdiction(F.col("court"), F.col("canton")).alias("jurisdiction"), "indexed_at")


@query("year_try_cast", f"SELECT decision_id, {_YEAR} AS year FROM decisions")
def year_try_cast(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "decisions").select("decision_id", facets.year_of(F.col("decision_date")).alias("year"))


@query("chunk_key", "SELECT id, concat_ws('#', decision_id, CAST(chunk_index AS VARCHAR)) AS chunk_key, chunk_id = concat_ws('#', decision_id, CAST(chunk_index AS VARCHAR)) AS agrees FROM chunks")
def chunk_key(spark: SparkSession, base: str) -> DataFrame:
    key = F.concat_ws("#", "decision_id", F.col("chunk_index").cast("string"))
    return table(spark, base, "chunks").select("id", key.alias("chunk_key"), (F.col("chunk_id") == key).alias("agrees"))


@query(
    "normalise_articles",
    """SELECT doc_id, lower(trim(coalesce(nullif(lang, ''), 'unknown'))) AS language, trim(regexp_replace(split_part(text, chr(10), 1), '<[^>]+>', '', 'g')) AS heading,
              coalesce(court, source) AS origin, n_chars > 0 AS is_active
       FROM documents WHERE kind = 'statute'""",
)
def normalise_articles(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "documents", ("doc_id", "lang", "text", "court", "source", "n_chars", "kind")).filter("kind = 'statute'")
    return rows.select(
        "doc_id",
        F.lower(F.trim(F.coalesce(F.nullif("lang", F.lit("")), F.lit("unknown")))).alias("language"),
        F.trim(F.regexp_replace(F.split_part("text", F.lit("\n"), F.lit(1)), "<[^>]+>", "")).alias("heading"),
        F.coalesce("court", "source").alias("origin"),
        (F.col("n_chars") > 0).alias("is_active"),
    )


STATUS = {"F": "finished", "O": "open"}


@query("map_vocabulary", "SELECT CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE '' END AS status, count(*) AS n FROM orders GROUP BY 1")
def map_vocabulary(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "orders", ("o_orderstatus",)).groupBy(facets.mapped(F.col("o_orderstatus"), STATUS).alias("status")).agg(count())


@query("dictionary_encode", "SELECT source, CAST(dense_rank() OVER (ORDER BY source) - 1 AS BIGINT) AS code FROM (SELECT DISTINCT coalesce(source, '') AS source FROM documents)")
def dictionary_encode(spark: SparkSession, base: str) -> DataFrame:
    values = table(spark, base, "documents").select(F.coalesce("source", F.lit("")).alias("source")).distinct()
    return ingest.global_position(values, [F.col("source")], "code").withColumn("code", F.col("code") - 1)


@query("item_label", "SELECT decision_id, concat_ws(', ', nullif(trim(court), ''), nullif(trim(docket_number), ''), nullif(trim(decision_date), '')) AS label FROM decisions")
def item_label(spark: SparkSession, base: str) -> DataFrame:
    parts = [F.nullif(F.trim(c), F.lit("")) for c in ("court", "docket_number", "decision_date")]
    return table(spark, base, "decisions").select("decision_id", F.concat_ws(", ", *parts).alias("label"))


@query("row_index", "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row_index FROM documents")
def row_index(spark: SparkSession, base: str) -> DataFrame:
    rows = ingest.global_position(table(spark, base, "documents", ("doc_id",)), [F.col("doc_id")], "row_index")
    return rows.withColumn("row_index", F.col("row_index") - 1)


_INT_DATE = "coalesce(TRY_CAST(substr(regexp_replace(decision_date, '[^0-9]', '', 'g'), 1, 8) AS INT), 0)"


@query("int_date", f"SELECT decision_id, {_INT_DATE} AS date FROM decisions")
def int_date(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "decisions").select("decision_id", facets.int_date(F.col("decision_date")).alias("date"))


@query("hash_parity_style", "SELECT id, CASE WHEN (strpos('0123456789abcdef', substr(md5(CAST(id AS VARCHAR)), 32, 1)) - 1) % 2 = 0 THEN 'keywords' ELSE 'question' END AS style FROM chunks")
def hash_parity_style(spark: SparkSession, base: str) -> DataFrame:
    last = F.conv(F.substring(F.md5(F.col("id").cast("string")), 32, 1), 16, 10).cast("int")
    return table(spark, base, "chunks").select("id", F.when(last % 2 == 0, F.lit("keywords")).otherwise(F.lit("question")).alias("style"))


# --- filters --------------------------------------------------------------------------------------------------------


@query("usable_documents", "SELECT doc_id FROM documents WHERE length(trim(text)) > 0 AND (n_chars >= 500 OR (court = 'bge' AND n_chars > 0))")
def usable_documents(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "documents", ("doc_id", "text", "n_chars", "court"))
    return rows.filter("length(trim(text)) > 0 AND (n_chars >= 500 OR (court = 'bge' AND n_chars > 0))").select("doc_id")


@query("pool_with_exemption", "SELECT decision_id, court, decision_date FROM decisions WHERE decision_date >= '2015' OR court IN ('bge', 'bge_historical')")
def pool_with_exemption(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "decisions").filter("decision_date >= '2015' OR court IN ('bge', 'bge_historical')").select("decision_id", "court", "decision_date")


@query(
    "facet_filter",
    """SELECT 'known' AS case_name, decision_id FROM decisions WHERE language IN ('de', 'fr') AND court IN ('bger')
       UNION ALL SELECT 'no_filter', decision_id FROM decisions""",
)
def facet_filter(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "decisions", ("decision_id", "language", "court"))
    known = {"language": ["de", "fr", "it"], "court": ["bger", "bge"]}
    cases = {
        "known": {"language": ["de", "fr", "xx"], "court": ["bger"]},
        "all_unknown": {"language": ["de"], "court": ["nowhere"]},
        "no_filter": {"language": None, "court": None},
    }
    parts = []
    for name, wanted in cases.items():
        condition = facets.facet_condition(wanted, known)
        kept = rows if condition is None else rows.filter(condition)
        parts.append(kept.select(F.lit(name).alias("case_name"), "decision_id"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_NAMED = {"supreme": ("bge", "bger"), "administrative": ("bvger",)}


@query(
    "court_groups",
    """SELECT court, CASE WHEN court IN ('bge', 'bger') THEN 'supreme' WHEN court IN ('bvger') THEN 'administrative' WHEN home <> 'CH' THEN 'cantonal' ELSE 'federal_other' END AS court_group
       FROM (SELECT court, arg_min(canton, decision_id) AS home FROM (SELECT DISTINCT court, decision_id, min(canton) AS canton FROM decisions GROUP BY 1, 2) WHERE court IS NOT NULL AND canton IS NOT NULL GROUP BY 1)""",
)
def court_groups(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "decisions").groupBy("court", "decision_id").agg(F.min("canton").alias("canton")).filter("canton IS NOT NULL")
    return facets.court_groups(rows, "court", "canton", "decision_id", _NAMED)


@query(
    "proceeding_groups",
    """SELECT proceeding, count(*) AS n FROM (
         SELECT CASE WHEN event_type IN ('view', 'click') THEN 'browse' WHEN event_type IN ('purchase', 'signup') THEN 'convert' END AS proceeding FROM events)
       WHERE proceeding IS NOT NULL GROUP BY 1""",
)
def proceeding_groups(spark: SparkSession, base: str) -> DataFrame:
    members = {"view": "browse", "click": "browse", "purchase": "convert", "signup": "convert"}
    named = table(spark, base, "events", ("event_type",)).select(F.nullif(facets.mapped(F.col("event_type"), members), F.lit("")).alias("proceeding"))
    return named.filter("proceeding IS NOT NULL").groupBy("proceeding").agg(count())


@query(
    "year_range",
    f"""WITH d AS (SELECT decision_id, {_INT_DATE} AS date FROM decisions)
        SELECT 'from' AS bound, decision_id, date FROM d WHERE date >= 20100000 UNION ALL SELECT 'to', decision_id, date FROM d WHERE date < 20000000 AND date > 0""",
)
def year_range(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "decisions").select("decision_id", facets.int_date(F.col("decision_date")).alias("date"))
    low = rows.filter(facets.year_range(F.col("date"), 2010, None)).withColumn("bound", F.lit("from"))
    return low.unionByName(rows.filter(facets.year_range(F.col("date"), None, 1999)).withColumn("bound", F.lit("to")))


@query("act_filter", "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus || '/' || o_orderpriority IN ('F/1-URGENT', 'O/5-LOW')")
def act_filter(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "orders", ("o_orderkey", "o_orderstatus", "o_orderpriority"))
    return rows.filter(F.concat_ws("/", "o_orderstatus", "o_orderpriority").isin("F/1-URGENT", "O/5-LOW"))


@query("facet_semi_join", "SELECT id, decision_id FROM chunks WHERE decision_id IN (SELECT decision_id FROM decisions WHERE language = 'it' AND canton = 'TI')")
def facet_semi_join(spark: SparkSession, base: str) -> DataFrame:
    kept = table(spark, base, "decisions").filter("language = 'it' AND canton = 'TI'").select("decision_id")
    return table(spark, base, "chunks", ("id", "decision_id")).join(kept, "decision_id", "left_semi").select("id", "decision_id")


_ASKED = (("ZH",), ("zurich",), ("Tessin",), ("genev",), ("b",), ("Atlantis",), ("VD",))
_PLACES = (("ZH",), ("VD",), ("BE",), ("BS",), ("Genève",), ("Ticino",), ("Zürich",))


@query(
    "resolve_value",
    """SELECT * FROM (VALUES ('ZH', 'ZH'), ('zurich', 'Zürich'), ('Tessin', 'Ticino'), ('genev', 'Genève'), ('b', NULL), ('Atlantis', NULL), ('VD', 'VD')) t(asked, value)""",
)
def resolve_value(spark: SparkSession, base: str) -> DataFrame:
    from gavelgrid.functions.text import fold_accents

    asked = spark.createDataFrame(_ASKED, "asked string")
    known = spark.createDataFrame(_PLACES, "value string")
    return facets.resolve_values(asked, known, {"tessin": "Ticino"}, lambda c: fold_accents(F.lower(c)))


@query(
    "parse_filter_list",
    """SELECT * FROM (VALUES ('ZH, Bern und Genf', 'ZH', 'ZH'), ('ZH, Bern und Genf', 'Bern', 'BE'), ('ZH, Bern und Genf', 'Genf', 'GE'),
                             ('vaud et Narnia', 'vaud', 'VD'), ('vaud et Narnia', 'Narnia', NULL)) t(filter_text, part, code)""",
)
def parse_filter_list(spark: SparkSession, base: str) -> DataFrame:
    rows = spark.createDataFrame([("ZH, Bern und Genf",), ("vaud et Narnia",), ("alle",), (None,)], "filter_text string")
    names = {"zh": "ZH", "bern": "BE", "genf": "GE", "vaud": "VD"}
    parts = F.explode(F.split("filter_text", r"\s*[,;/]\s*|\s+(?:und|and|et|e)\s+")).alias("part")
    split = rows.select("filter_text", parts).filter(~F.lower(F.trim("part")).isin("", "alle", "all", "tous", "none", "keine"))
    return split.select("filter_text", F.trim("part").alias("part"), F.nullif(facets.mapped(F.lower(F.trim("part")), names), F.lit("")).alias("code"))


@query(
    "filter_selectivity",
    """SELECT count(*) FILTER (language = 'rm') AS rm, count(*) FILTER (canton = 'AI') AS ai, count(*) FILTER (has_full_text) AS full_text,
              count(*) FILTER (language = 'rm' AND canton = 'AI' AND has_full_text) AS together FROM decisions""",
)
def filter_selectivity(spark: SparkSession, base: str) -> DataFrame:
    conditions = {"rm": F.col("language") == "rm", "ai": F.col("canton") == "AI", "full_text": F.col("has_full_text")}
    return facets.selectivity(table(spark, base, "decisions", ("language", "canton", "has_full_text")), conditions)


@query(
    "prefer_physical",
    f"""WITH d AS (SELECT DISTINCT decision_id, {sql_canonical('decision_id')} AS canon FROM decisions WHERE decision_id IS NOT NULL)
        SELECT canon, coalesce(max(CASE WHEN decision_id = canon THEN decision_id END), min(decision_id)) AS preferred FROM d GROUP BY 1""",
)
def prefer_physical(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "decisions").filter("decision_id IS NOT NULL").select("decision_id", canonical_id(F.col("decision_id")).alias("canon"))
    own = F.max(F.when(F.col("decision_id") == F.col("canon"), F.col("decision_id")))
    return rows.groupBy("canon").agg(F.coalesce(own, F.min("decision_id")).alias("preferred"))


@query(
    "headnote_mask",
    "SELECT DISTINCT c.id FROM chunks c JOIN decisions d USING (decision_id) WHERE c.section = 'regeste' AND d.court IN ('bge', 'bge_historical')",
)
def headnote_mask(spark: SparkSession, base: str) -> DataFrame:
    leading = table(spark, base, "decisions").filter("court IN ('bge', 'bge_historical')").select("decision_id")
    return table(spark, base, "chunks", ("id", "decision_id", "section")).filter("section = 'regeste'").join(leading, "decision_id", "left_semi").select("id").distinct()


@query(
    "eligible_passages",
    """SELECT id, decision_id, chunk_index, n_passages FROM (
         SELECT *, count(*) OVER (PARTITION BY decision_id) AS n_passages FROM (SELECT DISTINCT id, decision_id, chunk_index, section, length(text) AS size FROM chunks))
       WHERE section <> 'regeste' AND size >= 800 AND chunk_index >= CASE WHEN n_passages >= 5 THEN 2 ELSE 1 END""",
)
def eligible_passages(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "chunks").select("id", "decision_id", "chunk_index", "section", F.length("text").alias("size")).distinct()
    sized = rows.withColumn("n_passages", F.count(F.lit(1)).over(Window.partitionBy("decision_id")))
    first = F.when(F.col("n_passages") >= 5, 2).otherwise(1)
    return sized.filter((F.col("section") != "regeste") & (F.col("size") >= 800) & (F.col("chunk_index") >= first)).select("id", "decision_id", "chunk_index", "n_passages")


@query(
    "drop_reasons",
    """SELECT CASE WHEN text IS NULL OR text = '' THEN 'empty' WHEN n_chars < 200 THEN 'short' WHEN n_chars > 20000 THEN 'long' ELSE 'kept' END AS reason, count(*) AS n
       FROM documents GROUP BY 1""",
)
def drop_reasons(spark: SparkSession, base: str) -> DataFrame:
    reason = F.when(F.col("text").isNull() | (F.col("text") == ""), "empty").when(F.col("n_chars") < 200, "short").when(F.col("n_chars") > 20000, "long").otherwise("kept")
    return table(spark, base, "documents", ("text", "n_chars")).groupBy(reason.alias("reason")).agg(count())


# --- joins ----------------------------------------------------------------------------------------------------------


@query("join_inner", "SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'P'")
def join_inner(spark: SparkSession, base: str) -> DataFrame:
    orders = table(spark, base, "orders", ("o_orderkey", "o_custkey", "o_orderstatus")).filter("o_orderstatus = 'P'")
    customer, nation = table(spark, base, "customer"), table(spark, base, "nation")
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey).join(nation, customer.c_nationkey == nation.n_nationkey)
    return joined.select("o_orderkey", "c_name", "n_name")


@query(
    "join_left_fill",
    "SELECT id, coalesce(cited_by, 0) AS cited_by FROM (SELECT DISTINCT id, decision_id FROM chunks) LEFT JOIN (SELECT decision_id, max(cited_by) AS cited_by FROM counts GROUP BY 1) USING (decision_id)",
)
def join_left_fill(spark: SparkSession, base: str) -> DataFrame:
    best = table(spark, base, "counts").groupBy("decision_id").agg(F.max("cited_by").alias("cited_by"))
    chunks = table(spark, base, "chunks").select("id", "decision_id").distinct()
    return chunks.join(best, "decision_id", "left").select("id", F.coalesce("cited_by", F.lit(0)).alias("cited_by"))


@query("join_semi", "SELECT decision_id, court FROM decisions WHERE decision_id IN (SELECT decision_id FROM selected_decisions)")
def join_semi(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "decisions", ("decision_id", "court")).join(table(spark, base, "selected_decisions"), "decision_id", "left_semi")


@query("join_anti", "SELECT decision_id, court FROM decisions WHERE decision_id NOT IN (SELECT decision_id FROM selected_decisions WHERE decision_id IS NOT NULL)")
def join_anti(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "decisions", ("decision_id", "court")).join(table(spark, base, "selected_decisions"), "decision_id", "left_anti").filter("decision_id IS NOT NULL")


@query(
    "edges_touching_subset",
    """WITH kept AS (SELECT DISTINCT decision_id FROM selected_decisions WHERE decision_id IS NOT NULL)
       SELECT edge_id, source, target FROM edges WHERE source IN (SELECT decision_id FROM kept) OR target IN (SELECT decision_id FROM kept)""",
)
def edges_touching_subset(spark: SparkSession, base: str) -> DataFrame:
    kept = table(spark, base, "selected_decisions").select("decision_id").filter("decision_id IS NOT NULL").distinct()
    ends = [kept.select(F.col("decision_id").alias(c), F.lit(True).alias(f"in_{c}")) for c in ("source", "target")]
    edges = table(spark, base, "edges", ("edge_id", "source", "target")).join(ends[0], "source", "left").join(ends[1], "target", "left")
    return edges.filter("in_source OR in_target").select("edge_id", "source", "target")


@query(
    "join_two_dims",
    """SELECT doc_id, coalesce(d.court, k.source_kind) AS origin FROM documents x
       LEFT JOIN (SELECT decision_id, max(court) AS court FROM decisions GROUP BY 1) d USING (decision_id)
       LEFT JOIN (SELECT kind, min(source) AS source_kind FROM documents GROUP BY 1) k USING (kind)""",
)
def join_two_dims(spark: SparkSession, base: str) -> DataFrame:
    documents = table(spark, base, "documents", ("doc_id", "decision_id", "kind", "source"))
    courts = table(spark, base, "decisions").groupBy("decision_id").agg(F.max("court").alias("court"))
    kinds = documents.groupBy("kind").agg(F.min("source").alias("source_kind"))
    joined = documents.join(courts, "decision_id", "left").join(kinds, "kind", "left")
    return joined.select("doc_id", F.coalesce("court", "source_kind").alias("origin"))


@query(
    "join_by_canonical",
    f"""WITH d AS (SELECT {sql_canonical('decision_id')} AS canon, max(docket_number) AS docket FROM decisions GROUP BY 1)
        SELECT edge_id, target, docket FROM edges JOIN d ON canon = {sql_canonical('target')}""",
)
def join_by_canonical(spark: SparkSession, base: str) -> DataFrame:
    dockets = table(spark, base, "decisions").groupBy(canonical_id(F.col("decision_id")).alias("canon")).agg(F.max("docket_number").alias("docket"))
    edges = table(spark, base, "edges", ("edge_id", "target")).withColumn("canon", canonical_id(F.col("target")))
    return edges.join(dockets, "canon").select("edge_id", "target", "docket")


@query(
    "find_articles",
    """WITH a AS (SELECT doc_id, lang, trim(regexp_replace(split_part(text, chr(10), 1), '[^0-9a-z]+', ' ', 'g')) AS number, split_part(text, chr(10), 1) AS head FROM documents WHERE kind = 'statute'),
            named AS (SELECT DISTINCT number FROM a WHERE head LIKE '% OR' AND number <> '')
       SELECT doc_id, lang, number FROM a WHERE number IN (SELECT number FROM named)""",
)
def find_articles(spark: SparkSession, base: str) -> DataFrame:
    head = F.split_part("text", F.lit("\n"), F.lit(1))
    articles = table(spark, base, "documents", ("doc_id", "lang", "text", "kind")).filter("kind = 'statute'").select(
        "doc_id", "lang", F.trim(F.regexp_replace(head, "[^0-9a-z]+", " ")).alias("number"), head.alias("head")
    )
    named = articles.filter("head LIKE '% OR' AND number <> ''").select("number").distinct()
    return articles.join(named, "number", "left_semi").select("doc_id", "lang", "number")


# --- aggregates -----------------------------------------------------------------------------------------------------


@query("group_count", "SELECT kind, lang, count(*) AS n FROM documents GROUP BY 1, 2")
def group_count(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "documents", ("kind", "lang")).groupBy("kind", "lang").agg(count())


@query("edge_dedup_max", "SELECT source, target, max(confidence) AS confidence FROM edges WHERE source <> target GROUP BY 1, 2")
def edge_dedup_max(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "edges", ("source", "target", "confidence")).filter("source <> target").groupBy("source", "target").agg(F.max("confidence").alias("confidence"))


@query("fold_mentions", "SELECT l_orderkey % 1000 AS decision, l_suppkey % 20 AS law, CAST(sum(l_quantity) AS BIGINT) AS mentions FROM lineitem GROUP BY 1, 2")
def fold_mentions(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "lineitem", ("l_orderkey", "l_suppkey", "l_quantity"))
    return rows.groupBy((F.col("l_orderkey") % 1000).alias("decision"), (F.col("l_suppkey") % 20).alias("law")).agg(F.sum("l_quantity").cast("bigint").alias("mentions"))


@query(
    "degree_counts",
    """SELECT id, CAST(sum(cited_by) AS BIGINT) AS cited_by, CAST(sum(cites) AS BIGINT) AS cites FROM (
         SELECT target AS id, count(*) AS cited_by, 0 AS cites FROM edges GROUP BY 1 UNION ALL SELECT source, 0, count(*) FROM edges GROUP BY 1)
       WHERE id IS NOT NULL GROUP BY 1""",
)
def degree_counts(spark: SparkSession, base: str) -> DataFrame:
    edges = table(spark, base, "edges", ("source", "target"))
    cited = edges.groupBy(F.col("target").alias("id")).agg(count("cited_by")).withColumn("cites", F.lit(0).cast("bigint"))
    cites = edges.groupBy(F.col("source").alias("id")).agg(count("cites")).withColumn("cited_by", F.lit(0).cast("bigint"))
    return cited.unionByName(cites).filter("id IS NOT NULL").groupBy("id").agg(F.sum("cited_by").alias("cited_by"), F.sum("cites").alias("cites"))


@query(
    "distinct_degree",
    f"""SELECT t AS decision_id, count(DISTINCT s) AS cited_by FROM (SELECT {sql_canonical('source')} AS s, {sql_canonical('target')} AS t FROM edges)
        WHERE s IS NOT NULL AND t IS NOT NULL AND s <> t GROUP BY 1""",
)
def distinct_degree(spark: SparkSession, base: str) -> DataFrame:
    ends = table(spark, base, "edges").select(canonical_id(F.col("source")).alias("s"), canonical_id(F.col("target")).alias("t"))
    pairs = ends.filter("s IS NOT NULL AND t IS NOT NULL AND s <> t").distinct()  # pairs first: no set of a hot target's sources
    return pairs.groupBy(F.col("t").alias("decision_id")).agg(count("cited_by"))


@query(
    "distribution_report",
    """WITH f AS (SELECT language, count(*) AS n FROM decisions GROUP BY 1), s AS (SELECT language, count(*) AS n FROM decisions WHERE decision_id IN (SELECT decision_id FROM selected_decisions) GROUP BY 1)
       SELECT f.language, round(f.n / (SELECT sum(n) FROM f), 4) AS full_share, round(coalesce(s.n, 0) / (SELECT sum(n) FROM s), 4) AS sample_share
       FROM f LEFT JOIN s ON f.language IS NOT DISTINCT FROM s.language""",
)
def distribution_report(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "decisions", ("decision_id", "language"))
    marked = rows.join(table(spark, base, "selected_decisions").select("decision_id", F.lit(1).alias("s")).distinct(), "decision_id", "left")
    counted = marked.groupBy("language").agg(count("f"), F.count("s").alias("s"))
    totals = counted.agg(F.sum("f").alias("ft"), F.sum("s").alias("st"))
    shares = counted.crossJoin(F.broadcast(totals))  # one row
    return shares.select("language", F.round(F.col("f") / F.col("ft"), 4).alias("full_share"), F.round(F.col("s") / F.col("st"), 4).alias("sample_share"))


@query(
    "metric_breakdowns",
    """SELECT coalesce(status, '(all)') AS status, coalesce(priority, '(all)') AS priority, count(*) AS n, round(avg(o_totalprice), 3) AS mean
       FROM (SELECT o_orderstatus AS status, o_orderpriority AS priority, o_totalprice FROM orders) GROUP BY GROUPING SETS ((), (status), (priority))""",
)
def metric_breakdowns(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), "o_totalprice")
    sets = rows.groupingSets([[], ["status"], ["priority"]], "status", "priority").agg(count(), F.round(F.avg("o_totalprice"), 3).alias("mean"))
    return sets.select(F.coalesce("status", F.lit("(all)")).alias("status"), F.coalesce("priority", F.lit("(all)")).alias("priority"), "n", "mean")


@query(
    "facet_breakdown",
    f"""WITH d AS (SELECT court, branch, {_INT_DATE} AS date FROM decisions)
        SELECT 'court' AS dimension, court AS value, count(*) AS n FROM d WHERE court IS NOT NULL GROUP BY 2
        UNION ALL SELECT 'area', branch, count(*) FROM d WHERE branch IS NOT NULL GROUP BY 2
        UNION ALL SELECT 'decade', CAST(date // 100000 * 10 AS VARCHAR), count(*) FROM d WHERE date > 0 GROUP BY 2""",
)
def facet_breakdown(spark: SparkSession, base: str) -> DataFrame:
    date = facets.int_date(F.col("decision_date"))
    decade = F.when(date > 0, F.floor(date / 100_000) * 10)
    return facets.breakdown(table(spark, base, "decisions"), {"court": F.col("court"), "area": F.col("branch"), "decade": decade})


@query("vocabulary", "SELECT court AS value, count(*) AS n FROM decisions WHERE court IS NOT NULL AND court <> '' GROUP BY 1")
def vocabulary(spark: SparkSession, base: str) -> DataFrame:
    return facets.vocabulary(table(spark, base, "decisions", ("court",)), "court")


@query("count_by", "SELECT court, count(*) AS n FROM decisions WHERE language = 'fr' AND canton IN ('VD', 'GE') GROUP BY 1")
def count_by(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "decisions").filter("language = 'fr' AND canton IN ('VD', 'GE')").groupBy("court").agg(count())


@query(
    "distinct_counts",
    "SELECT count(DISTINCT decision_id) AS decisions, count(DISTINCT court) AS courts, count(DISTINCT docket_number) AS dockets, count(*) AS n FROM decisions",
)
def distinct_counts(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "decisions", ("decision_id", "court", "docket_number"))
    return rows.agg(F.count_distinct("decision_id").alias("decisions"), F.count_distinct("court").alias("courts"), F.count_distinct("docket_number").alias("dockets"), count())


@query(
    "length_quantiles",
    "SELECT kind, quantile_disc(n_chars, 0.05) AS p5, quantile_disc(n_chars, 0.5) AS p50, quantile_disc(n_chars, 0.95) AS p95 FROM documents GROUP BY 1",
)
def length_quantiles(spark: SparkSession, base: str) -> DataFrame:
    """Values that occur (no interpolation), from a histogram of lengths: no group's lengths are gathered."""
    sizes = table(spark, base, "documents", ("kind", "n_chars")).groupBy("kind", "n_chars").agg(count())
    upto = Window.partitionBy("kind").orderBy("n_chars")
    ranked = sizes.withColumn("c", F.sum("n").over(upto)).withColumn("t", F.sum("n").over(Window.partitionBy("kind")))
    quantile = lambda q, name: F.min(F.when(F.col("c") >= F.ceil(F.col("t") * q), F.col("n_chars"))).alias(name)
    return ranked.groupBy("kind").agg(quantile(0.05, "p5"), quantile(0.5, "p50"), quantile(0.95, "p95"))


@query(
    "pivot_counts",
    """SELECT kind, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'fr') AS fr, count(*) FILTER (lang = 'it') AS it FROM documents GROUP BY 1""",
)
def pivot_counts(spark: SparkSession, base: str) -> DataFrame:
    wide = table(spark, base, "documents", ("kind", "lang")).groupBy("kind").pivot("lang", ["de", "fr", "it"]).agg(F.count(F.lit(1)))
    return wide.fillna(0, ["de", "fr", "it"])


@query(
    "first_per_group",
    "SELECT decision_id, id, size FROM (SELECT decision_id, id, length(text) AS size, row_number() OVER (PARTITION BY decision_id ORDER BY length(text) DESC, id) AS rn FROM chunks WHERE text IS NOT NULL) WHERE rn = 1",
)
def first_per_group(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "chunks").filter("text IS NOT NULL").select("decision_id", "id", F.length("text").alias("size"))
    first = Window.partitionBy("decision_id").orderBy(F.desc("size"), "id")
    return rows.withColumn("rn", F.row_number().over(first)).filter("rn = 1").drop("rn")


@query(
    "ordered_collect",
    "SELECT decision_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY chunk_index, id) AS ids FROM (SELECT DISTINCT decision_id, chunk_index, id FROM chunks WHERE decision_id IS NOT NULL) GROUP BY 1",
)
def ordered_collect(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "chunks").filter("decision_id IS NOT NULL").select("decision_id", "chunk_index", "id").distinct()
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "id"))), lambda x: x["id"].cast("string"))
    return rows.groupBy("decision_id").agg(F.array_join(ordered, ",").alias("ids"))


@query(
    "article_idf",
    "SELECT l_partkey AS article, count(DISTINCT l_orderkey) AS df, round(ln((SELECT count(DISTINCT l_orderkey) FROM lineitem) / (1 + count(DISTINCT l_orderkey))), 6) AS idf FROM lineitem GROUP BY 1",
)
def article_idf(spark: SparkSession, base: str) -> DataFrame:
    pairs = table(spark, base, "lineitem").select("l_orderkey", F.col("l_partkey").alias("article")).distinct()
    total = pairs.agg(F.count_distinct("l_orderkey").alias("n"))
    df = pairs.groupBy("article").agg(count("df")).crossJoin(F.broadcast(total))  # one row
    return df.select("article", "df", F.round(F.log(F.col("n") / (1 + F.col("df"))), 6).alias("idf"))


@query(
    "infer_area",
    """WITH m AS (SELECT l_orderkey AS decision, l_linenumber AS pos, CASE l_returnflag WHEN 'A' THEN 'civil' WHEN 'R' THEN 'criminal' END AS area FROM lineitem),
            k AS (SELECT decision, area, count(*) AS n, min(pos) AS first_pos, sum(count(*)) OVER (PARTITION BY decision) AS mapped FROM m WHERE area IS NOT NULL GROUP BY 1, 2)
       SELECT decision, area FROM (SELECT *, row_number() OVER (PARTITION BY decision ORDER BY n DESC, first_pos, area) AS rn FROM k) WHERE rn = 1 AND n >= 2 AND n * 2 >= mapped""",
)
def infer_area(spark: SparkSession, base: str) -> DataFrame:
    area = F.nullif(facets.mapped(F.col("l_returnflag"), {"A": "civil", "R": "criminal"}), F.lit(""))
    rows = table(spark, base, "lineitem").select(F.col("l_orderkey").alias("decision"), F.col("l_linenumber").alias("pos"), area.alias("area")).filter("area IS NOT NULL")
    votes = rows.groupBy("decision", "area").agg(count(), F.min("pos").alias("first_pos"))
    best = votes.groupBy("decision").agg(F.sum("n").alias("mapped"), F.min_by(F.struct("area", "n"), F.struct(-F.col("n"), "first_pos", "area")).alias("b"))
    return best.filter("b.n >= 2 AND b.n * 2 >= mapped").select("decision", F.col("b.area").alias("area"))


@query(
    "corpus_stats",
    """SELECT (SELECT count(*) FROM decisions) AS decisions, (SELECT count(*) FROM chunks) AS chunks, (SELECT count(*) FROM passage_vectors WHERE embedding IS NOT NULL) AS vectors,
              (SELECT count(*) FROM edges) AS edges, (SELECT count(DISTINCT lang) FROM documents) AS languages""",
)
def corpus_stats(spark: SparkSession, base: str) -> DataFrame:
    sizes = {
        "decisions": table(spark, base, "decisions").agg(count()),
        "chunks": table(spark, base, "chunks").agg(count()),
        "vectors": table(spark, base, "passage_vectors").filter("embedding IS NOT NULL").agg(count()),
        "edges": table(spark, base, "edges").agg(count()),
        "languages": table(spark, base, "documents").agg(F.count_distinct("lang").alias("n")),
    }
    long = None
    for name, one in sizes.items():
        row = one.select(F.lit(name).alias("k"), "n")
        long = row if long is None else long.unionByName(row)
    return long.groupBy().pivot("k", list(sizes)).agg(F.max("n"))


@query(
    "report_columns",
    """SELECT o_orderstatus AS suite, round(avg(o_totalprice), 4) AS mean, list_sort(list(o_totalprice))[count(*) // 2 + 1] AS median_upper,
              round(count(*) FILTER (o_totalprice > 100000) * 100.0 / count(*), 4) AS pct_high FROM orders GROUP BY 1""",
)
def report_columns(spark: SparkSession, base: str) -> DataFrame:
    """Mean, the upper of the two middle values, and a percentage; the middle is found by rank, not by gathering."""
    rows = table(spark, base, "orders", ("o_orderstatus", "o_totalprice")).withColumnRenamed("o_orderstatus", "suite")
    values = rows.groupBy("suite", "o_totalprice").agg(count())
    ranked = values.withColumn("c", F.sum("n").over(Window.partitionBy("suite").orderBy("o_totalprice"))).withColumn("t", F.sum("n").over(Window.partitionBy("suite")))
    middle = ranked.filter(F.col("c") > F.floor(F.col("t") / 2)).groupBy("suite").agg(F.min("o_totalprice").alias("median_upper"))
    means = rows.groupBy("suite").agg(F.round(F.avg("o_totalprice"), 4).alias("mean"), F.round(F.count_if(F.col("o_totalprice") > 100000) * 100.0 / F.count(F.lit(1)), 4).alias("pct_high"))
    return means.join(middle, "suite")


@query("reason_histogram", "SELECT reason, count(*) AS n FROM (SELECT unnest(erwaegungen) AS reason FROM chunks) GROUP BY 1")
def reason_histogram(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "chunks").select(F.explode("erwaegungen").alias("reason")).groupBy("reason").agg(count())


@query(
    "best_per_identity",
    f"""SELECT canon, cited_by, decision_id FROM (SELECT *, row_number() OVER (PARTITION BY canon ORDER BY cited_by DESC, decision_id) AS rn
          FROM (SELECT DISTINCT {sql_canonical('decision_id')} AS canon, cited_by, decision_id FROM counts WHERE cited_by IS NOT NULL)) WHERE rn = 1""",
)
def best_per_identity(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "counts").filter("cited_by IS NOT NULL").select(canonical_id(F.col("decision_id")).alias("canon"), "cited_by", "decision_id").distinct()
    best = Window.partitionBy("canon").orderBy(F.desc("cited_by"), "decision_id")
    return rows.withColumn("rn", F.row_number().over(best)).filter("rn = 1").drop("rn")


# --- windows --------------------------------------------------------------------------------------------------------


@query("passages_per_doc", "SELECT id, decision_id, count(*) OVER (PARTITION BY decision_id) AS passages FROM chunks")
def passages_per_doc(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "chunks").select("id", "decision_id", F.count(F.lit(1)).over(Window.partitionBy("decision_id")).alias("passages"))


@query(
    "dedup_two_stage",
    """WITH a AS (SELECT * FROM (SELECT doc_id, coalesce(decision_id, 'doc' || doc_id) AS identity, md5(text) AS content, n_chars, court,
                    row_number() OVER (PARTITION BY coalesce(decision_id, 'doc' || doc_id) ORDER BY n_chars DESC NULLS LAST, doc_id) AS rn FROM documents) WHERE rn = 1)
       SELECT doc_id, identity FROM a WHERE content IS NULL OR coalesce(court, '') = 'bge'
       UNION ALL SELECT doc_id, identity FROM (SELECT *, row_number() OVER (PARTITION BY content ORDER BY n_chars DESC NULLS LAST, doc_id) AS r2
         FROM a WHERE content IS NOT NULL AND coalesce(court, '') <> 'bge') WHERE r2 = 1""",
)
def dedup_two_stage(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "documents").select(
        "doc_id", F.coalesce("decision_id", F.concat(F.lit("doc"), F.col("doc_id"))).alias("identity"), F.md5("text").alias("content"), "n_chars", "court"
    )
    exempt = F.coalesce("court", F.lit("")) == "bge"
    return sampling.dedup_two_stage(rows, "identity", "content", "n_chars", "doc_id", exempt).select("doc_id", "identity")


@query(
    "diverse_top_k",
    """WITH a AS (SELECT *, row_number() OVER (PARTITION BY section, decision_id ORDER BY size DESC, id) AS own FROM (SELECT DISTINCT id, decision_id, section, length(text) AS size FROM chunks WHERE text IS NOT NULL))
       SELECT section, decision_id, id, size FROM (SELECT *, row_number() OVER (PARTITION BY section ORDER BY size DESC, id) AS rn FROM a WHERE own <= 2) WHERE rn <= 20""",
)
def diverse_top_k(spark: SparkSession, base: str) -> DataFrame:
    from gavelgrid.operators.ranking import diverse_top_k as operator

    rows = table(spark, base, "chunks").filter("text IS NOT NULL").select("id", "decision_id", "section", F.length("text").alias("size")).distinct()
    return operator(rows, ["section"], "decision_id", F.desc("size"), "id", per_document=2, k=20).select("section", "decision_id", "id", "size")


@query(
    "running_label",
    """SELECT id, last_value(label IGNORE NULLS) OVER (PARTITION BY decision_id ORDER BY chunk_index, id ROWS UNBOUNDED PRECEDING) AS running
       FROM (SELECT DISTINCT id, decision_id, chunk_index, erwaegungen[len(erwaegungen)] AS label FROM chunks)""",
)
def running_label(spark: SparkSession, base: str) -> DataFrame:
    label = F.when(F.size("erwaegungen") > 0, F.element_at("erwaegungen", -1))
    rows = table(spark, base, "chunks").select("id", "decision_id", "chunk_index", label.alias("label")).distinct()
    upto = Window.partitionBy("decision_id").orderBy("chunk_index", "id").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("id", F.last("label", ignorenulls=True).over(upto).alias("running"))


@query("score_gap", "SELECT o_orderkey, round(o_totalprice - max(o_totalprice) OVER (PARTITION BY o_custkey), 4) AS gap FROM orders")
def score_gap(spark: SparkSession, base: str) -> DataFrame:
    gap = F.col("o_totalprice") - F.max("o_totalprice").over(Window.partitionBy("o_custkey"))
    return table(spark, base, "orders").select("o_orderkey", F.round(gap, 4).alias("gap"))


@query(
    "softmax_per_query",
    """SELECT o_orderkey, round(e / sum(e) OVER (PARTITION BY o_custkey), 6) AS share FROM (
         SELECT o_orderkey, o_custkey, exp((o_totalprice - max(o_totalprice) OVER (PARTITION BY o_custkey)) / 100000) AS e FROM orders)""",
)
def softmax_per_query(spark: SparkSession, base: str) -> DataFrame:
    own = Window.partitionBy("o_custkey")
    raised = F.exp((F.col("o_totalprice") - F.max("o_totalprice").over(own)) / 100000)
    return table(spark, base, "orders").withColumn("e", raised).select("o_orderkey", F.round(F.col("e") / F.sum("e").over(own), 6).alias("share"))


@query("message_seq", "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events")
def message_seq(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "events").select("event_id", "user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("bigint").alias("seq"))


# --- sorts, limits, samples -----------------------------------------------------------------------------------------


@query("sort_mixed", "SELECT doc_id, kind, n_chars FROM documents ORDER BY kind ASC NULLS LAST, n_chars DESC NULLS LAST, doc_id LIMIT 50")
def sort_mixed(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "documents", ("doc_id", "kind", "n_chars"))
    return rows.orderBy(F.asc_nulls_last("kind"), F.desc_nulls_last("n_chars"), "doc_id").limit(50)


@query("latest_citing", "SELECT edge_id, source, target, recorded_at FROM edges WHERE target = 'bge_BGE_205_VI_378' ORDER BY recorded_at DESC NULLS LAST, edge_id LIMIT 30")
def latest_citing(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "edges", ("edge_id", "source", "target", "recorded_at")).filter("target = 'bge_BGE_205_VI_378'")
    return rows.orderBy(F.desc_nulls_last("recorded_at"), "edge_id").limit(30)


@query(
    "newest_oldest",
    f"""WITH d AS (SELECT decision_id, max({_INT_DATE}) AS date FROM decisions GROUP BY 1)
        SELECT * FROM (SELECT 'newest' AS side, decision_id, date FROM d ORDER BY date DESC, decision_id DESC LIMIT 20)
        UNION ALL SELECT * FROM (SELECT 'oldest' AS side, decision_id, date FROM d ORDER BY date, decision_id LIMIT 20)""",
)
def newest_oldest(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "decisions").groupBy("decision_id").agg(F.max(facets.int_date(F.col("decision_date"))).alias("date"))
    newest = rows.orderBy(F.desc("date"), F.desc("decision_id")).limit(20).select(F.lit("newest").alias("side"), "*")
    return newest.unionByName(rows.orderBy("date", "decision_id").limit(20).select(F.lit("oldest").alias("side"), "*"))


@query("browse", "SELECT decision_id, decision_date, docket_number FROM (SELECT DISTINCT decision_id, decision_date, docket_number FROM decisions) ORDER BY decision_date DESC NULLS LAST, decision_id, docket_number NULLS LAST LIMIT 25")
def browse(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "decisions", ("decision_id", "decision_date", "docket_number")).distinct()
    return rows.orderBy(F.desc_nulls_last("decision_date"), "decision_id", F.asc_nulls_last("docket_number")).limit(25)


_QUOTA = """
s AS (SELECT o_orderstatus, o_orderpriority, count(*) AS c FROM orders GROUP BY 1, 2),
n AS (SELECT round_even((SELECT count(*) FROM orders) * 0.1, 0) AS n, sum(c) AS total, sum(least(c, 3)) AS floors FROM s),
q AS (SELECT s.*, CAST(least(greatest(least(c, 3), round(c / total * greatest(n - floors, 0))), c) AS BIGINT) AS quota FROM s, n)
"""


@query("allocate_quota", f"WITH {_QUOTA} SELECT o_orderstatus, o_orderpriority, c, quota FROM q")
def allocate_quota(spark: SparkSession, base: str) -> DataFrame:
    orders = table(spark, base, "orders", ("o_orderstatus", "o_orderpriority"))
    return sampling.allocate_quota(orders.groupBy("o_orderstatus", "o_orderpriority").agg(count("c")), "c", round(orders.count() * 0.1), 3)


@query(
    "stratified_sample",
    f"""WITH {_QUOTA}, r AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY md5(o_orderkey || ':{SEED}'), o_orderkey) AS rn FROM orders)
        SELECT o_orderkey, o_orderstatus, o_orderpriority FROM r JOIN q USING (o_orderstatus, o_orderpriority) WHERE rn <= quota
        UNION SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_totalprice > 450000""",
)
def stratified_sample(spark: SparkSession, base: str) -> DataFrame:
    orders = table(spark, base, "orders", ("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice"))
    sample = sampling.stratified_sample(orders, ["o_orderstatus", "o_orderpriority"], "o_orderkey", 0.1, 3, SEED, always=F.col("o_totalprice") > 450000)
    return sample.select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query("cap_per_group", f"SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id || ':{SEED}'), doc_id) AS rn FROM documents WHERE source IS NOT NULL) WHERE rn <= 15")
def cap_per_group(spark: SparkSession, base: str) -> DataFrame:
    return sampling.cap_per_group(table(spark, base, "documents", ("doc_id", "source")).filter("source IS NOT NULL"), ["source"], "doc_id", 15, SEED)


@query(
    "group_disjoint_split",
    f"""WITH full_ AS (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) = (SELECT count(DISTINCT o_orderstatus) FROM orders)),
            held AS (SELECT o_custkey FROM full_ ORDER BY md5(o_custkey || ':{SEED}'), o_custkey LIMIT 50)
       SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT o_custkey FROM held) THEN 'test' ELSE 'train' END AS split FROM orders""",
)
def group_disjoint_split(spark: SparkSession, base: str) -> DataFrame:
    orders = table(spark, base, "orders", ("o_orderkey", "o_custkey", "o_orderstatus"))
    return sampling.group_disjoint_split(orders, "o_custkey", "o_orderstatus", 50, SEED).select("o_orderkey", "split")


@query("quota_sample")
def quota_sample(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "documents", ("doc_id", "kind", "lang")).fillna("unknown", ["kind", "lang"])
    return sampling.quota_sample(rows, ["kind", "lang"], "doc_id", 200, SEED)


@query(
    "component_groups",
    """WITH RECURSIVE e AS (SELECT doc_id AS u, 'd' || decision_id AS k FROM documents WHERE decision_id IS NOT NULL),
       pairs AS (SELECT DISTINCT a.u AS u, b.u AS v FROM e a JOIN e b USING (k)),
       reach(u, v) AS (SELECT u, v FROM pairs UNION SELECT r.u, p.v FROM reach r JOIN pairs p ON r.v = p.u)
       SELECT u AS node, min(v) AS component FROM reach GROUP BY 1""",
)
def component_groups(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "documents", ("doc_id", "decision_id")).filter("decision_id IS NOT NULL")
    first = rows.groupBy("decision_id").agg(F.min("doc_id").alias("v"))  # a star per shared key, not all its pairs
    return sampling.components(rows.join(first, "decision_id").select(F.col("doc_id").alias("u"), "v"), "u", "v")


# --- sets -----------------------------------------------------------------------------------------------------------


@query("union_all", "SELECT source AS id, 'source' AS side FROM edges WHERE source IS NOT NULL UNION ALL SELECT target, 'target' FROM edges WHERE target IS NOT NULL")
def union_all(spark: SparkSession, base: str) -> DataFrame:
    edges = table(spark, base, "edges", ("source", "target"))
    ends = edges.select(F.col("source").alias("id"), F.lit("source").alias("side")).unionByName(edges.select(F.col("target").alias("id"), F.lit("target").alias("side")))
    return ends.filter("id IS NOT NULL")  # a NULL end is no reference


@query("union_distinct", "SELECT decision_id FROM decisions UNION SELECT decision_id FROM counts")
def union_distinct(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "decisions").select("decision_id").union(table(spark, base, "counts").select("decision_id")).distinct()


@query("select_distinct", "SELECT DISTINCT court FROM decisions")
def select_distinct(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "decisions").select("court").distinct()


@query(
    "set_ops",
    """WITH a AS (SELECT DISTINCT decision_id FROM selected_decisions), b AS (SELECT DISTINCT decision_id FROM removed_decisions)
       SELECT 'both' AS kind, decision_id FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'only_selected', decision_id FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""",
)
def set_ops(spark: SparkSession, base: str) -> DataFrame:
    a, b = table(spark, base, "selected_decisions").select("decision_id"), table(spark, base, "removed_decisions").select("decision_id")
    both = a.intersect(b).withColumn("kind", F.lit("both"))
    return both.unionByName(a.subtract(b).withColumn("kind", F.lit("only_selected")))


@query(
    "candidate_pool",
    """WITH p AS (SELECT id, min(pos) AS pos FROM (
          SELECT decision_id AS id, row_number() OVER (ORDER BY cited_by DESC NULLS LAST, decision_id) AS pos FROM (SELECT decision_id, max(cited_by) AS cited_by FROM counts GROUP BY 1)
          QUALIFY pos <= 100
          UNION ALL SELECT decision_id, 100 + row_number() OVER (ORDER BY cites DESC NULLS LAST, decision_id) AS pos FROM (SELECT decision_id, max(cites) AS cites FROM counts GROUP BY 1) QUALIFY pos <= 130) GROUP BY 1)
       SELECT id, pos FROM p""",
)
def candidate_pool(spark: SparkSession, base: str) -> DataFrame:
    from gavelgrid.operators.ranking import ordered_union

    rows = table(spark, base, "counts").groupBy("decision_id").agg(F.max("cited_by").alias("cited_by"), F.max("cites").alias("cites")).withColumnRenamed("decision_id", "id")
    top = lambda by, k: rows.orderBy(F.desc_nulls_last(by), "id").limit(k).select("id", F.row_number().over(Window.orderBy(F.desc_nulls_last(by), "id")).alias("pos"))
    return ordered_union([top("cited_by", 100), top("cites", 30)], [0, 100])


@query(
    "merge_pools",
    """SELECT id, arg_max(payload, src) AS payload, min(pos) AS pos FROM (
         SELECT decision_id AS id, 'edges' AS payload, 1 AS src, min(edge_id) AS pos FROM (SELECT target AS decision_id, edge_id FROM edges) GROUP BY 1
         UNION ALL SELECT decision_id, 'counts', 2, max(cited_by) FROM counts GROUP BY 1) WHERE id IS NOT NULL GROUP BY 1""",
)
def merge_pools(spark: SparkSession, base: str) -> DataFrame:
    edges = table(spark, base, "edges").groupBy(F.col("target").alias("id")).agg(F.min("edge_id").alias("pos")).select("id", F.lit("edges").alias("payload"), F.lit(1).alias("src"), "pos")
    counts = table(spark, base, "counts").groupBy(F.col("decision_id").alias("id")).agg(F.max("cited_by").alias("pos")).select("id", F.lit("counts").alias("payload"), F.lit(2).alias("src"), "pos")
    return edges.unionByName(counts).filter("id IS NOT NULL").groupBy("id").agg(F.max_by("payload", "src").alias("payload"), F.min("pos").alias("pos"))
