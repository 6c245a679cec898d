"""Queries of the text operators: spans, chunks, tokens, keyword search, references, languages, overlaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gavelgrid.functions import identity, references, text as tx
from gavelgrid.operators import chunking, keyword, language, overlap
from gavelgrid.plans.orphans import sql_canonical
from gavelgrid.plans.registry import Registry
from gavelgrid.sources.tables import table

REGISTRY = Registry()
query = REGISTRY.query
WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]{{2,}}')"


def count(name: str = "n"):
    return F.count(F.lit(1)).alias(name)


# --- spans and chunks -----------------------------------------------------------------------------------------------


@query(
    "line_spans",
    r"""WITH l AS (SELECT decision_id, h, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM (
            SELECT decision_id, md5(full_text) AS h, regexp_extract_all(full_text, '[^\n]*\n|[^\n]+$') AS lines FROM decisions WHERE full_text <> '' GROUP BY ALL))
        SELECT decision_id, h, CAST(sum(length(line)) OVER (PARTITION BY decision_id, h ORDER BY i) - length(line) AS INT) AS char_start,
               CAST(sum(length(line)) OVER (PARTITION BY decision_id, h ORDER BY i) AS INT) AS char_end FROM l""",
)
def line_spans(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "decisions").filter("full_text <> ''").select("decision_id", F.md5("full_text").alias("h"), "full_text").distinct()
    spans = rows.select("decision_id", "h", F.explode(chunking.line_span_column(F.col("full_text"))).alias("s"))
    return spans.select("decision_id", "h", F.col("s.start").alias("char_start"), F.col("s.end").alias("char_end"))


@query("split_text")
def split_text(spark: SparkSession, base: str) -> DataFrame:
    rows = chunking.chunk_documents(table(spark, base, "documents", ("doc_id", "text")), "doc_id", "text")
    return rows.select("doc_id", "chunk_index", "char_start", "char_end")


@query("chunk_documents")
def chunk_documents(spark: SparkSession, base: str) -> DataFrame:
    """Judgments with their headnotes; headings of the judgment serve as anchors."""
    rows = table(spark, base, "decisions", ("decision_id", "full_text", "regeste")).filter("decision_id IS NOT NULL").distinct()
    heads = F.transform(
        F.regexp_extract_all("full_text", F.lit(r"\n(?:Erwägungen|Considérant en droit|Considerando in diritto|Consideraziuns|Considerations):\n([^\n]{30,200})"), F.lit(1)),
        lambda s: F.struct(F.lit("E.").alias("label"), s.alias("text")),
    )
    cut = chunking.chunk_documents(rows.withColumn("anchors", heads), "decision_id", "full_text", "regeste", "anchors")
    return cut.select("decision_id", "chunk_id", "section", "char_start", "char_end", F.array_join("labels", ",").alias("labels"), F.md5("text").alias("text_md5"))


@query(
    "span_context",
    """SELECT id, CASE WHEN lo > 0 THEN '…' ELSE '' END || substr(full_text, lo + 1, hi - lo) || CASE WHEN hi < length(full_text) THEN '…' ELSE '' END AS context
       FROM (SELECT c.id, d.full_text, greatest(c.char_start - 300, 0) AS lo, least(c.char_end + 300, length(d.full_text)) AS hi
             FROM (SELECT DISTINCT id, decision_id, char_start, char_end FROM chunks) c
             JOIN (SELECT decision_id, max(full_text) AS full_text FROM decisions GROUP BY 1) d USING (decision_id) WHERE c.char_start IS NOT NULL AND d.full_text IS NOT NULL)""",
)
def span_context(spark: SparkSession, base: str) -> DataFrame:
    chunks = table(spark, base, "chunks").select("id", "decision_id", "char_start", "char_end").distinct()
    texts = table(spark, base, "decisions").groupBy("decision_id").agg(F.max("full_text").alias("full_text"))
    joined = chunks.filter("char_start IS NOT NULL").join(texts, "decision_id").filter("full_text IS NOT NULL")
    return joined.select("id", tx.context(F.col("full_text"), F.col("char_start"), F.col("char_end")).alias("context"))


@query(
    "page_at_offset",
    """SELECT c.id, count(*) AS page FROM (SELECT DISTINCT id, decision_id, char_start FROM chunks WHERE char_start IS NOT NULL) c
       JOIN (SELECT decision_id, max(length(full_text)) AS size FROM decisions GROUP BY 1) d USING (decision_id), LATERAL (SELECT unnest(range(0, d.size + 1, 2000)) AS marker)
       WHERE marker <= c.char_start GROUP BY 1, c.char_start, c.decision_id""",
)
def page_at_offset(spark: SparkSession, base: str) -> DataFrame:
    """Page markers every 2,000 characters; a passage is on the page of the last marker at or before its start."""
    chunks = table(spark, base, "chunks").filter("char_start IS NOT NULL").select("id", "decision_id", "char_start").distinct()
    sizes = table(spark, base, "decisions").groupBy("decision_id").agg(F.max(F.length("full_text")).alias("size")).filter("size IS NOT NULL")
    markers = F.sequence(F.lit(0), F.col("size"), F.lit(2000))
    return chunks.join(sizes, "decision_id").select("id", F.size(F.filter(markers, lambda m: m <= F.col("char_start"))).cast("bigint").alias("page")).filter("page > 0")


@query("read_window", "SELECT doc_id, substr(text, least(greatest(n_chars - 500, 0), length(text)) + 1, 400) AS page FROM documents WHERE text IS NOT NULL")
def read_window(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "documents", ("doc_id", "text", "n_chars")).filter("text IS NOT NULL")
    return rows.select("doc_id", tx.read_window(F.col("text"), (F.col("n_chars") - 500).cast("int"), 400).alias("page"))


@query(
    "paragraph_search",
    r"""WITH p AS (SELECT decision_id, h, unnest(parts) AS part, generate_subscripts(parts, 1) - 1 AS i FROM (
                SELECT decision_id, md5(full_text) AS h, string_split(full_text, chr(10)) AS parts FROM decisions WHERE full_text IS NOT NULL GROUP BY ALL)),
            s AS (SELECT *, CAST(contains(lower(part), 'vertrag') AS INT) + CAST(contains(lower(part), 'frist') AS INT) + CAST(contains(lower(part), 'miete') AS INT) AS hits FROM p)
       SELECT decision_id, h, i, hits FROM (SELECT *, max(hits) OVER (PARTITION BY decision_id, h) AS best, row_number() OVER (PARTITION BY decision_id, h ORDER BY hits DESC, i) AS rn FROM s) WHERE hits = best AND hits > 0 AND rn <= 8""",
)
def paragraph_search(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "decisions").filter("full_text IS NOT NULL").select("decision_id", "full_text").distinct()
    parts = rows.select("decision_id", F.md5("full_text").alias("h"), F.posexplode(F.split("full_text", "\n", -1)).alias("i", "part"))
    terms = ("vertrag", "frist", "miete")
    hits = sum((F.contains(F.lower("part"), F.lit(t)).cast("int") for t in terms), F.lit(0))
    own = Window.partitionBy("decision_id", "h")
    ranked = parts.select("decision_id", "h", "i", hits.alias("hits")).filter("hits > 0").withColumn("best", F.max("hits").over(own)).withColumn("rn", F.row_number().over(own.orderBy(F.desc("hits"), "i")))
    return ranked.filter("hits = best AND rn <= 8").select("decision_id", "h", "i", "hits")


# --- tokens and keyword search --------------------------------------------------------------------------------------


@query("tokenize_counts", f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({WORDS.format('text')}) AS term FROM documents) WHERE NOT list_contains({sorted(set(tx.STOPWORDS))!r}, term) GROUP BY 1, 2")
def tokenize_counts(spark: SparkSession, base: str) -> DataFrame:
    return keyword.term_counts(table(spark, base, "documents", ("doc_id", "text")), "doc_id", "text", tx.content_words)


_BM25 = f"""
p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({WORDS.format('text')}) AS term FROM documents) GROUP BY 1, 2),
l AS (SELECT doc_id, sum(tf) AS dl FROM p GROUP BY 1), s AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM l), f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
w AS (SELECT doc_id, term, ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS w FROM p JOIN l USING (doc_id) JOIN f USING (term), s)
"""


@query("bm25_postings", f"WITH {_BM25} SELECT doc_id, term, round(w, 6) AS w FROM w")
def bm25_postings(spark: SparkSession, base: str) -> DataFrame:
    postings = keyword.build_index(table(spark, base, "documents", ("doc_id", "text")), "doc_id", "text")
    return keyword.bm25_postings(postings, "doc_id", *keyword.corpus_size(postings, "doc_id")).withColumn("w", F.round("w", 6))


@query(
    "bm25_search",
    f"""WITH {_BM25}, q AS (SELECT DISTINCT item_id, unnest({WORDS.format('question')}) AS term FROM eval_items WHERE item_id % 20 = 0),
        r AS (SELECT item_id, doc_id, sum(w) AS score FROM q JOIN w USING (term) GROUP BY 1, 2)
        SELECT item_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM r) WHERE rank <= 10""",
)
def bm25_search(spark: SparkSession, base: str) -> DataFrame:
    questions = table(spark, base, "eval_items", ("item_id", "question")).filter("item_id % 20 = 0")
    found = keyword.bm25_search(table(spark, base, "documents", ("doc_id", "text")), "doc_id", "text", questions, "item_id", "question", 10)
    return found.withColumn("score", F.round("score", 6))


@query(
    "keyword_and_search",
    r"""SELECT id FROM chunks WHERE contains(' ' || array_to_string(regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}_]+'), ' ') || ' ', ' baubewilligung in ')
          AND contains(' ' || array_to_string(regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}_]+'), ' ') || ' ', ' beschwerdefuhrerin ')""",
)
def keyword_and_search(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "chunks").filter(keyword.match_condition(F.col("text"), '"Baubewilligung in" Beschwerdeführerin ??')).select("id")


@query(
    "broad_terms",
    r"""WITH x AS (SELECT item_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM (SELECT item_id, regexp_extract_all(question, '[\p{L}\p{N}]{2,}') AS ws FROM eval_items)),
            t AS (SELECT item_id, CASE WHEN x IN ('OR', 'CO', 'CP') THEN x ELSE lower(x) END AS t, min(i) AS i FROM x GROUP BY 1, 2),
            k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY i) AS rn FROM t WHERE NOT list_contains({stop}, t))
       SELECT item_id, string_agg(t, ' ' ORDER BY i) AS terms FROM k WHERE rn <= 12 GROUP BY 1""".replace("{stop}", repr(sorted({*tx.STOPWORDS, "entscheid", "urteil", "decision", "arrêt", "sentenza"}))),
)
def broad_terms(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "eval_items").select("item_id", F.array_join(keyword.broad_terms(F.col("question")), " ").alias("terms"))


@query(
    "broad_search",
    f"""WITH {_BM25.replace('documents', "chunk_texts").replace('doc_id', 'id')}, q(query_id, term) AS (VALUES (1, 'baubewilligung'), (1, 'kaution'), (2, 'vertrag'), (2, 'frist'), (2, 'gutachten')),
        n AS (SELECT query_id, count(*) AS n FROM q GROUP BY 1),
        r AS (SELECT query_id, id, sum(w) AS score, count(DISTINCT term) AS hits FROM q JOIN w USING (term) GROUP BY 1, 2),
        t AS (SELECT *, CASE WHEN hits = n.n THEN 0 ELSE 1 END AS tier FROM r JOIN n USING (query_id))
        SELECT query_id, id, tier, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, round(score, 9) DESC, id) AS rank FROM t) WHERE rank <= 25""".replace(
        "WITH", "WITH chunk_texts AS (SELECT id, max(text) AS text FROM chunks GROUP BY 1),", 1
    ),
)
def broad_search(spark: SparkSession, base: str) -> DataFrame:
    queries = spark.createDataFrame([(1, "Baubewilligung und Kaution"), (2, "Vertrag, Frist: Gutachten?")], "query_id int, query string")
    chunks = table(spark, base, "chunks").groupBy("id").agg(F.max("text").alias("text"))
    return keyword.broad_search(chunks, "id", "text", queries, "query_id", "query", 25).withColumn("score", F.round("score", 6))


@query(
    "keyword_search",
    r"""WITH c AS (SELECT id, decision_id, max(text) AS text FROM chunks GROUP BY 1, 2), h AS (SELECT id, decision_id, length(text) AS size FROM c
          WHERE contains(' ' || array_to_string(regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}_]+'), ' ') || ' ', ' krankgeschrieben war ')
            AND decision_id IN (SELECT decision_id FROM decisions WHERE court = 'bger')),
          o AS (SELECT *, row_number() OVER (PARTITION BY decision_id ORDER BY size, id) AS own FROM h)
        SELECT id, decision_id, size FROM (SELECT *, row_number() OVER (ORDER BY size, id) AS rn FROM o WHERE own <= 2) WHERE rn <= 40""",
)
def keyword_search(spark: SparkSession, base: str) -> DataFrame:
    """Facet filter first, so nothing is fetched in excess; the shortest passages first; two per decision."""
    kept = table(spark, base, "decisions").filter("court = 'bger'").select("decision_id")
    chunks = table(spark, base, "chunks").groupBy("id", "decision_id").agg(F.max("text").alias("text")).join(kept, "decision_id", "left_semi")
    hits = chunks.filter(keyword.match_condition(F.col("text"), '"krankgeschrieben war"')).select("id", "decision_id", F.length("text").alias("size"))
    own = Window.partitionBy("decision_id").orderBy("size", "id")
    return hits.withColumn("own", F.row_number().over(own)).filter("own <= 2").drop("own").orderBy("size", "id").limit(40)


@query(
    "keyword_in_collection",
    f"""WITH {_BM25.replace('FROM documents)', "FROM documents WHERE source LIKE 'casefile%')")}, q AS (SELECT DISTINCT unnest(['baubewilligung', 'kaution', 'rechnung']) AS term),
        r AS (SELECT doc_id, sum(w) AS score FROM q JOIN w USING (term) GROUP BY 1)
        SELECT source, doc_id, round(score, 6) AS score FROM (SELECT source, doc_id, score, row_number() OVER (PARTITION BY source ORDER BY round(score, 9) DESC, doc_id) AS rn FROM r JOIN documents USING (doc_id)) WHERE rn <= 30""",
)
def keyword_in_collection(spark: SparkSession, base: str) -> DataFrame:
    files = table(spark, base, "documents", ("doc_id", "source", "text")).filter("source LIKE 'casefile%'")
    queries = spark.createDataFrame([(1, "Baubewilligung, Kaution, Rechnung")], "q int, t string")
    hits = keyword.bm25_search(files, "doc_id", "text", queries, "q", "t", None)
    own = Window.partitionBy("source").orderBy(F.desc(F.round("score", 9)), "doc_id")
    ranked = hits.join(files.select("doc_id", "source"), "doc_id").withColumn("rn", F.row_number().over(own)).filter("rn <= 30")
    return ranked.select("source", "doc_id", F.round("score", 6).alias("score"))


@query("fold_accents", "SELECT DISTINCT question AS original, strip_accents(question) AS folded FROM eval_items")
def fold_accents(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "eval_items").select(F.col("question").alias("original"), tx.fold_accents(F.col("question")).alias("folded")).distinct()


@query(
    "postings_delta",
    "WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text || ' nachtrag nachtrag' ELSE text END AS text FROM documents WHERE doc_id % 7 <> 0) "
    + f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({WORDS.format('text')}) AS term FROM d) GROUP BY 1, 2",
)
def postings_delta(spark: SparkSession, base: str) -> DataFrame:
    """Postings after every third document got longer and every seventh was removed, computed from the old postings."""
    documents = table(spark, base, "documents", ("doc_id", "text"))
    changed = documents.filter("doc_id % 3 = 0 AND doc_id % 7 <> 0").withColumn("text", F.concat("text", F.lit(" nachtrag nachtrag")))
    return keyword.postings_delta(keyword.term_counts(documents, "doc_id", "text"), changed, documents.filter("doc_id % 7 = 0"), "doc_id", "text")


# --- references, patterns, tidying ----------------------------------------------------------------------------------


@query("canonical_id", f"SELECT DISTINCT target AS id, {sql_canonical('target')} AS canonical FROM edges WHERE target IS NOT NULL")
def canonical_ids(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "edges").select(F.col("target").alias("id"), identity.canonical_id(F.col("target")).alias("canonical")).filter("id IS NOT NULL").distinct()


_HEAD = "trim(split_part(trim(decision_id), '#', 1))"


@query(
    "docket_key",
    f"""SELECT DISTINCT decision_id, CASE WHEN starts_with(c, 'bge_BGE_') THEN c ELSE regexp_replace(lower(regexp_replace(h, '^(?:bger|bvger|bstger)_', '', 'i')), '[^a-z0-9]', '', 'g') END AS docket_key
        FROM (SELECT decision_id, {_HEAD} AS h, {sql_canonical(_HEAD)} AS c FROM decisions)""",
)
def docket_key(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "decisions").select("decision_id", identity.docket_key(F.col("decision_id")).alias("docket_key")).distinct()


_HEADINGS = (
    (1, "Urteilskopf\n120 II 5\n4C.123/2001 vom 3. Mai\nRegeste\nsiehe 5A.1/2000"),
    (2, "BGE 120 II 5\n6B_12/2010, 6B_12/2010\n\n1C.9/1999 im Text"),
    (3, "kein Aktenzeichen"),
    (4, None),
)


@query("own_dockets", "SELECT * FROM (VALUES (1, '4C.123/2001'), (2, '6B_12/2010'), (3, ''), (4, '')) t(id, dockets)")
def own_dockets(spark: SparkSession, base: str) -> DataFrame:
    rows = spark.createDataFrame(_HEADINGS, "id int, text string")
    return rows.select("id", F.array_join(identity.own_dockets(F.col("text")), ",").alias("dockets"))


@query(
    "exact_reference",
    r"""SELECT DISTINCT source AS id, regexp_matches(trim(source), '^(?:(?:bge[_ ]*)?(?:BGE|ATF|DTF)?[_ ]*[0-9]{1,3}[_ ]+[IVX]+[ab]?[_ ]+[0-9]+|(?:BVGE|ATAF|DTAF)\s+[0-9]{4}/[0-9]+|[0-9]{1,2}[A-Z][_. ][0-9]+/[0-9]{4}|(?:bge|bger|bvger|bstger)_.+)$', 'i') AS bare FROM edges WHERE source IS NOT NULL""",
)
def exact_reference(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "edges").select(F.col("source").alias("id"), identity.exact_reference(F.col("source")).alias("bare")).filter("id IS NOT NULL").distinct()


def _codes_sql(column: str) -> str:
    pairs = ", ".join(f"('{form}', '{name}')" for name, forms in references.CODES.items() for form in forms)
    upper = f"upper(regexp_replace(trim({column}), '\\.$', ''))"
    return f"coalesce((SELECT c.name FROM (VALUES {pairs}) c(form, name) WHERE c.form = {upper}), {upper})"


_ARTICLE = r"\bArt\. ([0-9]+[a-z]?)(?: (?:Abs|al|cpv)\. [0-9]+)? ([A-Z][A-Za-z]{1,8})\b"


@query(
    "query_articles",
    f"""WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_ARTICLE}', 1)) AS article, unnest(regexp_extract_all(text, '{_ARTICLE}', 2)) AS code FROM documents)
        SELECT doc_id, article, {_codes_sql('m.code')} AS code, count(*) AS mentions FROM m GROUP BY 1, 2, 3""",
)
def query_articles(spark: SparkSession, base: str) -> DataFrame:
    found = table(spark, base, "documents", ("doc_id", "text")).select("doc_id", F.explode(references.articles(F.col("text"))).alias("a"))
    return found.groupBy("doc_id", F.col("a.article").alias("article"), F.col("a.code").alias("code")).agg(count("mentions"))


@query("canon_code", f"SELECT form, {_codes_sql('v.form')} AS code FROM (VALUES ('CO'), ('LTF.'), ('stgb'), ('CCS'), (' LEF '), ('XYZ')) v(form)")
def canon_code(spark: SparkSession, base: str) -> DataFrame:
    rows = spark.createDataFrame([("CO",), ("LTF.",), ("stgb",), ("CCS",), (" LEF ",), ("XYZ",)], "form string")
    return rows.select("form", references.canon_code(F.col("form")).alias("code"))


@query("leak_filter", r"SELECT item_id, regexp_matches(question, '\b[0-9]{1,2}[A-Z]\.[0-9]{1,5}/[0-9]{4}\b|\b(?:BGE|ATF|DTF) [0-9]{1,3} [IVX]+[ab]? [0-9]+\b') AS leaks FROM eval_items")
def leak_filter(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "eval_items").select("item_id", F.col("question").rlike(references.DOCKET_PATTERN).alias("leaks"))


@query(
    "tidy_text",
    r"SELECT doc_id, md5(regexp_replace(regexp_replace(replace(text, chr(12), chr(10)), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g')) AS tidy FROM documents WHERE text IS NOT NULL",
)
def tidy_text(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "documents").filter("text IS NOT NULL").select("doc_id", F.md5(tx.tidy(F.col("text"))).alias("tidy"))


_MARKED = (
    (1, "# Ergebnis\nDie Klage [1] von A.________ ist **begründet** [12]."),
    (2, "<b>fett</b> und `code`  mit   Lücken"),
    (3, "## Schon Satz.\nText"),
    (4, None),
)


@query("strip_markup", "SELECT * FROM (VALUES (1, 'Ergebnis.' || chr(10) || 'Die Klage von N. ist begründet .'), (2, 'fett und code mit Lücken'), (3, '## Schon Satz.' || chr(10) || 'Text'), (4, NULL)) t(id, plain)")
def strip_markup(spark: SparkSession, base: str) -> DataFrame:
    return spark.createDataFrame(_MARKED, "id int, text string").select("id", references.strip_markup(F.col("text")).alias("plain"))


@query("degenerate_text")
def degenerate_text(spark: SparkSession, base: str) -> DataFrame:
    """Texts in which a piece of up to 20 characters is repeated 16 times or more in a row."""
    return table(spark, base, "documents", ("doc_id", "text")).select("doc_id", F.coalesce(F.col("text").rlike(r"([^\n]{1,20}?)\1{15,}"), F.lit(False)).alias("degenerate"))


@query(
    "missing_terms",
    r"""WITH t AS (SELECT item_id, unnest(regexp_extract_all(question, '«([^»]+)»', 1)) AS term FROM eval_items
                   UNION ALL SELECT item_id, unnest(regexp_extract_all(question, '(Art\. [0-9]+[a-z]? [A-Z][A-Za-z]+)', 1)) FROM eval_items)
        SELECT DISTINCT item_id, term FROM t JOIN eval_items USING (item_id) WHERE NOT contains(lower(coalesce(reference, '')), lower(term))""",
)
def missing_terms(spark: SparkSession, base: str) -> DataFrame:
    """Quoted terms and articles of a question that its answer doesn't name."""
    rows = table(spark, base, "eval_items", ("item_id", "question", "reference"))
    terms = F.concat(
        F.regexp_extract_all("question", F.lit("«([^»]+)»"), F.lit(1)), F.regexp_extract_all("question", F.lit(r"(Art\. [0-9]+[a-z]? [A-Z][A-Za-z]+)"), F.lit(1))
    )
    found = rows.select("item_id", "reference", F.explode(terms).alias("term"))
    return found.filter(~F.contains(F.lower(F.coalesce("reference", F.lit(""))), F.lower("term"))).select("item_id", "term").distinct()


@query("last_match", "SELECT * FROM (VALUES (1, 'B'), (2, NULL), (3, 'D')) t(id, answer)")
def last_match(spark: SparkSession, base: str) -> DataFrame:
    rows = spark.createDataFrame([(1, "Answer: A ... doch Answer: B"), (2, "keine"), (3, "Antwort: C\nAnswer: D.")], "id int, text string")
    return rows.select("id", references.last_match(F.col("text"), r"(?:Answer|Antwort|Réponse): *([A-H])\b").alias("answer"))


_DATES = (
    (1, "2021-03-04 Eingang"), (2, "am 3. Mai 2019 in Bern"), (3, "le 12 août 2020"), (4, "07.11.1998"), (5, "marzo 2001"), (6, "um 1985"), (7, "ohne"), (8, None),
    (9, "ils 20 da schaner 2014"),
)


@query(
    "parse_dates",
    "SELECT * FROM (VALUES (1, 2021, 3, 4), (2, 2019, 5, 3), (3, 2020, 8, 12), (4, 1998, 11, 7), (5, 2001, 3, 0), (6, 1985, 0, 0), (7, NULL, NULL, NULL), (8, NULL, NULL, NULL), (9, 2014, 1, 20)) t(id, y, m, d)",
)
def parse_dates(spark: SparkSession, base: str) -> DataFrame:
    rows = spark.createDataFrame(_DATES, "id int, text string").withColumn("p", references.parse_date(F.col("text")))
    return rows.select("id", "p.y", "p.m", "p.d")


@query("strip_tags", "SELECT doc_id, md5(regexp_replace(text, '<[^>]+>', '', 'g')) AS plain FROM documents WHERE text LIKE '%<%>%'")
def strip_tags(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "documents").filter("text LIKE '%<%>%'").select("doc_id", F.md5(F.regexp_replace("text", "<[^>]+>", "")).alias("plain"))


@query(
    "url_parts",
    """SELECT DISTINCT docket_number AS path, regexp_extract(docket_number, '([^/]*)$', 1) AS name, CAST(length(docket_number) - length(replace(docket_number, '/', '')) AS INT) AS depth FROM decisions""",
)
def url_parts(spark: SparkSession, base: str) -> DataFrame:
    path = F.col("docket_number")
    return table(spark, base, "decisions").select(
        path.alias("path"), F.regexp_extract(path, "([^/]*)$", 1).alias("name"), (F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))).cast("int").alias("depth")
    ).distinct()


@query(
    "composite_text",
    r"""WITH d AS (SELECT DISTINCT decision_id, md5(coalesce(full_text, '') || coalesce(regeste, '')) AS h,
                       nullif(left(regexp_replace(split_part(full_text, chr(10), 1), '\s+', ' ', 'g'), 500), '') AS heading,
                       nullif(left(regexp_replace(regeste, '\s+', ' ', 'g'), 2800), '') AS headnote FROM decisions),
            c AS (SELECT decision_id, left(trim(regexp_replace(text, '\s+', ' ', 'g')), 1500) AS passage, min(chunk_index) AS place FROM chunks
                  WHERE section <> 'regeste' AND contains(lower(text), 'frist') GROUP BY 1, 2),
            p AS (SELECT d.decision_id, h, passage, row_number() OVER (PARTITION BY d.decision_id, h ORDER BY place, passage) AS rn
                  FROM d JOIN c USING (decision_id) WHERE NOT contains(coalesce(headnote, ''), passage)),
            t AS (SELECT decision_id, h, string_agg(passage, chr(10) ORDER BY rn) AS passages FROM p WHERE rn <= 2 GROUP BY 1, 2)
       SELECT d.decision_id, d.h, left(concat_ws(chr(10), heading, headnote, passages), 6500) AS composite
       FROM d LEFT JOIN t ON t.decision_id IS NOT DISTINCT FROM d.decision_id AND t.h = d.h""",
)
def composite_text(spark: SparkSession, base: str) -> DataFrame:
    """Heading, headnote and the first two different passages on a term that the headnote doesn't hold already."""
    flat = lambda c: F.regexp_replace(c, r"\s+", " ")
    bounded = lambda c, n: F.nullif(F.left(flat(c), F.lit(n)), F.lit(""))
    rows = table(spark, base, "decisions").select(
        "decision_id", F.md5(F.concat(F.coalesce("full_text", F.lit("")), F.coalesce("regeste", F.lit("")))).alias("h"),
        bounded(F.split_part("full_text", F.lit("\n"), F.lit(1)), 500).alias("heading"), bounded(F.col("regeste"), 2800).alias("headnote"),
    ).distinct()
    hits = table(spark, base, "chunks", ("decision_id", "chunk_index", "section", "text")).filter("section <> 'regeste'").filter(F.contains(F.lower("text"), F.lit("frist")))
    passages = hits.groupBy("decision_id", F.left(F.trim(flat(F.col("text"))), F.lit(1500)).alias("passage")).agg(F.min("chunk_index").alias("place"))
    first = Window.partitionBy("decision_id", "h").orderBy("place", "passage")
    fresh = rows.join(passages, "decision_id").filter(~F.contains(F.coalesce("headnote", F.lit("")), F.col("passage")))
    two = fresh.withColumn("rn", F.row_number().over(first)).filter("rn <= 2").groupBy("decision_id", "h").agg(F.array_sort(F.collect_list(F.struct("rn", "passage"))).alias("p"))
    joined = rows.join(two, ["decision_id", "h"], "left").withColumn("passages", F.array_join(F.transform("p", lambda x: x["passage"]), "\n"))
    return joined.select("decision_id", "h", F.left(F.concat_ws("\n", "heading", "headnote", "passages"), F.lit(6500)).alias("composite"))


@query(
    "snippet",
    r"""SELECT doc_id, CASE WHEN length(f) > 240 THEN rtrim(left(f, 240)) || '…' ELSE f END AS snippet FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS f FROM documents WHERE text IS NOT NULL)""",
)
def snippet(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "documents").filter("text IS NOT NULL").select("doc_id", tx.snippet(F.col("text")).alias("snippet"))


# --- languages and overlaps -----------------------------------------------------------------------------------------


def _language_sql() -> str:
    def counted(lists: dict[str, tuple[str, ...]]) -> str:
        return "[" + ", ".join(f"{{'n': len(list_filter(ws, lambda w: list_contains({list(lists[lang])!r}, w))), 'o': {-i}, 'lang': '{lang}'}}" for i, lang in enumerate(language.LANGS)) + "]"

    # as the operator's clues, for an engine whose word characters are those of ASCII
    before, behind = r"(^|[^\p{L}\p{N}_])", r"([^\p{L}\p{N}_]|$)"
    clues = "\n".join(
        f"WHEN regexp_matches(u, '[{letters}]|{before}({names}){behind}') THEN '{lang}'"
        for lang, letters, names in (("de", "äöüß", "OR|StGB|ZGB|ZPO|SchKG"), ("it", "ìò", "cpv|Cost"), ("fr", "éèçœâêëîïôûÿ", "CO|CP|Cst"))
    )
    return rf"""
WITH t AS (SELECT doc_id, regexp_replace(text, '(?m)^>[^\n]*$', ' ', 'g') AS u FROM documents WHERE text IS NOT NULL),
     w AS (SELECT doc_id, u, regexp_extract_all(lower(regexp_replace(u, '\b[A-Z]{{2,}}\b', ' ', 'g')), '[\p{{L}}]+') AS ws FROM t),
     c AS (SELECT doc_id, u, list_reverse_sort({counted(language.FUNCTION_WORDS)}) AS s, list_reverse_sort({counted(language.FIELD_WORDS)}) AS f FROM w)
SELECT doc_id, CASE WHEN s[1].n >= 2 AND s[1].n > s[2].n THEN s[1].lang WHEN f[1].n > 0 AND f[1].n > f[2].n THEN f[1].lang WHEN s[1].n > s[2].n THEN s[1].lang
{clues} ELSE 'de' END AS language FROM c"""


@query("detect_language", _language_sql())
def detect_language(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "documents").filter("text IS NOT NULL").select("doc_id", language.detect(F.col("text")).alias("language"))


@query("language_drift")
def language_drift(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "documents", ("doc_id", "text")).filter("text IS NOT NULL").withColumn("language", language.detect(F.col("text")))
    return rows.select("doc_id", "language", language.drifts(F.col("text"), F.col("language")).alias("drifts"))


_RUNS = r"list_transform(range(1, greatest(len({0}) - 4, 1)), lambda i: array_to_string({0}[i:i+5], ' '))"
_W = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')"


@query(
    "shares_ngram",
    f"""WITH w AS (SELECT decision_id, md5(coalesce(full_text, '') || coalesce(regeste, '')) AS h, {_W.format('regeste')} AS a, {_W.format('full_text')} AS b FROM decisions)
        SELECT DISTINCT decision_id, h, coalesce(len(a) >= 6 AND len(b) >= 6 AND list_has_any({_RUNS.format('a')}, {_RUNS.format('b')}), false) AS copies FROM w""",
)
def shares_ngram(spark: SparkSession, base: str) -> DataFrame:
    """Headnotes that copy six words in a row from their judgment."""
    rows = table(spark, base, "decisions").select(
        "decision_id", F.md5(F.concat(F.coalesce("full_text", F.lit("")), F.coalesce("regeste", F.lit("")))).alias("h"), overlap.copies_phrase(F.col("regeste"), F.col("full_text")).alias("copies")
    )
    return rows.distinct()


_PAIRS = r"""
s AS (SELECT {g} AS g, {k} AS k, list_sort(list_distinct(regexp_extract_all(lower({t}), '[\p{{L}}\p{{N}}_]{{3,}}'))) AS w FROM {f}),
c AS (SELECT g, w, min(k) AS k FROM s WHERE len(w) >= {least} GROUP BY 1, 2),
p AS (SELECT a.g, a.k AS a, b.k AS b, len(list_intersect(a.w, b.w)) AS common, len(a.w) AS na, len(b.w) AS nb FROM c a JOIN c b ON a.g = b.g AND a.k < b.k)
"""


#: Every question, and every question once more without its last word: repeats are not frequent enough to be left to chance.
_ASKED_TWICE = r"(SELECT suite, item_id, question FROM eval_items UNION ALL SELECT suite, item_id + 1000000, regexp_replace(question, '\s+\S+\s*$', '') FROM eval_items)"


def _asked_twice(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "eval_items", ("suite", "item_id", "question"))
    again = rows.select("suite", (F.col("item_id") + 1_000_000).alias("item_id"), F.regexp_replace("question", r"\s+\S+\s*$", "").alias("question"))
    return rows.unionByName(again)


@query(
    "repeat_pairs",
    f"WITH {_PAIRS.format(g='suite', k='item_id', t='question', f=_ASKED_TWICE, least=1)} SELECT g AS suite, a, b, round(greatest(common / (na + nb - common), common / least(na, nb)), 6) AS similarity FROM p WHERE common > 0 AND greatest(common / (na + nb - common), common / least(na, nb)) >= 0.8",
)
def repeat_pairs(spark: SparkSession, base: str) -> DataFrame:
    return overlap.similar_pairs(_asked_twice(spark, base), ["suite"], "item_id", "question", 0.8).withColumn("similarity", F.round("similarity", 6))


@query(
    "similar_pairs",
    f"WITH {_PAIRS.format(g='area', k='item_id', t='reference', f='eval_items', least=3)} SELECT g AS area, a, b, round(greatest(common / (na + nb - common), common / least(na, nb)), 6) AS similarity FROM p WHERE common > 0 AND greatest(common / (na + nb - common), common / least(na, nb)) >= 0.6",
)
def similar_pairs(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "eval_items", ("area", "item_id", "reference"))
    return overlap.similar_pairs(rows, ["area"], "item_id", "reference", 0.6, least=3).withColumn("similarity", F.round("similarity", 6))


@query("repeat_classes")
def repeat_classes(spark: SparkSession, base: str) -> DataFrame:
    """The members of the classes that repeat_pairs names."""
    return overlap.word_set_classes(_asked_twice(spark, base), ["suite"], "item_id", "question")


@query("similar_classes")
def similar_classes(spark: SparkSession, base: str) -> DataFrame:
    """The members of the classes that similar_pairs names."""
    return overlap.word_set_classes(table(spark, base, "eval_items", ("area", "item_id", "reference")), ["area"], "item_id", "reference", least=3)


@query("repeat_filter")
def repeat_filter(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "eval_items", ("suite", "item_id", "published_at", "question"))
    return overlap.accepted_only(rows, "suite", ["published_at"], "item_id", "question")


@query(
    "locate_exact",
    """SELECT c.id, min(strpos(d.full_text, trim(c.text)) - 1) AS found_at, min(c.char_start) AS stated
       FROM (SELECT DISTINCT id, decision_id, char_start, text FROM chunks WHERE section <> 'regeste' AND trim(text) <> '') c
       JOIN (SELECT decision_id, max(full_text) AS full_text FROM decisions GROUP BY 1) d USING (decision_id) WHERE strpos(d.full_text, trim(c.text)) > 0 GROUP BY 1""",
)
def locate_exact(spark: SparkSession, base: str) -> DataFrame:
    chunks = table(spark, base, "chunks").filter("section <> 'regeste' AND trim(text) <> ''").select("id", "decision_id", "char_start", "text").distinct()
    texts = table(spark, base, "decisions").groupBy("decision_id").agg(F.max("full_text").alias("full_text"))
    at = F.expr("instr(full_text, trim(text))")
    found = chunks.join(texts, "decision_id").withColumn("at", at).filter("at > 0")
    return found.groupBy("id").agg(F.min(F.col("at") - 1).cast("bigint").alias("found_at"), F.min("char_start").alias("stated"))


@query("locate_quote")
def locate_quote(spark: SparkSession, base: str) -> DataFrame:
    """Rubric points of the evaluation items, located in question and model answer."""
    rows = table(spark, base, "eval_items").select("item_id", F.concat_ws("\n", "question", "reference").alias("text"), F.posexplode("rubric").alias("point", "quote"))
    keyed = rows.withColumn("k", F.concat_ws("#", "item_id", "point"))
    return overlap.quote_spans(keyed, "k", "text", "quote")


@query("trimmed_quote")
def trimmed_quote(spark: SparkSession, base: str) -> DataFrame:
    """Rubric points with words in front that the text doesn't have, located by what follows."""
    rows = table(spark, base, "eval_items").select("item_id", F.concat_ws("\n", "question", "reference").alias("text"), F.posexplode("rubric").alias("point", "quote"))
    keyed = rows.withColumn("k", F.concat_ws("#", "item_id", "point")).withColumn("quote", F.concat(F.lit("Wie es dort heisst: "), "quote"))
    return overlap.quote_spans(keyed, "k", "text", "quote", trim=True)


@query("statute_chunks")
def statute_chunks(spark: SparkSession, base: str) -> DataFrame:
    """Articles of acts cut like judgments, in a section of their own."""
    laws = table(spark, base, "documents", ("doc_id", "text", "kind")).filter("kind = 'statute'")
    cut = chunking.chunk_documents(laws, "doc_id", "text", section="law")
    return cut.select("doc_id", "chunk_id", "section", "char_start", "char_end", F.md5("text").alias("text_md5"))


# --- composed answers -----------------------------------------------------------------------------------------------


@query("docket_tokens", r"SELECT DISTINCT docket_number, array_to_string(list_filter(string_split(docket_number, '/'), lambda t: length(t) >= 5 AND regexp_matches(t, '[0-9]') AND regexp_matches(t, '[^0-9]')), ' ') AS tokens FROM decisions")
def docket_tokens(spark: SparkSession, base: str) -> DataFrame:
    tokens = F.filter(F.split("docket_number", "/"), lambda t: (F.length(t) >= 5) & t.rlike("[0-9]") & t.rlike("[^0-9]"))
    return table(spark, base, "decisions").select("docket_number", F.array_join(tokens, " ").alias("tokens")).distinct()


@query("budgeted_concat", "SELECT item_id, array_to_string(list_transform(rubric, lambda r: left(r, 120 // len(rubric))), '|') AS joined FROM eval_items WHERE len(rubric) > 0")
def budgeted_concat(spark: SparkSession, base: str) -> DataFrame:
    """Parts that share a budget of characters evenly."""
    rows = table(spark, base, "eval_items").filter(F.size("rubric") > 0)
    part = (F.lit(120) / F.size("rubric")).cast("int")
    return rows.select("item_id", F.array_join(F.transform("rubric", lambda r: F.substring(r, F.lit(1), part)), "|").alias("joined"))


@query("previous_user_turn", "SELECT event_id, lag(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS previous FROM events")
def previous_user_turn(spark: SparkSession, base: str) -> DataFrame:
    own = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return table(spark, base, "events").select("event_id", F.lag("event_id").over(own).alias("previous"))


@query("timeline_order", "SELECT decision_id, docket_number, row_number() OVER (PARTITION BY court ORDER BY decision_date NULLS LAST, decision_id, docket_number) AS place FROM (SELECT DISTINCT decision_id, docket_number, court, nullif(decision_date, '') AS decision_date FROM decisions WHERE court IS NOT NULL)")
def timeline_order(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "decisions").filter("court IS NOT NULL").select("decision_id", "docket_number", "court", F.nullif("decision_date", F.lit("")).alias("decision_date")).distinct()
    place = F.row_number().over(Window.partitionBy("court").orderBy(F.asc_nulls_last("decision_date"), "decision_id", "docket_number"))
    return rows.select("decision_id", "docket_number", place.cast("bigint").alias("place"))


@query(
    "find_reference",
    f"""WITH asked(q) AS (VALUES ('199 III 159'), ('ATF 199 III 159'), ('bger_1B.60222_2012'), ('999 I 1'))
        SELECT DISTINCT q, d.decision_id FROM asked JOIN decisions d ON {sql_canonical('asked.q')} = {sql_canonical('d.decision_id')}""",
)
def find_reference(spark: SparkSession, base: str) -> DataFrame:
    asked = spark.createDataFrame([("199 III 159",), ("ATF 199 III 159",), ("bger_1B.60222_2012",), ("999 I 1",)], "q string").withColumn("c", identity.canonical_id(F.col("q")))
    rows = table(spark, base, "decisions").select("decision_id", identity.canonical_id(F.col("decision_id")).alias("c"))
    return rows.join(F.broadcast(asked), "c").select("q", "decision_id").distinct()


@query("conversation_list", "SELECT user_id, count(*) AS turns, min(ts) AS started, max(ts) AS latest, arg_max(event_type, event_id) AS last_type FROM events GROUP BY 1")
def conversation_list(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "events").groupBy("user_id").agg(count("turns"), F.min("ts").alias("started"), F.max("ts").alias("latest"), F.max_by("event_type", "event_id").alias("last_type"))


# --- numbers and JSON -----------------------------------------------------------------------------------------------


@query("json_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k, event_type FROM events")
def json_props(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"), "event_type")


@query("linear_score", "SELECT o_orderkey, round(CAST(0.7 AS DOUBLE) * ((o_totalprice - 250000) / CAST(137317 AS DOUBLE)) - CAST(0.2 AS DOUBLE) * ((length(o_orderpriority) - 8) / CAST(2.5 AS DOUBLE)), 6) AS score FROM orders")
def linear_score(spark: SparkSession, base: str) -> DataFrame:
    from gavelgrid.operators.ranking import linear_score as operator

    features = {"price": F.col("o_totalprice"), "size": F.length("o_orderpriority"), "flat": F.lit(1.0)}
    score = operator(features, {"price": 0.7, "size": -0.2, "flat": 1.0}, {"price": 250000.0, "size": 8.0, "flat": 1.0}, {"price": 137317.0, "size": 2.5, "flat": 0.0})
    return table(spark, base, "orders").select("o_orderkey", F.round(score, 6).alias("score"))
