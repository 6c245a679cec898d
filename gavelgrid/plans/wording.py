"""Queries of the functions that rewrite, split and grade texts, over whole tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gavelgrid.functions import rewriting
from gavelgrid.operators import chunking, evaluation
from gavelgrid.plans.registry import Registry
from gavelgrid.sources.tables import table

REGISTRY = Registry()
query = REGISTRY.query

ALIASES = {"CO": "OR", "ATF": "BGE", "DTF": "BGE", "CPC": "ZPO", "LTF": "BGG", "Obligationenrecht": "OR"}
COURTS = {"bger": "Bundesgericht", "bvger": "Bundesverwaltungsgericht", "be": "Bern", "zh": "Zürich", "ti": "Ticino"}


def _many(function) -> Column:
    """A function from a text to a list of texts, as a column."""

    @F.pandas_udf("array<string>")
    def mapped(values: pd.Series) -> pd.Series:
        return values.map(lambda v: [] if v is None else function(v))

    return mapped


def _replaced(column: str, forms: dict[str, str]) -> str:
    text = column
    for form, official in sorted(forms.items(), key=lambda x: (-len(x[0]), x[0])):
        text = rf"regexp_replace({text}, '\b{form}\b', '{official}', 'g')"
    return text


_FRENCH = {"OR": "CO", "ZGB": "CC", "StGB": "CP", "ZPO": "CPC", "StPO": "CPP", "BGG": "LTF", "SchKG": "LP", "LEF": "LP", "BGE": "ATF", "DTF": "ATF",
           "DO": "CO", "CCS": "CC", "SCC": "CC", "STGB": "CP", "CPS": "CP", "SCCR": "CP", "STPO": "CPP", "SCHKG": "LP", "DEBA": "LP"}


@query("localised_acts", f"SELECT doc_id, {_replaced('text', _FRENCH)} AS localised FROM documents WHERE text IS NOT NULL")
def localised_acts(spark: SparkSession, base: str) -> DataFrame:
    """Acts and reporters in their French forms."""
    french = rewriting.column_of(lambda t: rewriting.localise(t, "fr"))
    return table(spark, base, "documents", ("doc_id", "text")).filter("text IS NOT NULL").select("doc_id", french("text").alias("localised"))


@query("alias_rewrite", f"SELECT doc_id, {_replaced('text', ALIASES)} AS official FROM documents WHERE text IS NOT NULL")
def alias_rewrite(spark: SparkSession, base: str) -> DataFrame:
    official = rewriting.column_of(lambda t: rewriting.rewrite_aliases(t, ALIASES))
    return table(spark, base, "documents", ("doc_id", "text")).filter("text IS NOT NULL").select("doc_id", official("text").alias("official"))


_TITLE = "array_to_string(list_transform(string_split(trim(replace({0}, '_', ' ')), ' '), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ')"


@query(
    "court_labels",
    f"""SELECT DISTINCT court, CASE {' '.join(f"WHEN court = '{c}' THEN '{n}'" for c, n in COURTS.items())}
        {' '.join(f"WHEN starts_with(court, '{c}_') THEN trim('{n} ' || {_TITLE.format(f'substr(court, {len(c) + 2})')})" for c, n in COURTS.items())}
        ELSE {_TITLE.format('court')} END AS label FROM decisions WHERE court IS NOT NULL""",
)
def court_labels(spark: SparkSession, base: str) -> DataFrame:
    label = rewriting.column_of(lambda c: rewriting.court_label(c, COURTS))
    return table(spark, base, "decisions", ("court",)).filter("court IS NOT NULL").distinct().select("court", label("court").alias("label"))


@query(
    "paired_test",
    """WITH n AS (SELECT user_id, count(*) FILTER (event_type = 'click') AS a, count(*) FILTER (event_type = 'view') AS b FROM events GROUP BY 1)
       SELECT user_id, round(least(1.0, CASE WHEN a + b = 0 THEN 1.0 ELSE 2 * (SELECT sum(exp(lgamma(a + b + 1) - lgamma(i + 1) - lgamma(a + b - i + 1) - (a + b) * ln(2)))
              FROM (SELECT unnest(range(0, least(a, b) + 1)) AS i)) END), 6) AS p FROM n""",
)
def paired_test(spark: SparkSession, base: str) -> DataFrame:
    """Exact two-sided test of clicks against views, per user."""

    @F.pandas_udf("double")
    def p(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([evaluation.mcnemar(int(x), int(y)) for x, y in zip(a, b)], dtype=float)

    counts = table(spark, base, "events", ("user_id", "event_type")).groupBy("user_id").agg(
        F.count_if(F.col("event_type") == "click").alias("a"), F.count_if(F.col("event_type") == "view").alias("b")
    )
    return counts.select("user_id", F.round(p("a", "b"), 6).alias("p"))


@query(
    "objection_severity",
    """SELECT l_orderkey, l_linenumber, CASE WHEN NOT l_quantity > 5 OR NOT l_discount > 0.01 OR l_returnflag = 'R' OR NOT l_tax > 0.01 THEN 5 WHEN l_linestatus = 'O' THEN 2 ELSE 3 END AS severity FROM lineitem""",
)
def objection_severity(spark: SparkSession, base: str) -> DataFrame:
    flags = (F.col("l_quantity") > 5, F.col("l_discount") > 0.01, F.col("l_returnflag") == "R", F.col("l_tax") > 0.01, F.col("l_linestatus") == "O")
    return table(spark, base, "lineitem").select("l_orderkey", "l_linenumber", evaluation.severity(*flags).alias("severity"))


@query("sentence_pieces")
def sentence_pieces(spark: SparkSession, base: str) -> DataFrame:
    """Documents in pieces of whole sentences, up to 400 characters."""
    pieces = _many(lambda t: chunking.sentence_pieces(t, 400))
    return table(spark, base, "documents", ("doc_id", "text")).select("doc_id", F.posexplode(pieces("text")).alias("number", "piece"))


@query("first_sentences")
def first_sentences(spark: SparkSession, base: str) -> DataFrame:
    first = rewriting.column_of(lambda t: (chunking.first_sentence(t) or (None,))[0])
    return table(spark, base, "documents", ("doc_id", "text")).select("doc_id", first("text").alias("sentence"))


@query("rubric_points")
def rubric_points(spark: SparkSession, base: str) -> DataFrame:
    points = _many(chunking.grading_points)
    rows = table(spark, base, "eval_items", ("item_id", "rubric")).select("item_id", F.array_join("rubric", "\n- ").alias("text"))
    return rows.select("item_id", F.posexplode(points(F.concat(F.lit("- "), "text"))).alias("number", "point"))


@query("sanitised_queries")
def sanitised_queries(spark: SparkSession, base: str) -> DataFrame:
    """Model answers as if they were translations of their questions: without references the question lacks."""

    @F.pandas_udf("string")
    def cleaned(original: pd.Series, translated: pd.Series) -> pd.Series:
        return pd.Series([None if o is None or t is None else rewriting.sanitised(o, t) for o, t in zip(original, translated)], dtype=object)

    return table(spark, base, "eval_items", ("item_id", "question", "reference")).select("item_id", cleaned("question", "reference").alias("query"))


@query("struck_articles")
def struck_articles(spark: SparkSession, base: str) -> DataFrame:
    """Model answers without the articles their questions don't name."""

    @F.pandas_udf("string")
    def struck(text: pd.Series, facts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else rewriting.without_unknown_articles(t, f or "") for t, f in zip(text, facts)], dtype=object)

    return table(spark, base, "eval_items", ("item_id", "question", "reference")).select("item_id", struck("reference", "question").alias("answer"))


@query("choice_letters")
def choice_letters(spark: SparkSession, base: str) -> DataFrame:
    letters = _many(rewriting.option_letters)
    return table(spark, base, "eval_items", ("item_id", "question")).select("item_id", letters("question").alias("letters"))


@query("numbered_statements")
def numbered_statements(spark: SparkSession, base: str) -> DataFrame:
    parts = _many(lambda t: [f"{n}\t{s}" for n, s in rewriting.statements(t)])
    return table(spark, base, "documents", ("doc_id", "text")).select("doc_id", F.explode(parts("text")).alias("statement"))
