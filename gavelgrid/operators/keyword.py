"""Postings, BM25, boolean and phrase search over any table of (document, text)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gavelgrid.functions.text import STOPWORDS, fold_accents, words
from gavelgrid.operators.vectors import Best, hide_own
from gavelgrid.session import checkpointed

K1, B = 1.2, 0.75


def term_counts(documents: DataFrame, key: str, text: str, tokens=words) -> DataFrame:
    """(key, term, tf)."""
    exploded = documents.select(F.col(key), F.explode(tokens(F.col(text))).alias("term"))
    return exploded.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def postings_of(documents: DataFrame, key: str, text: str, tokens=words) -> DataFrame:
    """(key, term, tf, dl): postings that carry the length of their document, so that no join has to bring it. Rows of a
    repeated key are documents of their own length and get one posting each."""
    split = documents.select(F.col(key), tokens(F.col(text)).alias("_w")).select(key, "_w", F.size("_w").cast("bigint").alias("dl"))
    return split.select(key, "dl", F.explode("_w").alias("term")).groupBy(key, "term", "dl").agg(F.count(F.lit(1)).alias("tf")).select(key, "term", "tf", "dl")


def build_index(documents: DataFrame, key: str, text: str, tokens=words) -> DataFrame:
    """Postings (key, term, tf, dl), written once: sizes, frequencies and weights all read them."""
    return checkpointed(postings_of(documents, key, text, tokens))


def bm25_postings(postings: DataFrame, key: str, total: int, mean_length: float) -> DataFrame:
    """(key, term, w): all postings with their BM25 weight, ready to be summed by a query."""
    return _weights(postings, key, total, mean_length)


def corpus_size(postings: DataFrame, key: str) -> tuple[int, float]:
    """(documents with a term, mean length): one row of statistics."""
    row = postings.agg(F.count_distinct(key), F.sum("tf")).first()
    return int(row[0]), float((row[1] or 0) / row[0]) if row[0] else 1.0


def bm25_search(
    documents: DataFrame, key: str, text: str, queries: DataFrame, query: str, query_text: str, k: int | None, tokens=words, among: DataFrame | None = None
) -> DataFrame:
    """(query, key, score, rank): the k best documents of every query.

    Only the postings of query terms get weights; statistics still come from all documents. With ``among`` (key) only
    those documents are scored; with ``k = None`` every document with a query term comes out, without a rank.
    """
    postings = build_index(documents, key, text, tokens)
    total, mean_length = corpus_size(postings, key)
    asked = queries.select(F.col(query), F.explode(F.array_distinct(tokens(F.col(query_text)))).alias("term"))
    live = postings.join(asked.select("term").distinct(), "term", "left_semi")
    weighted = _weights(live, key, total, mean_length, among)
    scored = asked.join(weighted, "term").groupBy(query, key).agg(F.sum("w").alias("score"))
    if k is None:
        return scored.withColumn("rank", F.lit(None).cast("int"))
    best = Window.partitionBy(query).orderBy(F.desc(F.round("score", 9)), key)
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


QUERY_BLOCK, TERM_BLOCK = 8_192, 1_000_000  # queries and query terms sent to the documents at once
TILE, STRIP = 2_048, 1_024  # documents and queries multiplied at once
DENSE_TERMS, DENSE_SHARE = 1_024, 0.0005  # terms so frequent in documents and queries are multiplied as a matrix, the others added one by one


def joined_words(documents: DataFrame, text: str, tokens=words) -> DataFrame:
    """``text`` as its words with blanks between them (``words``) and their number (``dl``), in place of ``text``."""
    rest = [c for c in documents.columns if c != text]
    split = documents.select(*rest, tokens(F.col(text)).alias("_w"))
    return split.select(*rest, F.array_join("_w", " ").alias("words"), F.greatest(F.size("_w"), F.lit(0)).cast("bigint").alias("dl"))


def bm25_best(documents: DataFrame, key: str, queries: DataFrame, query: str, k: int, digits: int = 6, query_block: int = QUERY_BLOCK, term_block: int = TERM_BLOCK) -> DataFrame:
    """(query, key, score, rank): the k best documents of many long queries, a document's own key excepted.

    ``documents`` (key, words, dl) and ``queries`` (query, words) come from ``joined_words`` and are read several times.
    Queries as long as a passage share a word with nearly every document, so no postings move: blocks of whole queries go
    to the documents, a task multiplies its documents' weights with them and keeps the k best of each query; a ranking
    window merges the tasks. All documents count in the statistics, those without a key too.

    Scores equal to ``digits`` digits go to the smaller key. Keys are whole numbers.
    """
    spark = documents.sparkSession
    size = documents.filter("dl > 0").agg(F.count(F.lit(1)), F.sum("dl")).first()
    total, mean_length = int(size[0]), float((size[1] or 0) / size[0]) if size[0] else 1.0
    asked = queries.select(F.col(query).cast("bigint").alias("query"), F.explode(F.array_distinct(F.split("words", " "))).alias("term")).filter("query IS NOT NULL AND term <> ''").distinct()
    frequency = documents.select(F.explode(F.array_distinct(F.split("words", " "))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    known = checkpointed(asked.join(frequency, "term"))
    n = known.agg(F.count(F.lit(1)), F.count_distinct("query")).first()
    schema = "query bigint, item bigint, score double"
    blocks = max(1, -(-n[1] // query_block), -(-n[0] // term_block))
    rows = documents.select(F.col(key).cast("bigint").alias("i"), "words", "dl").filter("i IS NOT NULL AND dl > 0")
    rows = rows.coalesce(spark.sparkContext.defaultParallelism)  # every task sends k hits of each query
    found = [_best_of_block(rows, known.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b), total, mean_length, k, digits, schema) for b in range(blocks)]
    best = Window.partitionBy("query").orderBy(F.desc(F.round("score", digits)), "item")
    ranked = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query", F.col("item").alias(key), "score", "rank")


def _best_of_block(rows: DataFrame, asked: DataFrame, total: int, mean_length: float, k: int, digits: int, schema: str) -> DataFrame:
    """Hits of one block of queries, ``asked`` (query, term, df), in all rows (i, words, dl)."""
    part = asked.select("query", "term", "df").toArrow()
    own, at = np.unique(part["query"].to_numpy(), return_inverse=True)
    coded = part["term"].combine_chunks().dictionary_encode()
    term, df = coded.indices.to_numpy(), np.ones(len(coded.dictionary))
    df[term] = part["df"].to_numpy()
    idf = np.log(1 + (total - df + 0.5) / (df + 0.5))
    share = df / max(total, 1) * np.bincount(term, minlength=len(df)) / max(len(own), 1)
    dense = np.argsort(-share, kind="stable")[: min(DENSE_TERMS, int((share > DENSE_SHARE).sum()))]
    shared = rows.sparkSession.sparkContext.broadcast((own, at, term, coded.dictionary, idf, dense))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, at, term, vocabulary, idf, dense = shared.value
        column = np.full(len(idf), -1)
        column[dense] = np.arange(len(dense))
        matrix = np.zeros((len(own), len(dense)))
        common = column[term] >= 0
        matrix[at[common], column[term[common]]] = 1
        order = np.lexsort((term[~common], at[~common] // STRIP))
        rare_query, rare_term = at[~common][order], term[~common][order]
        strips = np.searchsorted(rare_query // STRIP, np.arange(-(-len(own) // STRIP) + 1))
        best = Best(len(own), k, digits)
        for batch in batches:
            for first in range(0, len(batch), TILE):
                tile = batch.slice(first, TILE)
                ids, dl = tile.column("i").to_numpy(), tile.column("dl").to_numpy()
                split = pc.split_pattern(tile.column("words"), " ")
                word = pc.fill_null(pc.index_in(split.flatten(), value_set=vocabulary), -1).to_numpy()
                place = np.repeat(np.arange(len(ids)), pc.list_value_length(split).to_numpy())[word >= 0]
                posting, tf = np.unique(place * len(idf) + word[word >= 0], return_counts=True)
                place, word = np.divmod(posting, max(len(idf), 1))
                weight = idf[word] * (tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[place] / mean_length)))
                frequent = column[word] >= 0
                weights = np.zeros((len(ids), len(dense)))
                weights[place[frequent], column[word[frequent]]] = weight[frequent]
                place, word, weight = place[~frequent], word[~frequent], weight[~frequent]
                for strip in range(len(strips) - 1):
                    low, high = strip * STRIP, min((strip + 1) * STRIP, len(own))
                    scores = matrix[low:high] @ weights.T
                    terms = rare_term[strips[strip] : strips[strip + 1]]
                    start = np.searchsorted(terms, word)
                    times = np.searchsorted(terms, word, side="right") - start
                    posting = np.repeat(np.arange(len(word)), times)
                    asking = np.arange(len(posting)) - np.repeat(np.cumsum(times) - times - start, times)
                    np.add.at(scores, (rare_query[strips[strip] + asking] - low, place[posting]), weight[posting])
                    hide_own(scores, own[low:high], ids, 0.0)
                    best.pick(np.arange(low, high), ids, scores, np.finfo(float).tiny)  # a hit shares a word
                if np.isinf(best.edge).any():
                    best.cut()
        query, item, score = best.cut()
        yield pa.RecordBatch.from_arrays([pa.array(own[query]), pa.array(item), pa.array(score)], ["query", "item", "score"])

    return rows.mapInArrow(run, schema)


def parse_match(expression: str) -> list[list[str]]:
    """Parts of a search text: quoted parts are phrases of several words, the others single words; parts without a
    letter or digit are dropped."""
    parts = [m.group(1) if m.group(1) is not None else m.group(2) for m in re.finditer(r'"([^"]*)"|(\S+)', expression)]
    return [w for w in (re.findall(r"\w+", p.lower()) for p in parts) if w]


def match_condition(text: Column, expression: str) -> Column:
    """Whether a text has every part of the search text, accents aside."""
    folded = F.concat(F.lit(" "), F.array_join(words(fold_accents(F.lower(text)), 1), " "), F.lit(" "))
    condition = F.lit(True)
    for part in parse_match(expression):
        wanted = F.concat(F.lit(" "), fold_accents(F.lit(" ".join(part))), F.lit(" "))
        condition = condition & folded.contains(wanted)
    return condition


def broad_terms(text: Column, most: int = 12, fillers: tuple[str, ...] = ("entscheid", "urteil", "decision", "arrêt", "sentenza")) -> Column:
    """Distinct content words in the order of the text; short act names in capitals stay as they are."""
    stop = F.array(*[F.lit(w) for w in sorted({*STOPWORDS, *fillers})])
    found = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]{2,}"), F.lit(0))
    named = F.transform(found, lambda w: F.when(w.isin("OR", "CO", "CP"), w).otherwise(F.lower(w)))
    return F.slice(F.array_distinct(F.filter(named, lambda w: ~F.array_contains(stop, w))), 1, most)


def broad_search(documents: DataFrame, key: str, text: str, queries: DataFrame, query: str, query_text: str, k: int) -> DataFrame:
    """(query, key, tier, score, rank): documents with all terms first (tier 0), then those with any, by BM25."""
    asked = queries.select(F.col(query), broad_terms(F.col(query_text)).alias("terms")).filter(F.size("terms") > 0)
    terms = asked.select(query, F.explode("terms").alias("t"), F.size("terms").alias("n")).select(query, F.lower("t").alias("term"), "n")
    postings = build_index(documents, key, text)
    total, mean_length = corpus_size(postings, key)
    live = postings.join(terms.select("term").distinct(), "term", "left_semi")
    weighted = _weights(live, key, total, mean_length)
    scored = terms.join(weighted, "term").groupBy(query, key).agg(F.sum("w").alias("score"), F.count_distinct("term").alias("hits"), F.max("n").alias("n"))
    tiered = scored.withColumn("tier", F.when(F.col("hits") == F.col("n"), 0).otherwise(1))
    best = Window.partitionBy(query).orderBy("tier", F.desc(F.round("score", 9)), key)
    return tiered.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(query, key, "tier", "score", "rank")


def _weights(live: DataFrame, key: str, total: int, mean_length: float, among: DataFrame | None = None) -> DataFrame:
    df = live.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (total - F.col("df") + 0.5) / (F.col("df") + 0.5))
    damped = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / mean_length))
    held = live if among is None else live.join(among.select(key).distinct(), key, "left_semi")
    return held.join(df, "term").select(key, "term", (idf * damped).alias("w"))


def postings_delta(postings: DataFrame, added: DataFrame, removed: DataFrame, key: str, text: str) -> DataFrame:
    """Postings after documents were added, changed or removed: theirs are replaced, nothing else is computed again."""
    touched = added.select(key).unionByName(removed.select(key)).distinct()
    return postings.join(touched, key, "left_anti").unionByName(postings_of(added, key, text).select(*postings.columns))
