"""Splitting oversized items at natural boundaries, with overlap.

Method: bounded-quantifier regex extraction. The alternatives of one pattern are ordered by the strength of the
boundary they end at (blank line, line end, sentence end, clause end, blank) and each consumes up to the limit; the
last alternative takes plain characters. The pieces of one text follow each other without gaps; lookback offsets then
extend every piece but the first by ``overlap`` characters to the left, so no piece exceeds ``limit``.

All of it is SQL functions over whole texts. Running offsets are summed in two levels of blocks, so a text of n pieces
costs n * sqrt(n) and not n * n additions.

Defined cases: blanks, tabs and line feeds at both ends do not count and belong to no piece; NULL, empty and blank texts
have no pieces; a text of at most ``limit`` characters is one piece; characters are code points.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelgrid.sources.tables import require

LIMIT, OVERLAP = 2200, 200
EDGE = " \t\n"
_BLOCK = 64


def boundary_pattern(limit: int, overlap: int) -> str:
    """Ordered alternatives. Ends in the upper half of a piece come first, so that they don't make crumbs; a line or
    sentence end in the lower half still goes before a clause end, a blank or a bare character."""
    most = limit - overlap
    least = max(1, most // 2)
    paragraph, line, sentence, clause, word = (
        r"\n[ \t]{0,6}\n",
        r"\n",
        r"[.!?…][\"'»”’)\]]{0,6}[ \t\n]",
        r"[;:,][ \t\n]",
        r"[ \t\n]",
    )
    fits = max(1, most - 8)  # a boundary's own characters must fit below the limit, too
    upper, any_ = rf".{{{min(least, fits)},{fits}}}", rf".{{1,{fits}}}"
    tried = [upper + paragraph, upper + line, upper + sentence, any_ + rf"(?:{line}|{sentence})", upper + clause, upper + word]
    return "(?s)" + "|".join([*tried, rf".{{1,{most}}}"])


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running_starts(lengths: Column) -> Column:
    """Start offsets from piece lengths: sums inside blocks of pieces, added to the sums of the blocks before."""
    total = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x)
    block = lambda i: F.floor(i / _BLOCK).cast("int")
    sums = F.transform(
        F.sequence(F.lit(0), block(F.size(lengths) - 1)), lambda b: total(F.slice(lengths, b * _BLOCK + 1, F.lit(_BLOCK)))
    )

    def starts(blocks: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(blocks)), lambda b: total(F.slice(blocks, F.lit(1), b - 1)))

    def every(block_starts: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(lengths) - 1),
            lambda i: F.element_at(block_starts, block(i) + 1) + total(F.slice(lengths, block(i) * _BLOCK + 1, i % _BLOCK)),
        )

    return _let(sums, lambda blocks: _let(starts(blocks), every))


def cut_spans(body: Column, lead: Column, limit: int = LIMIT, overlap: int = OVERLAP) -> Column:
    """array<struct<char_start, char_end, pieces>> of the trimmed text ``body`` that starts at ``lead`` in the whole text."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be smaller than limit")

    def span(start: Column, end: Column, pieces: Column) -> Column:
        return F.struct((lead + start).cast("int").alias("char_start"), (lead + end).cast("int").alias("char_end"), pieces.cast("int").alias("pieces"))

    def overlapped(lengths: Column) -> Column:
        return F.zip_with(
            _running_starts(lengths), lengths, lambda s, n: span(F.greatest(s - overlap, F.lit(0)), s + n, F.size(lengths))
        )

    cut = F.transform(F.regexp_extract_all(body, F.lit(boundary_pattern(limit, overlap)), F.lit(0)), F.length)
    none = F.array().cast("array<struct<char_start:int,char_end:int,pieces:int>>")
    return (
        F.when(F.length(body) > limit, _let(cut, overlapped))
        .when(F.length(body) > 0, F.array(span(F.lit(0), F.length(body), F.lit(1))))
        .otherwise(none)
    )


def split_items(items: DataFrame, text: str, keys: list[str], limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Keys of ``items``, its ``text`` and ``spans``, the pieces' offsets into the text."""
    rows = items.select(*[F.col(f"`{k}`") for k in keys], F.col(f"`{text}`").cast("string").alias("whole"))
    body = F.coalesce(F.trim(F.col("whole"), F.lit(EDGE)), F.lit(""))
    lead = F.length("whole") - F.length(F.ltrim(F.col("whole"), F.lit(EDGE)))
    cut = rows.withColumn("body", body).withColumn("lead", F.coalesce(lead, F.lit(0)))
    return cut.withColumn("spans", cut_spans(F.col("body"), F.col("lead"), limit, overlap)).drop("body", "lead")


def explode_pieces(split: DataFrame, keys: list[str]) -> DataFrame:
    """One row per piece of the items that had to be cut: keys, piece_index, char_start, char_end, text."""
    return split.select(*keys, "whole", F.posexplode("spans").alias("piece_index", "s")).filter("s.pieces > 1").select(
        *keys,
        "piece_index",
        F.col("s.char_start").alias("char_start"),
        F.col("s.char_end").alias("char_end"),
        F.substring(F.col("whole"), F.col("s.char_start") + 1, F.col("s.char_end") - F.col("s.char_start")).alias("text"),
    )


def both_tables(decisions: DataFrame, chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(item_table, item_key, decision_id, item_start, whole, spans) of judgments and passages."""
    judgments = split_items(
        require(decisions, decision_id="string", full_text="string").filter("decision_id IS NOT NULL"), "full_text", ["decision_id"], limit, overlap
    ).select(F.lit("decisions").alias("item_table"), F.col("decision_id").alias("item_key"), "decision_id", F.lit(0).alias("item_start"), "whole", "spans")
    passages = split_items(
        require(chunks, id="bigint", decision_id="string", char_start="int", text="string").filter("id IS NOT NULL"),
        "text",
        ["id", "decision_id", "char_start"],
        limit,
        overlap,
    ).select(F.lit("chunks").alias("item_table"), F.col("id").cast("string").alias("item_key"), "decision_id", F.col("char_start").alias("item_start"), "whole", "spans")
    return judgments.unionByName(passages)


def oversized(decisions: DataFrame, chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(item_table, item_key): every item that had to be cut into more than one piece."""
    return both_tables(decisions, chunks, limit, overlap).filter(F.size("spans") > 1).select("item_table", "item_key").distinct()


def oversized_pieces(decisions: DataFrame, chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of every oversized item with offsets into the decision's ``full_text``.

    A passage's stated offset is checked against the judgment: where its text stands there, or else anywhere in a
    delivery of its decision, the pieces get offsets into ``full_text``; otherwise (headnotes, lost texts) their offsets
    are NULL. ``item_start`` and ``item_end`` are offsets into the item's own text.
    """
    cut = both_tables(decisions, chunks, limit, overlap)
    keys = ["item_table", "item_key", "decision_id", "item_start"]
    judgments = explode_pieces(cut.filter("item_table = 'decisions'"), keys).withColumn("at", F.lit(0))
    passages = cut.filter((F.col("item_table") == "chunks") & (F.size("spans") > 1))
    texts = require(decisions, decision_id="string", full_text="string").filter("full_text IS NOT NULL")
    stated = F.substring(F.col("full_text"), F.col("item_start") + 1, F.length("whole")) == F.col("whole")
    found = F.expr("locate(whole, full_text)") - 1
    placed = (
        passages.join(texts, "decision_id")
        .select("item_table", "item_key", "whole", F.when(stated, F.col("item_start")).when(found >= 0, found).alias("at"))
        .groupBy("item_table", "item_key", F.md5("whole").alias("_text"))
        .agg(F.min("at").alias("at"))
    )
    located = passages.withColumn("_text", F.md5("whole")).join(placed, ["item_table", "item_key", "_text"], "left")
    pieces = judgments.unionByName(explode_pieces(located, [*keys, "at"]).select(judgments.columns))
    return pieces.select(
        "item_table",
        "item_key",
        "piece_index",
        F.col("char_start").alias("item_start"),
        F.col("char_end").alias("item_end"),
        (F.col("char_start") + F.col("at")).alias("char_start"),
        (F.col("char_end") + F.col("at")).alias("char_end"),
        "text",
    ).distinct()
