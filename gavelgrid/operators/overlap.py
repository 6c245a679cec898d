"""Overlap between texts: shared word runs, repeated searches, located quotations."""

from __future__ import annotations

import re
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gavelgrid.functions.text import bind, words


def shingles(text: Column, size: int = 6) -> Column:
    """Distinct runs of ``size`` consecutive words; a shorter text has none."""

    def runs(w: Column) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.size(w) - size + 1), lambda i: F.array_join(F.slice(w, i, F.lit(size)), " "))
        return F.when(F.size(w) >= size, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))

    return bind(words(text, 1), runs)


def copies_phrase(written: Column, source: Column, size: int = 6) -> Column:
    """Whether some ``size`` consecutive words of ``written`` occur in ``source``."""
    return F.coalesce(F.arrays_overlap(shingles(written, size), shingles(source, size)), F.lit(False))


def similarity(a: Column, b: Column) -> Column:
    """The larger of Jaccard and containment of two word sets."""
    both = F.size(F.array_intersect(a, b))
    return F.greatest(both / F.size(F.array_union(a, b)), both / F.least(F.size(a), F.size(b)))


def _word_sets(rows: DataFrame, group: list[str], key: str, text: str, least: int) -> DataFrame:
    return rows.select(*group, key, F.array_sort(F.array_distinct(words(F.col(text), 3))).alias("w")).filter(F.size("w") >= least)


def word_set_classes(rows: DataFrame, group: list[str], key: str, text: str, least: int = 1) -> DataFrame:
    """(group, key, class): the class of every row that ``similar_pairs`` compares, named by its smallest key.

    Rows of one class have similarity 1; other links of a row are those of its class. NULL is no group.
    """
    sets = _word_sets(rows, group, key, text, least).dropna(subset=[*group, key])
    classes = sets.groupBy(*group, "w").agg(F.min(key).alias("class"))
    return sets.join(classes, [*group, "w"]).select(*group, key, "class").distinct()


def similar_pairs(rows: DataFrame, group: list[str], key: str, text: str, threshold: float, least: int = 1) -> DataFrame:
    """(group, a, b, similarity) of pairs in a group that reach ``threshold``, a < b.

    Containment is never below Jaccard, so a pair shares at least ``threshold`` of the smaller set's words, and one of
    its ``(1 - threshold) * n + 1`` rarest words must be in the larger set. Only those are joined. Equal word sets are
    one class while pairs are formed, so copies don't multiply the pairs; a pair names the smallest keys of two classes,
    ``word_set_classes`` the members of each. NULL is no group: its rows are compared with none.
    """
    sets = _word_sets(rows, group, key, text, least)
    classes = sets.groupBy(*group, "w").agg(F.min(key).alias("k")).withColumn("n", F.size("w"))
    every = classes.select(*group, "k", "n", F.explode("w").alias("word"))
    frequency = every.groupBy("word").agg(F.count(F.lit(1)).alias("f"))
    rarest = Window.partitionBy(*group, "k").orderBy("f", "word")
    first = F.floor((1 - threshold) * F.col("n") + 1e-9) + 1
    probes = every.join(frequency, "word").withColumn("r", F.row_number().over(rarest)).filter(F.col("r") <= first)
    small = probes.select(*group, "word", F.col("k").alias("a"), F.col("n").alias("na"))
    large = every.select(*group, "word", F.col("k").alias("b"), F.col("n").alias("nb"))
    meet = small.join(large, [*group, "word"]).filter("na < nb OR (na = nb AND a < b)").select(*group, "a", "b").distinct()
    # the word sets follow only where two keys met
    own = lambda name, words_: classes.select(*group, F.col("k").alias(name), F.col("w").alias(words_))
    scored = meet.join(own("a", "wa"), [*group, "a"]).join(own("b", "wb"), [*group, "b"]).withColumn("similarity", similarity(F.col("wa"), F.col("wb")))
    return scored.filter(F.col("similarity") >= threshold).select(*group, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity")


def accepted_only(rows: DataFrame, group: str, order: list[str], key: str, text: str, threshold: float = 0.8) -> DataFrame:
    """Adds ``repeats``: the earlier *accepted* row of the group a row repeats, else NULL. Repeats are not remembered.

    What is accepted depends on the order, so this is a stateful pass over each group, which is a conversation.
    """
    schema = f"{group} string, {key} string, repeats string"

    def run(part: pd.DataFrame) -> pd.DataFrame:
        accepted: list[tuple[str, set[str]]] = []
        out = []
        for row in part.sort_values([*order, key]).itertuples(index=False):
            own = {w for w in re.findall(r"\w{3,}", (getattr(row, text) or "").lower())}
            hit = next(
                (k for k, w in accepted if own and w and max(len(own & w) / len(own | w), len(own & w) / min(len(own), len(w))) >= threshold), None
            )
            if hit is None:
                accepted.append((getattr(row, key), own))
            out.append((getattr(row, group), getattr(row, key), hit))
        return pd.DataFrame(out, columns=[group, key, "repeats"])

    typed = rows.select(F.col(group).cast("string"), F.col(key).cast("string"), *order, text)
    return typed.groupBy(group).applyInPandas(run, schema)


_QUOTES = "\"'`«»‹›“”„’‘"
_DASHES = "-‐‑–—"
# a hyphen at a line end, inside a word
_SPLIT_WORD = r"(?:[-‐‑][ \t]*\n[ \t]*)?"


def quote_pattern(quote: Column) -> Column:
    """A pattern that finds a quotation whatever its case, kind of quotes and dashes, blanks and hyphens at line ends."""
    plain = F.regexp_replace(F.trim(quote), r"([\\^$.|?*+()\[\]{}])", r"\\$1")
    marked = F.regexp_replace(plain, r"(?<=\p{L})(?=\p{L})", "\u0001")
    marked = F.regexp_replace(F.regexp_replace(marked, r"\s+", "\u0002"), f"[{_DASHES}]", "\u0003")
    marked = F.regexp_replace(marked, f"[{_QUOTES}]", "\u0004")
    for sign, pattern in (("\u0001", _SPLIT_WORD), ("\u0002", r"\s+"), ("\u0003", f"[{_DASHES}]"), ("\u0004", f"[{_QUOTES}]")):
        marked = F.replace(marked, F.lit(sign), F.lit(pattern))
    return F.concat(F.lit("(?iu)"), marked)


def _between(most: Column) -> Column:
    return F.concat(F.lit(r"[\s\S]{0,"), F.greatest(most, F.lit(0)).cast("int").cast("string"), F.lit("}?"))


def _in_order(text: Column, parts: Column, gap: int) -> Column:
    """The text from the first part to the last, each found within ``gap`` characters of the one before."""
    return F.regexp_substr(text, F.array_join(F.transform(parts, quote_pattern), r"[\s\S]{0,%d}?" % gap))


def _head_and_tail(text: Column, quote: Column, size: int) -> Column:
    """The text from the first to the last ``size`` characters of a quotation, at most half as long again as it is."""
    length = F.length(quote)
    pattern = F.concat(
        quote_pattern(F.left(quote, F.lit(size))), _between(length * 1.5 - 2 * size), quote_pattern(F.right(quote, F.lit(size)))
    )
    return F.when(length >= 2 * size, F.regexp_substr(text, pattern))


def _verbatim_beginning(text: Column, quote: Column, share: float, least: int) -> Column:
    """The longest beginning of a quotation in whole words, if ``share`` of its words are found together."""

    def of_words(words_: Column) -> Column:
        first = F.ceil(F.size(words_) * share).cast("int")
        beginning = lambda n: F.regexp_substr(text, quote_pattern(F.array_join(F.slice(words_, F.lit(1), n), " ")))

        def extended(found: Column) -> Column:
            behind = F.substring(text, F.instr(text, found) + F.length(found), F.length(quote) * 2)
            same = F.zip_with(F.slice(words_, first + 1, F.size(words_)), F.split(F.trim(behind), r"\s+"), lambda a, b: F.lower(a).eqNullSafe(F.lower(b)))
            more = F.array_position(F.array_append(same, F.lit(False)), False).cast("int") - 1
            return beginning(F.least(first + more, F.size(words_)))

        return F.when(F.length(F.array_join(F.slice(words_, F.lit(1), first), " ")) >= least, bind(beginning(first), lambda m: F.when(m.isNotNull(), extended(m))))

    return bind(F.split(quote, r"\s+"), of_words)


def locate_quote(text: Column, quote: Column, least: int = 8, gap: int = 3000) -> Column:
    """struct<start, end> of a quotation in a text, NULL if it isn't there: its parts between ellipses in order; else its
    head and tail; else a verbatim beginning of 60 % or more. Parts shorter than ``least`` characters are skipped."""
    edges = r"^[\s.%s]+|[\s.%s]+$" % (_QUOTES, _QUOTES)
    pieces = F.transform(F.split(quote, r"\[?(?:\.\.\.|…)\]?"), lambda p: F.regexp_replace(p, edges, ""))

    def of_parts(parts: Column) -> Column:
        whole = F.array_join(parts, " ")
        found = F.coalesce(_in_order(text, parts, gap), _head_and_tail(text, whole, 40), _verbatim_beginning(text, whole, 0.6, least))
        start = lambda m: F.instr(text, m) - 1
        span = lambda m: F.when(m.isNotNull(), F.struct(start(m).alias("start"), (start(m) + F.length(m)).alias("end")))
        return F.when(F.size(parts) > 0, bind(found, span))

    return bind(F.filter(pieces, lambda p: F.length(p) >= least), of_parts)


def trimmed_quote(text: Column, quote: Column, most: int = 39, least: int = 40) -> Column:
    """As ``locate_quote``, with up to ``most`` leading words dropped while ``least`` characters remain."""
    none = F.lit(None).cast("struct<start:int,end:int>")

    def of_words(words_: Column) -> Column:
        rest = lambda n: F.array_join(F.slice(words_, n + 1, F.size(words_)), " ")
        later = lambda n: F.when(F.length(rest(n)) >= least, locate_quote(text, rest(n)))
        drops = F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(most), F.size(words_) - 1)))
        return F.coalesce(locate_quote(text, quote), F.aggregate(drops, none, lambda hit, n: F.when(hit.isNotNull(), hit).otherwise(later(n))))

    return bind(F.split(F.trim(quote), r"\s+"), of_words)


def quote_spans(rows: DataFrame, key: str, text: str, quote: str, trim: bool = False) -> DataFrame:
    """(key, char_start, char_end) of located quotations; NULL where a quotation isn't found."""
    place = (trimmed_quote if trim else locate_quote)(F.col(text), F.col(quote))
    return rows.select(F.col(key).cast("string").alias(key), place.alias("_at")).select(
        key, F.col("_at.start").alias("char_start"), F.col("_at.end").alias("char_end")
    )
