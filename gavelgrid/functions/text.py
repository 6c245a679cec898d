"""Text functions as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters with marks and what they fold to.
MARKED = "àâäáãåçèéêëìíîïñòóôöõùúûüýÿÀÂÄÁÃÅÇÈÉÊËÌÍÎÏÑÒÓÔÖÕÙÚÛÜÝ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"

# Words that carry no topic, in the corpus languages.
STOPWORDS = (
    "der die das den dem des ein eine einer eines einem einen und oder nicht mit auf von vom zu zum zur in im an am für als auch aus bei "
    "nach ist sind war wird werden hat haben sich es er sie wie dass wenn nur noch über unter durch "
    "le la les un une des du de et ou ne pas dans pour par sur avec au aux que qui est sont été ce cette il elle se en plus "
    "il lo gli della del dei delle che non di una per con nel nella alla dal dalla come più anche essere stato "
    "the of and to was that for a in is on by with as it be from this or an are at has not"
).split()


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row. Without it a value named inside a lambda is computed again
    for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fold_accents(text: Column) -> Column:
    return F.translate(text, MARKED, PLAIN)


def words(text: Column, least: int = 2) -> Column:
    """Lower-case words of at least ``least`` letters, digits or underscores, with repeats."""
    return F.regexp_extract_all(F.lower(text), F.lit(rf"[\p{{L}}\p{{N}}_]{{{least},}}"), F.lit(0))


def content_words(text: Column, least: int = 2) -> Column:
    stop = F.array(*[F.lit(w) for w in sorted(set(STOPWORDS))])
    return F.filter(words(text, least), lambda w: ~F.array_contains(stop, w))


def tidy(text: Column) -> Column:
    """Form feeds become line ends, blanks before line ends go, three or more line ends become two."""
    no_feeds = F.regexp_replace(text, "\f", "\n")
    return F.regexp_replace(F.regexp_replace(no_feeds, "[ \t]+\n", "\n"), "\n{3,}", "\n\n")


def snippet(text: Column, size: int = 240) -> Column:
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > size, F.concat(F.rtrim(F.left(flat, F.lit(size))), F.lit("…"))).otherwise(flat)


def context(text: Column, start: Column, end: Column, margin: int = 300) -> Column:
    """A span with ``margin`` characters on each side; ``…`` marks where text was left out."""
    low, high = F.greatest(start - margin, F.lit(0)), F.least(end + margin, F.length(text))
    return F.concat(
        F.when(low > 0, F.lit("…")).otherwise(F.lit("")),
        F.substring(text, low + 1, high - low),
        F.when(high < F.length(text), F.lit("…")).otherwise(F.lit("")),
    )


def read_window(text: Column, offset: Column, size: int = 8000) -> Column:
    """A page of a long text; the offset is clamped into the text."""
    return F.substring(text, F.least(F.greatest(offset, F.lit(0)), F.length(text)) + 1, F.lit(size))
