"""Language of queries and short texts by function words, relationally."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gavelgrid.functions.text import bind

# Function words and, for close decisions, words of the field.
FUNCTION_WORDS = {
    "de": ("der", "die", "das", "und", "nicht", "ist", "ein", "eine", "mit", "von", "auf", "für", "dem", "den", "wird", "kann", "wann", "wie", "bei", "nach", "gegen", "ob"),
    "fr": ("le", "la", "les", "des", "est", "une", "dans", "pour", "que", "qui", "pas", "avec", "sur", "du", "au", "quand", "peut", "ne", "contre", "selon", "et"),
    "it": ("il", "lo", "gli", "della", "del", "che", "non", "una", "per", "con", "nel", "alla", "dal", "quando", "può", "sono", "come", "contro", "secondo", "ha", "di"),
    "rm": ("ils", "las", "dals", "dal", "betg", "cun", "dapi", "perquai", "entant", "tar", "sin", "vegn", "ina", "quest", "da", "suenter", "cunter"),
    "en": ("the", "of", "and", "is", "not", "with", "for", "that", "when", "can", "was", "by", "which", "against", "under", "an", "to", "may"),
}
FIELD_WORDS = {
    "de": ("mietvertrag", "kündigung", "urteil", "beschwerde", "vertrag", "gericht"),
    "fr": ("bail", "résiliation", "arrêt", "recours", "contrat", "tribunal"),
    "it": ("locazione", "disdetta", "sentenza", "ricorso", "contratto", "tribunale"),
    "rm": ("locaziun", "sentenzia", "recurs", "dretgira", "contract"),
    "en": ("lease", "judgment", "appeal", "contract", "court"),
}
# Letters and abbreviations that decide where no words do, in this order.
CLUES = (
    ("de", r"(?U)[äöüß]|\b(?:OR|StGB|ZGB|ZPO|SchKG)\b"),
    ("it", r"(?U)[ìò]|\b(?:cpv|Cost)\b"),
    ("fr", r"(?U)[éèçœâêëîïôûÿ]|\b(?:CO|CP|Cst)\b"),
)
LANGS = tuple(FUNCTION_WORDS)


def _counts(words: Column, lists: dict[str, tuple[str, ...]]) -> Column:
    count = lambda members: F.size(F.filter(words, lambda w: w.isin(list(members))))
    return F.array(*[F.struct(count(lists[lang]).alias("n"), F.lit(-i).alias("o"), F.lit(lang).alias("lang")) for i, lang in enumerate(LANGS)])


def detect(text: Column, default: str = "de", least: int = 2) -> Column:
    """Language of a text: most function words, with ``least`` of them and a strict lead; else most words of the field;
    else a weak lead; else letters and abbreviations; else ``default``. Quoted lines don't count, and words in capitals
    (acts) only as abbreviations."""
    unquoted = F.regexp_replace(text, r"(?m)^>[^\n]*$", " ")
    plain = F.regexp_replace(unquoted, r"\b[A-Z]{2,}\b", " ")
    leads = lambda r: r[0]["n"] > r[1]["n"]

    clue = F.coalesce(*[F.when(unquoted.rlike(signs), F.lit(lang)) for lang, signs in CLUES], F.lit(default))

    def choose(strong: Column, field: Column) -> Column:
        return (
            F.when((strong[0]["n"] >= least) & leads(strong), strong[0]["lang"])
            .when((field[0]["n"] > 0) & leads(field), field[0]["lang"])
            .when(leads(strong), strong[0]["lang"])
            .otherwise(clue)
        )

    def ranked(words: Column) -> Column:
        order = lambda lists: F.reverse(F.array_sort(_counts(words, lists)))
        return bind(order(FUNCTION_WORDS), lambda strong: bind(order(FIELD_WORDS), lambda field: choose(strong, field)))

    found = bind(F.regexp_extract_all(F.lower(plain), F.lit(r"[\p{L}]+"), F.lit(0)), ranked)
    return F.when(text.isNotNull(), found).otherwise(F.lit(default))


def drifts(text: Column, language: Column) -> Column:
    """Whether some sentence of eight words or more is clearly in another language (three words at least, lead two)."""
    parts = F.filter(F.split(text, r"(?<=[.!?])\s+|\n+"), lambda s: F.size(F.regexp_extract_all(s, F.lit(r"[\p{L}]+"), F.lit(0))) >= 8)

    def other(counted: Column) -> Column:
        best = F.array_max(counted)
        own = F.element_at(F.filter(counted, lambda c: c["lang"] == language), 1)["n"]
        return (best["n"] >= 3) & (best["n"] >= F.coalesce(own, F.lit(0)) + 2) & (best["lang"] != language)

    def foreign(sentence: Column) -> Column:
        words = F.regexp_extract_all(F.lower(sentence), F.lit(r"[\p{L}]+"), F.lit(0))
        return bind(words, lambda w: bind(_counts(w, FUNCTION_WORDS), other))

    return F.exists(parts, foreign)
