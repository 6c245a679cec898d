"""Statute references, dates and markers in texts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Codes of the same act in the corpus languages, first the one they are folded to.
CODES = {
    "OR": ("OR", "CO", "DO"),
    "ZGB": ("ZGB", "CC", "CCS", "SCC"),
    "StGB": ("STGB", "CP", "CPS", "SCCR"),
    "ZPO": ("ZPO", "CPC"),
    "StPO": ("STPO", "CPP"),
    "BGG": ("BGG", "LTF"),
    "SchKG": ("SCHKG", "LP", "LEF", "DEBA"),
    "IVG": ("IVG", "LAI"),
    "AIG": ("AIG", "LEI", "LSTRI"),
    "RPG": ("RPG", "LAT", "LPT", "SPA"),
}
# Month names.
MONTHS = (
    ("januar", "janvier", "gennaio", "january", "schaner"),
    ("februar", "février", "febbraio", "february", "favrer"),
    ("märz", "mars", "marzo", "march"),
    ("april", "avril", "aprile", "avrigl"),
    ("mai", "maggio", "may", "matg"),
    ("juni", "juin", "giugno", "june", "zercladur"),
    ("juli", "juillet", "luglio", "july", "fanadur"),
    ("august", "août", "agosto", "avust"),
    ("september", "septembre", "settembre", "settember"),
    ("oktober", "octobre", "ottobre", "october"),
    ("november", "novembre"),
    ("dezember", "décembre", "dicembre", "december"),
)

ARTICLE = r"\bArt\. ([0-9]+[a-z]?)(?: (?:Abs|al|cpv)\. [0-9]+)? ([A-Z][A-Za-z]{1,8})\b"
DOCKET_PATTERN = r"\b[0-9]{1,2}[A-Z]\.[0-9]{1,5}/[0-9]{4}\b|\b(?:BGE|ATF|DTF) [0-9]{1,3} [IVX]+[ab]? [0-9]+\b"


def canon_code(code: Column) -> Column:
    """Code of an act in one language; an unknown code in capitals."""
    upper = F.upper(F.regexp_replace(F.trim(code), r"\.$", ""))
    pairs = [F.lit(x) for name, forms in CODES.items() for form in forms for x in (form, name)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), upper), upper)


def articles(text: Column) -> Column:
    """array<struct<article, code>> of the statute references of a text, with repeats."""
    numbers = F.regexp_extract_all(text, F.lit(ARTICLE), F.lit(1))
    codes = F.regexp_extract_all(text, F.lit(ARTICLE), F.lit(2))
    return F.zip_with(numbers, codes, lambda n, c: F.struct(n.alias("article"), canon_code(c).alias("code")))


def parse_date(text: Column) -> Column:
    """struct<y, m, d> of the first date in the first 60 characters; missing parts are 0, no date is NULL."""
    head = F.lower(F.left(text, F.lit(60)))
    number = lambda pattern, group: F.regexp_extract(head, pattern, group).cast("int")
    date = lambda y, m, d: F.struct(y.alias("y"), m.alias("m"), d.alias("d"))
    zero = F.lit(0)
    names = "|".join(n for month in MONTHS for n in month)
    iso, dotted = r"\b([0-9]{4})-([0-9]{2})-([0-9]{2})", r"\b([0-9]{1,2})\. ?([0-9]{1,2})\. ?([0-9]{4})\b"
    spelt, monthly, yearly = rf"\b([0-9]{{1,2}})\.? (?:da |de |d')?({names}) ([0-9]{{4}})\b", rf"\b({names}) ([0-9]{{4}})\b", r"\b([12][0-9]{3})\b"
    pairs = [F.lit(x) for i, month in enumerate(MONTHS, 1) for n in dict.fromkeys(month) for x in (n, i)]
    month = lambda pattern, group: F.try_element_at(F.create_map(*pairs), F.regexp_extract(head, pattern, group))
    return (
        F.when(head.rlike(iso), date(number(iso, 1), number(iso, 2), number(iso, 3)))
        .when(head.rlike(dotted), date(number(dotted, 3), number(dotted, 2), number(dotted, 1)))
        .when(head.rlike(spelt), date(number(spelt, 3), month(spelt, 2), number(spelt, 1)))
        .when(head.rlike(monthly), date(number(monthly, 2), month(monthly, 1), zero))
        .when(head.rlike(yearly), date(number(yearly, 1), zero, zero))
    )


def last_match(text: Column, pattern: str, group: int = 1) -> Column:
    """The last match of a pattern, NULL without one."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    return F.when(F.size(found) > 0, F.element_at(found, -1))


def strip_markup(text: Column) -> Column:
    """Speakable text: no citation markers, tags or emphasis; headings become sentences, masked names a word."""
    out = F.regexp_replace(text, r"\[[0-9]+\]", "")
    out = F.regexp_replace(out, r"<[^>]+>", "")
    out = F.regexp_replace(out, r"(?m)^#+ *([^\n]*[^\n.:!?])$", "$1.")
    out = F.regexp_replace(out, r"\*+|`+", "")
    out = F.regexp_replace(out, r"[A-Z]\._{4,}", "N.")
    return F.trim(F.regexp_replace(out, r"[ \t]{2,}", " "))
