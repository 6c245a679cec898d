"""Identity rules of decisions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The spellings of a reporter citation.
REPORTER_CITATION = (
    r"(?i)^(?:bge[_ ]*(?:historical[_ ]*)?)?(?:(?:BGE|ATF|DTF)[_ ]*)?"
    r"([0-9]{1,3})[_ ]+([IVX]+)([ab]?)[_ ]+([0-9]+)\s*$"
)
DOCKET = r"\b([0-9]{1,2}[A-Z][_. ][0-9]{1,5}/[0-9]{4})\b"
BARE_REFERENCE = (
    r"(?i)^(?:(?:bge[_ ]*)?(?:BGE|ATF|DTF)?[_ ]*[0-9]{1,3}[_ ]+[IVX]+[ab]?[_ ]+[0-9]+"
    r"|(?:BVGE|ATAF|DTAF)\s+[0-9]{4}/[0-9]+|[0-9]{1,2}[A-Z][_. ][0-9]+/[0-9]{4}"
    r"|(?:bge|bger|bvger|bstger)_.+)$"
)


def canonical_id(identifier: Column) -> Column:
    """``bge_BGE_{volume}_{division}_{page}`` for a reporter citation, any other id as written, NULL for NULL."""
    part = lambda group: F.regexp_extract(identifier, REPORTER_CITATION, group)
    division = F.concat(F.upper(part(2)), F.lower(part(3)))
    return F.when(
        identifier.rlike(REPORTER_CITATION),
        F.concat(F.lit("bge_BGE_"), part(1), F.lit("_"), division, F.lit("_"), part(4)),
    ).otherwise(identifier)


def docket_key(reference: Column) -> Column:
    """Spelling-free key of a docket: before ``#``; a reporter citation keeps its canonical id."""
    head = F.trim(F.split_part(F.trim(reference), F.lit("#"), F.lit(1)))
    canonical = canonical_id(head)
    bare = F.regexp_replace(head, r"(?i)^(?:bger|bvger|bstger)_", "")
    return F.when(canonical.startswith("bge_BGE_"), canonical).otherwise(
        F.regexp_replace(F.lower(bare), r"[^a-z0-9]", "")
    )


def own_dockets(text: Column) -> Column:
    """Sorted distinct dockets of the judgment's own heading, never those it cites."""
    at = F.instr(text, "Urteilskopf")
    marked = F.split(F.substring(text, at, F.length(text)), r"\n(?:Regeste|Regesto|Sachverhalt|Erwägungen)\b", 2)[0]
    heading = F.when(at > 0, marked).otherwise(F.split_part(text, F.lit("\n\n"), F.lit(1)))
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(heading, F.lit("")), F.lit(DOCKET), F.lit(1))))


def exact_reference(query: Column) -> Column:
    """Whether the query is nothing but one reference."""
    return F.trim(query).rlike(BARE_REFERENCE)
