"""Text rewriting that carries state from word to word: plain Python functions, and a wrapper that maps them over a
column in Arrow batches."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from gavelgrid.functions.references import CODES

# Names of the reporter per language.
REPORTERS = {"de": "BGE", "fr": "ATF", "it": "DTF"}
# Forms of the acts per language, where they differ.
ACTS = {
    "OR": {"de": "OR", "fr": "CO", "it": "CO"},
    "ZGB": {"de": "ZGB", "fr": "CC", "it": "CC"},
    "StGB": {"de": "StGB", "fr": "CP", "it": "CP"},
    "ZPO": {"de": "ZPO", "fr": "CPC", "it": "CPC"},
    "StPO": {"de": "StPO", "fr": "CPP", "it": "CPP"},
    "BGG": {"de": "BGG", "fr": "LTF", "it": "LTF"},
    "SchKG": {"de": "SchKG", "fr": "LP", "it": "LEF"},
}
_REFERENCE = re.compile(r"\bArt\.? ?\d+[a-z]?(?: (?:Abs|al|cpv)\. ?\d+)? [A-Z][A-Za-z]{1,8}\b|\b(?:BGE|ATF|DTF) \d{1,3} [IVX]+[ab]? \d+\b|\b\d{1,2}[A-Z][._]\d{1,5}/\d{4}\b")


def column_of(function: Callable[[str], str | None]) -> Callable[[Column], Column]:
    """The function as a column expression; NULL stays NULL."""

    @F.pandas_udf("string")
    def mapped(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else function(v))

    return mapped


def court_label(code: str | None, names: Mapping[str, str]) -> str:
    """Label of a court: its name, else that of its longest known prefix with the rest spelt out, else the code spelt out."""
    if not code:
        return ""
    if code in names:
        return names[code]
    spelt = lambda s: s.replace("_", " ").strip().title()
    for cut in range(len(code) - 1, 0, -1):
        if code[cut] == "_" and code[:cut] in names:
            return f"{names[code[:cut]]} {spelt(code[cut + 1 :])}".strip()
    return spelt(code)


def localise(text: str, language: str) -> str:
    """Acts and reporter names in the forms of one language. A form that stands for different acts is left alone, and
    so is a dot that ends the sentence."""
    forms: dict[str, set[str]] = {}
    for act, by_language in ACTS.items():
        for form in {*by_language.values(), *(f for f in CODES.get(act, ()) if f.isupper())}:
            forms.setdefault(form, set()).add(act)

    def swap(match: re.Match[str]) -> str:
        word, dot = match.group(1), match.group(2)
        if word in REPORTERS.values():
            return REPORTERS.get(language, word) + dot
        acts = forms.get(word, set())
        return (ACTS[next(iter(acts))].get(language, word) if len(acts) == 1 else word) + dot

    return re.sub(r"\b([A-Z][A-Za-z]{1,5})\b(\.?)", swap, text)


def rewrite_aliases(text: str, aliases: Mapping[str, str]) -> str:
    """Every alias in its official form, the longest first, whole words only, nothing twice."""
    if not aliases:
        return text
    pattern = "|".join(rf"\b{re.escape(a)}\b" for a in sorted(aliases, key=lambda a: (-len(a), a)))
    return re.sub(pattern, lambda m: aliases[m.group()], text)


def sanitised(original: str, translated: str) -> str:
    """A translated query without references the original lacks; those it lost are put at the end."""
    named = _REFERENCE.findall(original)
    kept = _REFERENCE.sub(lambda m: m.group() if m.group() in named else "", translated)
    kept = re.sub(r"\s{2,}", " ", kept).strip()
    lost = [r for r in dict.fromkeys(named) if r not in kept]
    return " ".join([kept, *lost]).strip()


def without_unknown_articles(text: str, facts: str) -> str:
    """Article mentions whose number doesn't occur in the facts are struck out."""
    known = set(re.findall(r"\d+[a-z]?", facts))
    strike = lambda m: m.group() if m.group(1) in known else ""
    out = re.sub(r"\s?\(?\bArt\.? ?(\d+[a-z]?)(?: (?:Abs|al|cpv)\. ?\d+)?(?: [A-Z][A-Za-z]{1,8})?\b\)?", strike, text)
    return re.sub(r" +([,.;:])", r"\1", re.sub(r"\s{2,}", " ", out)).strip()


def protected_phrases(text: str, phrases: Mapping[str, Iterable[str]]) -> dict[str, str]:
    """Phrases of a text that must not be translated, with their fixed translation; case aside."""
    low = text.lower()
    return {form: fixed for fixed, forms in phrases.items() for form in forms if re.search(rf"\b{re.escape(form.lower())}\b", low)}


def placeholders(text: str) -> tuple[str, dict[str, str]]:
    """References replaced by short marks that survive a translation, and what they stand for."""
    table: dict[str, str] = {}

    def mark(match: re.Match[str]) -> str:
        key = f"#{len(table)}#"
        table[key] = match.group()
        return key

    return _REFERENCE.sub(mark, text), table


def restored(text: str, table: Mapping[str, str]) -> str:
    return re.sub(r"# ?(\d+) ?#", lambda m: table.get(f"#{m.group(1)}#", ""), text)


def option_letters(question: str) -> list[str]:
    """Letters of a multiple-choice question: lines that start with A, B, C ... in order, three at least, and an
    instruction to choose; else none."""
    found = re.findall(r"(?m)^\s*\(?([A-H])[).:]\s", question)
    run = [c for i, c in enumerate(found) if c == chr(65 + i)]
    asks = re.search(r"(?i)\b(choose|answer|wähle|antwort|kreuze|choisi|répon|sceg|rispond)", question)
    return run if len(run) >= 3 and run == found[: len(run)] and asks else []


def search_terms(title: str, date: tuple[int, int, int] | None, most: int = 16) -> list[str]:
    """Words of an entry worth searching for, and the spellings of its date."""
    terms = [w for w in dict.fromkeys(re.findall(r"\w{4,}", title.lower()))]
    if date and date[0]:
        y, m, d = date
        spelt = [f"{d}.{m}.{y}", f"{d:02}.{m:02}.{y}", f"{y}-{m:02}-{d:02}"] if m and d else [f"{m:02}.{y}"] if m else []
        terms = [*spelt, str(y), *terms]
    return terms[:most]


def renumbered(texts: list[str]) -> list[str]:
    """Markers ``[1]``, ``[2]`` ... of each text as one running series over all of them, none replaced twice."""
    out, offset = [], 0
    for text in texts:
        numbers = [int(n) for n in re.findall(r"\[(\d+)\]", text)]
        out.append(re.sub(r"\[(\d+)\]", lambda m, o=offset: f"[{int(m.group(1)) + o}]", text))
        offset += max(numbers, default=0)
    return out


def statements(question: str) -> list[tuple[str, str]]:
    """(number, text) of the numbered statements of a question, Roman or Arabic."""
    parts = re.split(r"(?m)^\s*\(?((?:[ivx]+|\d+))[).]\s+", question)
    return [(parts[i], parts[i + 1].strip()) for i in range(1, len(parts) - 1, 2)]


def option_statements(option: str, numbers: Iterable[str]) -> set[str]:
    """Statements an answer option names: a list, a range, all or none."""
    ordered = list(numbers)
    low = option.lower()
    if re.search(r"\b(all|alle|toutes|tutte)\b", low):
        return set(ordered)
    if re.search(r"\b(none|keine|aucune|nessuna)\b", low):
        return set()
    span = re.search(r"\b(\w+)\s*(?:-|–|bis|to|à)\s*(\w+)\b", low)
    if span and span.group(1) in ordered and span.group(2) in ordered:
        return set(ordered[ordered.index(span.group(1)) : ordered.index(span.group(2)) + 1])
    return {n for n in ordered if re.search(rf"\b{re.escape(n)}\b", low)}


def truth_key(correct: set[str], numbers: Iterable[str], negated: bool) -> dict[str, bool]:
    """Which statements are true, given the right option; a question for the wrong ones is turned around."""
    return {n: (n in correct) != negated for n in numbers}


def statement_scores(said: Mapping[str, bool], truth: Mapping[str, bool]) -> tuple[float, float]:
    """(share judged rightly, share judged at all)."""
    judged = [n for n in truth if n in said]
    right = sum(said[n] == truth[n] for n in judged)
    return (right / len(truth), len(judged) / len(truth)) if truth else (0.0, 0.0)


def recovered_json(text: str) -> dict:
    """A JSON object from model output: as it is, else between the outermost braces, else its complete leading fields."""
    body = text.strip().removeprefix("```json").removeprefix("```").removesuffix("```").strip()
    for part in (body, body[body.find("{") : body.rfind("}") + 1]):
        try:
            value = json.loads(part)
            return value if isinstance(value, dict) else {}
        except ValueError:
            continue
    head = body[body.find("{") :] if "{" in body else ""
    for cut in [m.start() for m in re.finditer(r",", head)][::-1]:
        try:
            return json.loads(head[:cut] + "}")
        except ValueError:
            continue
    return {}


def file_name(path: str) -> str:
    """A safe name from a path or URL."""
    name = re.split(r"[\\/]", path.split("?")[0])[-1]
    return re.sub(r"[^\w.\-]+", "_", name).strip("._") or "file"


def duration(seconds: float) -> str:
    hours, rest = divmod(int(round(seconds)), 3600)
    minutes, left = divmod(rest, 60)
    return f"{hours}:{minutes:02}:{left:02}" if hours else f"{minutes}:{left:02}"


def memo(title: str, sections: list[tuple[str, list[str]]], sources: list[str]) -> str:
    """A memo in Markdown with one series of source numbers."""
    texts = renumbered([p for _, paragraphs in sections for p in paragraphs])
    out, at = [f"# {title}"], 0
    for heading, paragraphs in sections:
        out.append(f"## {heading}")
        out += texts[at : at + len(paragraphs)]
        at += len(paragraphs)
    if sources:
        out.append("\n".join(f"[{i}] {s}" for i, s in enumerate(sources, 1)))
    return "\n\n".join(out)
