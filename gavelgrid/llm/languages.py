"""Missing or wrong language labels, and the languages of mixed texts.

Method: hyperdimensional profiles. Every letter has a random vector of +1 and -1. An n-gram's vector binds (multiplies)
its letters' vectors, each permuted (rotated) by its place; a text's vector bundles (adds) its n-grams' vectors, a
language's prototype bundles the vectors of texts in that language. Texts and stretches are compared with the
prototypes by cosine.

Bundling is linear, so the product of a text with a prototype is the sum of the products of its n-grams. These are
tabulated once per n-gram and language (alphabet ** 3 rows, whatever the data), and the same table scores a whole text
and every word of it. The length of a text's vector, needed for the cosine, is taken as if different n-grams were
orthogonal, which random vectors of ``DIMS`` numbers are up to about ``1 / sqrt(DIMS)``.

Stretches: the word scores go through a Viterbi search in which a change of language costs as much as
``Params.switch_letters`` letters of average evidence, so quotations and names don't break a stretch.

Fitting: prototypes start from short word lists and are then bundled from a bounded sample of labelled texts
(``Params.fit_texts`` per label, by hash, none longer than ``Params.fit_length``). Labels may be wrong and texts mixed, so each stretch counts for the language
that the profiles of the round before hear in it, and only with a clear lead. Everything else runs over all texts, whole.

Defined cases: NULL, empty and letterless texts have no stretches and no language; letters outside the alphabet count
as blanks; fewer than ``min_letters`` letters are no case; equal scores go to the language first in ``LANGS``; without
any labelled text the word lists alone make the profiles.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelgrid.llm.proportions import language_of
from gavelgrid.operators.hashrank import hash_rank
from gavelgrid.sources.tables import require

LANGS = ("de", "fr", "it", "rm", "en")
ALPHABET = " abcdefghijklmnopqrstuvwxyzàâäáæçéèêëíîïìñóòôöœúùûüß'"
DIMS = 2048
GRID = 1_000_000  # words of the texts that are decoded together
# Frequent words the profiles start from.
SEED_WORDS = {
    "de": "der die das und nicht den dem mit auf von eine einer ist wird nach weil obwohl sich für werden bei aus oder auch dass zur zum über gegen durch kann hat haben wurde keine welche nur noch wenn als unter zwischen gericht urteil recht entscheid beschwerde",
    "fr": "le la les des une un est pas que dans pour du de bien été avait et qui par sur ne se ce cette au aux avec sont mais ou elle il nous être leur plus sans selon alors tandis puisque dès lors tribunal arrêt recours décision cour",
    "it": "il lo la gli le della del dei delle che non di una uno per dato perché aveva ha sono è con nel nella alla dal dalla come più anche essere stato questa questo secondo mentre poiché siccome visto tribunale sentenza ricorso decisione diritto",
    "rm": "ils las dals dal da betg cun dapi damai perquai ha entant che cunquai suenter il la en ed u na n'è era sun èn tgi quai quest questa tranter tar sin per mia memia pir gia vegn vegnì vegnida dretgira sentenzia recurs decisiun dretg onns onn",
    "en": "the of and to was that for although had because not a in is on by with as it be from this which or an are at has were their been but while since after would could under between court judgment appeal decision law right",
}
_CODES = np.zeros(0x250, dtype=np.int16)
for _i, _c in enumerate(ALPHABET):
    _CODES[ord(_c)] = _i


@dataclass(frozen=True)
class Params:
    fit_texts: int = 900  # labelled texts per label
    fit_length: int = 100_000  # characters of the longest text that is fitted on
    rounds: int = 2
    switch_letters: int = 30
    min_stretch: int = 100
    min_letters: int = 40
    sharpness: float = 40.0  # of the confidence
    seed: int = 11


def letters(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(codes, places): the text's letters with single blanks between words, and where each stands in the text."""
    points = np.frombuffer(text.replace("’", "'").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    low = np.where((points >= 65) & (points <= 90), points + 32, points)
    low = np.where((points >= 0xC0) & (points <= 0xDE) & (points != 0xD7), points + 32, low)
    codes = np.where(low < 0x250, _CODES[np.minimum(low, 0x24F)], 0)
    digit = (low >= 48) & (low <= 57)
    codes[(low == 39) & (np.concatenate([digit[1:], [False]]) | np.concatenate([[False], digit[:-1]]))] = 0  # 1'000
    keep = (codes > 0) | (np.concatenate([[1], codes[:-1]]) > 0)
    return codes[keep], np.flatnonzero(keep)


def trigrams(codes: np.ndarray) -> np.ndarray:
    padded = np.concatenate([[0], codes, [0]]).astype(np.int64)
    a = len(ALPHABET)
    return (padded[:-2] * a + padded[1:-1]) * a + padded[2:]


class Profiles:
    """Prototypes of the languages, as a table: product of every n-gram's vector with every prototype."""

    def __init__(self, weights: np.ndarray, seed: int) -> None:
        """``weights``: languages x alphabet ** 3, how strongly a language's prototype holds an n-gram."""
        a = len(ALPHABET)
        rng = np.random.default_rng(seed)
        base = rng.choice(np.array([-1, 1], dtype=np.int8), size=(a, DIMS)).astype(np.float32)
        first, second = np.roll(base, 2, axis=1), np.roll(base, 1, axis=1)
        cube = weights.reshape(len(weights), a, a, a).astype(np.float32)
        prototypes = np.zeros((len(weights), DIMS), dtype=np.float32)
        for x in range(a):
            for y in range(a):
                part = cube[:, x, y, :]
                if part.any():
                    prototypes += (part @ base) * (first[x] * second[y])
        prototypes -= prototypes.mean(axis=0)  # what all languages share tells none of them
        prototypes /= np.maximum(np.linalg.norm(prototypes, axis=1, keepdims=True), 1e-9)
        self.table = np.zeros((a, a, a, len(weights)), dtype=np.float32)
        for x in range(a):
            for y in range(a):
                self.table[x, y] = base @ (prototypes * (first[x] * second[y])).T
        self.table = self.table.reshape(-1, len(weights))
        self.evidence = 1.0

    def scores(self, codes: np.ndarray) -> np.ndarray:
        return self.table[trigrams(codes)]


def _weights(counts: np.ndarray) -> np.ndarray:
    share = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
    return np.sqrt(share)


def _viterbi(emissions: list[np.ndarray], cost: float) -> list[np.ndarray]:
    """Best language per word for many texts at once."""
    longest = max(map(len, emissions))
    n = emissions[0].shape[1]
    grid = np.zeros((len(emissions), longest, n), dtype=np.float32)
    for i, e in enumerate(emissions):
        grid[i, : len(e)] = e
    best = grid[:, 0].copy()
    back = np.zeros((len(emissions), longest, n), dtype=np.int8)
    rows = np.arange(len(emissions))
    for t in range(1, longest):
        top = best.argmax(axis=1)
        jump = best[rows, top] - cost
        stay = best >= jump[:, None]
        back[:, t] = np.where(stay, np.arange(n), top[:, None])
        best = np.where(stay, best, jump[:, None]) + grid[:, t]
    state = best.argmax(axis=1)
    path = np.zeros((len(emissions), longest), dtype=np.int8)
    for t in range(longest - 1, -1, -1):
        path[:, t] = state
        state = back[rows, t, state]
    return [path[i, : len(e)] for i, e in enumerate(emissions)]


def _decoded(texts: list[np.ndarray], profiles: Profiles, p: Params) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(number of the text, starts of its words, scores of its words, language of its words) of texts with letters."""
    work = []
    for i, codes in enumerate(texts):
        if not codes.any():
            continue
        blank = codes == 0
        word = np.cumsum(blank)  # a blank goes to the word after it
        if blank[-1]:
            word[-1] -= 1
        if blank[0]:
            word -= word[0]
        starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        work.append((i, starts, np.add.reduceat(profiles.scores(codes), starts, axis=0)))
    work.sort(key=lambda w: len(w[1]))
    at = 0
    while at < len(work):
        # as many texts of like length as fit a grid of GRID words; the longest alone if it has more
        size = next((n for n in (512, 128, 32, 8) if at + n <= len(work) and n * len(work[at + n - 1][1]) <= GRID), 1)
        group = work[at : at + size]
        at += size
        for (i, starts, sums), path in zip(group, _viterbi([w[2] for w in group], p.switch_letters * profiles.evidence)):
            yield i, starts, sums, path


def fit_profiles(texts: list[tuple[str, str]], p: Params = Params()) -> Profiles:
    """Profiles from (label, text) rows. A stretch counts for the language the round before hears in it, if the lead is
    clear; labels only chose the sample."""
    size = len(ALPHABET) ** 3
    seeds = np.stack([np.bincount(trigrams(letters(SEED_WORDS[lang])[0]), minlength=size) for lang in LANGS]).astype(float)
    sample = [codes for codes, _ in (letters(text) for _, text in texts) if np.count_nonzero(codes) >= p.min_letters]
    profiles = Profiles(_weights(seeds), p.seed)
    for turn in range(p.rounds + 1):
        counts, leads = seeds.copy(), []
        for i, starts, sums, path in _decoded(sample, profiles, p):
            edges = np.flatnonzero(np.concatenate([[True], path[1:] != path[:-1]]))
            for first, last in zip(edges, [*edges[1:], len(path)]):
                codes = sample[i][starts[first] : starts[last] if last < len(starts) else len(sample[i])]
                ranked = np.sort(sums[first:last].sum(axis=0))
                if np.count_nonzero(codes) >= p.min_letters and ranked[-1] - ranked[-2] > 0.25 * abs(ranked[-1]):
                    counts[path[first]] += np.bincount(trigrams(codes), minlength=size)
                    leads.append((ranked[-1] - ranked[-2]) / len(codes))
        evidence = float(np.median(leads)) if leads else profiles.evidence
        if turn == p.rounds:
            profiles.evidence = min(evidence, 2.0)
            break
        profiles = Profiles(_weights(counts), p.seed)
        profiles.evidence = min(evidence, 2.0)  # profiles of a few texts are surer than they should be
    return profiles


_BREAK = re.compile(r"[.;:!?»”\"][ \t\n]+(?=[A-ZÀ-Ý«])|\n\s*")


def _snapped(text: str, place: int, reach: int = 25) -> int:
    """The sentence or line start nearest to ``place``, if one is near: a change of language starts a sentence."""
    low = max(0, place - reach)
    ends = [m.end() for m in _BREAK.finditer(text, low, min(len(text), place + reach))]
    return min(ends, key=lambda e: (abs(e - place), e), default=place)


def stretches(texts: list[str | None], profiles: Profiles, p: Params) -> list[list[tuple[int, int, str, float, int]]]:
    """Per text: (char_start, char_end, language, confidence, letters) of every stretch."""
    found: list[list[tuple[int, int, str, float, int]]] = [[] for _ in texts]
    lettered = [letters(text or "") for text in texts]
    for i, starts, sums, path in _decoded([codes for codes, _ in lettered], profiles, p):
        codes, places = lettered[i]
        text = texts[i]
        edges = np.flatnonzero(np.concatenate([[True], path[1:] != path[:-1]]))
        cuts = [0, *[_snapped(text, int(places[starts[e] + (codes[starts[e]] == 0)])) for e in edges[1:]], len(text)]
        for number, (first, last) in enumerate(zip(edges, [*edges[1:], len(path)])):
            a, b = starts[first], starts[last] if last < len(starts) else len(codes)
            n_letters = int(np.count_nonzero(codes[a:b]))
            whole = text[cuts[number] : cuts[number + 1]]
            if not n_letters or not whole.strip():
                continue
            _, times = np.unique(trigrams(codes[a:b]), return_counts=True)
            cosine = sums[first:last].sum(axis=0) / np.sqrt(DIMS * np.square(times.astype(float)).sum())
            odds = np.exp(p.sharpness * (cosine - cosine.max()))
            lang = path[first]
            begin = cuts[number] + len(whole) - len(whole.lstrip())
            found[i].append((begin, begin + len(whole.strip()), LANGS[lang], float(odds[lang] / odds.sum()), n_letters))
    return found


STRETCH = "array<struct<char_start:int,char_end:int,language:string,confidence:float,letters:int>>"


def fit_on(table: DataFrame, key: str, label: str, text: str, p: Params = Params()) -> Profiles:
    """Profiles from a bounded sample: the ``fit_texts`` rows of each label with the lowest hash."""
    rows = require(table, **{key: "string", label: "string", text: "string"}).select(
        F.col(key).alias("k"), language_of(F.col(label)).alias("l"), F.col(text).alias("t")
    ).filter("k IS NOT NULL AND l IS NOT NULL AND t <> ''").filter(F.length("t") <= p.fit_length)
    quota = rows.select("k", "l").distinct().withColumn("quota", F.lit(p.fit_texts))
    picked = F.broadcast(hash_rank(quota, ["l"], "k", p.seed, quota="quota").select("k", "l"))  # fit_texts x languages
    sample = rows.join(picked, ["k", "l"]).groupBy("k", "l").agg(F.min("t").alias("t")).collect()  # one text per key
    return fit_profiles(sorted((r.l, r.t) for r in sample), p)


def identify(table: DataFrame, key: str, label: str, text: str, profiles: Profiles, p: Params = Params()) -> DataFrame:
    """(key, label, stretches, main_language, confidence, held, n_letters) of every row.

    ``label`` is the code of the stated language or NULL; ``held`` are the languages of stretches of at least
    ``min_stretch`` characters and the main language.
    """
    rows = require(table, **{key: "string", label: "string", text: "string"}).select(
        F.col(key).alias("k"), language_of(F.col(label)).alias("l"), F.col(text).alias("t")
    )
    shared = table.sparkSession.sparkContext.broadcast(profiles)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.iloc[at : at + 1024]
                found = stretches(part["t"].tolist(), shared.value, p)
                yield pd.DataFrame({"k": part["k"].to_numpy(), "l": part["l"].to_numpy(), "stretches": found})

    done = rows.mapInPandas(run, f"k string, l string, stretches {STRETCH}")
    def spoken(order: int, lang: str) -> Column:
        own = F.filter("stretches", lambda s: s["language"] == lang)
        return F.struct(F.aggregate(own, F.lit(0), lambda a, s: a + s["letters"]).alias("n"), F.lit(-order).alias("order"), F.lit(lang).alias("language"))

    per_language = F.array(*[spoken(order, lang) for order, lang in enumerate(LANGS)])
    top = F.array_max(per_language)
    n_letters = F.aggregate("stretches", F.lit(0), lambda a, s: a + s["letters"])
    main = F.when(top["n"] > 0, top["language"])
    # half of a stretch must be letters: a row of figures is in no language
    counts = lambda s: (s["char_end"] - s["char_start"] >= p.min_stretch) & (s["letters"] * 2 >= p.min_stretch)
    long = F.transform(F.filter("stretches", counts), lambda s: s["language"])
    weighed = F.aggregate(
        F.filter("stretches", lambda s: s["language"] == F.col("main_language")), F.lit(0.0), lambda a, s: a + s["confidence"] * s["letters"]
    )
    return (
        done.withColumn("main_language", main)
        .withColumn("n_letters", n_letters)
        .withColumn("confidence", F.when(top["n"] > 0, weighed / top["n"]))
        .withColumn("held", F.array_sort(F.array_distinct(F.array_compact(F.array_append(long, F.col("main_language"))))))
        .select(F.col("k").alias("key"), F.col("l").alias("label"), "stretches", "main_language", "confidence", "held", "n_letters")
    )


def label_cases(identified: DataFrame, p: Params = Params()) -> DataFrame:
    """(key, language): the languages held by rows whose label is missing, wrong or only one of several."""
    wrong = F.col("label").isNull() | (F.col("label") != F.col("main_language")) | (F.size("held") > 1)
    return identified.filter((F.col("n_letters") >= p.min_letters) & wrong).select("key", F.explode("held").alias("language")).distinct()
