"""Scores for abusive, hateful and sexual content.

Method: class-conditional Kneser-Ney models. Two character models, toxic and ordinary, are interpolated Kneser-Ney
models of their own counts down to order ``SHARED + 1``; below that both back off to the continuation counts of all
texts together, so rare expressions are smoothed alike and only evidence of a class tells the classes apart. A sentence
scores the difference of its two log-likelihoods by its length (or that of its most toxic stretch of ``Params.window``
signs), a document its most toxic sentence.

Fitting: on a bounded sample of labelled documents (``Params.fit_toxic`` and ``Params.fit_ordinary`` by hash, none longer
than ``Params.fit_length``). Labels
are for documents and may be wrong, so which sentences are toxic is learned in rounds: sentences of documents labelled
toxic that the round before does not find toxic leave the toxic class, and toxic ones of documents labelled ok leave
the ordinary class. Everything else runs over all documents, whole.

Disguises are undone before anything is counted: invisible characters, digits and signs for letters, spelt-out and
stretched words, look-alike letters. Figures become ``0``, or ``00`` from three signs on.

Defined cases: NULL and empty texts score 0; documents rated twice count as toxic if most ratings say so (a tie does
not); with labels of only one class every score is 0; unknown labels other than ``ok`` count as toxic; NULL labels are
dropped.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavelgrid.operators.hashrank import hash_rank
from gavelgrid.sources.tables import require

SIGNS = "\x00 abcdefghijklmnopqrstuvwxyzàâäçéèêëîïìíñòôöùúûüß0.,;:!?'«*>-()"
_BITS = 6
ORDER, SHARED = 7, 3  # longest n-gram; orders up to SHARED are counted for both classes together


@dataclass(frozen=True)
class Params:
    fit_toxic: int = 2500  # labelled documents
    fit_ordinary: int = 5000
    fit_length: int = 100_000  # characters of the longest text that is fitted on
    rounds: int = 3
    noise: float = 0.06  # wrong labels the first models allow for
    clean: float = 0.2  # sentences from this score on count as toxic while fitting
    repeated: int = 3  # sentences seen so often are judged by their labels while fitting, where these are clear
    threshold: float = 0.47  # documents from this score on are toxic
    padding: int = 16  # added to a sentence's length
    window: int = 64  # signs of the stretches of a long sentence
    seed: int = 3


# Signs written for letters, and letters of other scripts that look like Latin ones.
_LEET = str.maketrans("0134578@$!€", "oieastbasie")
_LOOKALIKE = str.maketrans("аеорсухіѕјһԁԛԝο", "aeopcyxisjhdqwo")
_FOREIGN = re.compile("[" + "".join(map(chr, _LOOKALIKE)) + "]")
_INVISIBLE = re.compile("[\x00­​-‏⁠﻿̀-ͯ]")
_DISGUISED = re.compile(r"(?<![\w@$])(?=[\w@$!€]*[a-zà-ÿ][\w@$!€]*[a-zà-ÿ])(?=[\w@$!€]*[0-9@$€!][\w@$!€]*[a-zà-ÿ0-9])[\w@$!€]*[\w@$€]")
_SPELT = re.compile(r"(?<!\w)(?:[a-zà-ÿ][ .\-_*·]){3,}[a-zà-ÿ](?!\w)")
_FIGURE = re.compile(r"[0-9](?:[0-9'.,]*[0-9])?")
# a dot after a short figure counts (3. May), after a long one it ends a sentence (in 2004.)
_SENTENCE = re.compile(r"(?:(?<=[^\d\s][.!?;])|(?<=00[.!?;]))\s+(?=[^\d\s])|\n+\s*")
_CODES = np.full(0x250, SIGNS.index("-"), dtype=np.int64)
for _i, _c in enumerate(SIGNS):
    _CODES[ord(_c)] = _i
_CODES[ord("»")] = SIGNS.index("«")
for _c in '"“”„‹›':
    if ord(_c) < 0x250:
        _CODES[ord(_c)] = SIGNS.index("«")


def plain(text: str) -> str:
    """The text in lower case, with disguises undone and figures as ``0``."""
    low = _INVISIBLE.sub("", text).lower()
    if _FOREIGN.search(low):
        low = low.translate(_LOOKALIKE)
    low = re.sub("[“”„‹›]", "«", low).replace("’", "'").replace("–", "-")
    low = _SPELT.sub(lambda m: re.sub(r"[ .\-_*·]", "", m.group()), low)
    low = _DISGUISED.sub(lambda m: m.group().translate(_LEET), low)
    low = re.sub(r"([^\d\s])\1{2,}", r"\1", low)
    return _FIGURE.sub(lambda m: "0" if len(m.group()) < 3 else "00", low)


def sentences(text: str) -> list[str]:
    return [s for s in (part.strip(" \t>") for part in _SENTENCE.split(plain(text))) if s]


def _codes(parts: list[str]) -> np.ndarray:
    """Codes of the signs, 0 at the start of each sentence."""
    joined = "\x00".join(["", *parts])
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where(points < 0x250, _CODES[np.minimum(points, 0x24F)], SIGNS.index("-"))


def _grams(codes: np.ndarray, order: int) -> np.ndarray:
    """Codes of the n-grams that end at each place; letters before a sentence's start count as its start sign."""
    start = np.maximum.accumulate(np.where(codes == 0, np.arange(len(codes)), 0))
    gram = np.zeros(len(codes), dtype=np.int64)
    for back in range(order - 1, -1, -1):
        at = np.maximum(np.arange(len(codes)) - back, start)
        gram = (gram << _BITS) | codes[at]
    return gram


def _merged(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams in order, with their counts summed."""
    if not len(grams):
        return grams, counts
    order = np.argsort(grams)
    grams, counts = grams[order], counts[order]
    edge = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    return grams[edge], np.add.reduceat(counts, edge)


def _counted(parts: Counter[str], order: int, step: int = 5000) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of the sentences and their counts, a bounded number of distinct sentences at a time."""
    grams, counts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    items = list(parts.items())
    for at in range(0, len(items), step):
        codes = _codes([sentence for sentence, _ in items[at : at + step]])
        times = np.array([n for _, n in items[at : at + step]], dtype=np.int64)[np.cumsum(codes == 0) - 1]
        inside = codes > 0
        grams, counts = _merged(np.concatenate([grams, _grams(codes, order)[inside]]), np.concatenate([counts, times[inside]]))
    return grams, counts


def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), missing)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], missing)


class Places:
    """Place of a key in a list of distinct keys, its length for any other: a table for small keys, else hashed."""

    _FACTOR = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, keys: np.ndarray, order: int) -> None:
        n = len(keys)
        self.direct = np.full(1 << (_BITS * order), n, dtype=np.int32) if order <= 3 else None
        if self.direct is not None:
            self.direct[keys] = np.arange(n)
            return
        self.keys = np.append(keys, -1)
        bits = max(4, int(n).bit_length() + 1)
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slots = np.full(1 << bits, n, dtype=np.int32)
        left, at = np.arange(n), self._hash(keys)
        while len(left):
            free = self.slots[at] == n
            self.slots[at[free]] = left[free]  # the last of several stays
            left, at = (x[self.slots[at] != left] for x in (left, at))
            at = (at + 1) & self.mask

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * self._FACTOR) >> self.shift).astype(np.int64)

    def of(self, wanted: np.ndarray) -> np.ndarray:
        if self.direct is not None:
            return self.direct[wanted]
        at = self._hash(wanted)
        found = self.slots[at]
        missing = len(self.keys) - 1
        left = np.flatnonzero((self.keys[found] != wanted) & (found != missing))
        while len(left):
            at[left] = (at[left] + 1) & self.mask
            found[left] = self.slots[at[left]]
            left = left[(self.keys[found[left]] != wanted[left]) & (found[left] != missing)]
        return found


class Level:
    """Discounted shares of the n-grams of one order and the weight of backing off, per context."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray) -> None:
        ones, twos = (counts == 1).sum(), (counts == 2).sum()
        discount = ones / (ones + 2 * twos) if ones and twos else 0.5
        context = grams >> _BITS
        edge = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(grams) else np.zeros(0, dtype=np.int64)
        self.contexts = context[edge]
        totals = np.add.reduceat(counts, edge) if len(grams) else np.zeros(0)
        kinds = np.diff(np.concatenate([edge, [len(grams)]]))
        self.backoff = discount * kinds / np.maximum(totals, 1)
        self.grams = grams
        self.share = (counts - discount) / np.repeat(totals, kinds) if len(grams) else np.zeros(0)


class Table:
    """One order of both classes: per n-gram its discounted shares, and its weights of backing off as a context.

    A context of the next order is an n-gram of this order that ends one sign earlier, so one lookup per sign and order
    serves both.
    """

    def __init__(self, order: int, own: list[Level], following: list[Level] | None) -> None:
        keys = np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *[level.grams for level in own], *[level.contexts for level in following or []]]))
        last = np.zeros(1)  # the row of an unseen n-gram
        self.places = Places(keys, order)
        self.shares = [np.append(_find(level.grams, level.share, keys, 0.0), last).astype(np.float32) for level in own]
        self.backoffs = [np.append(_find(level.contexts, level.backoff, keys, 1.0), last + 1).astype(np.float32) for level in following or own]


def _levels(counted: tuple[np.ndarray, np.ndarray], orders: range) -> list[Level]:
    """Kneser-Ney levels: raw counts at the top, continuation counts (distinct letters in front) below."""
    made = [Level(*counted)]
    for order in reversed(orders[:-1]):
        lower = made[-1].grams & ((1 << (_BITS * order)) - 1)
        made.append(Level(*_merged(lower, np.ones(len(lower), dtype=np.int64))))
    return made[::-1]


def _without_noise(own: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray], noise: float) -> tuple[np.ndarray, np.ndarray]:
    """Counts less what wrong labels would bring over from the other class, at the same size of both classes."""
    (grams, counts), (theirs, their_counts) = own, other
    foreign = _find(theirs, their_counts, grams, 0) * (noise * counts.sum() / max(1, their_counts.sum()))
    left = np.ceil(counts - foreign).astype(np.int64)
    keep = left > 0
    return grams[keep], left[keep]


class ToxicityModel:
    """Score of a sentence: length-normalised difference of toxic and ordinary log-likelihood."""

    def __init__(self, toxic: Counter[str], ordinary: Counter[str], p: Params, noise: float = 0.0) -> None:
        self.padding, self.window = p.padding, p.window
        self.usable = bool(toxic) and bool(ordinary)
        if self.usable:
            orders = range(SHARED + 1, ORDER + 1)
            yes, no = _counted(toxic, ORDER), _counted(ordinary, ORDER)
            if noise:
                yes, no = _without_noise(yes, no, noise), _without_noise(no, yes, noise)
            shared = [[level] for level in _levels(_counted(toxic + ordinary, SHARED), range(1, SHARED + 1))]
            levels = shared + [list(pair) for pair in zip(_levels(yes, orders), _levels(no, orders))]
            self.tables = [Table(order, own, following) for order, (own, following) in enumerate(zip(levels, [*levels[1:], None]), 1)]
            self.root = [float(level.backoff[0]) if len(level.backoff) else 1.0 for level in levels[0]]
            self.usable = bool(len(yes[0])) and bool(len(no[0]))

    def scores(self, parts: list[str]) -> np.ndarray:
        if not parts or not self.usable:
            return np.zeros(len(parts))
        codes = _codes(parts)
        place = np.arange(len(codes))
        first = np.maximum.accumulate(np.where(codes == 0, place, 0))
        grams = np.zeros(len(codes), dtype=np.int64)
        chance = [np.full(len(codes), self.root[0] / len(SIGNS))]
        before: np.ndarray | None = None
        for order, table in enumerate(self.tables, 1):
            grams |= codes[np.maximum(place - order + 1, first)] << (_BITS * (order - 1))
            rows = table.places.of(grams)
            if order == 1:
                chance = [chance[0] + table.shares[0][rows]]
            else:
                weights = [w[before] for w in self.tables[order - 2].backoffs]
                chance = chance * (len(weights) // len(chance))
                chance = [share[rows] + weight * below for share, weight, below in zip(table.shares, weights, chance)]
            before = np.concatenate([rows[:1], rows[:-1]])
        a, b = chance
        ratio = np.where(codes > 0, np.log(np.maximum(a, 1e-12)) - np.log(np.maximum(b, 1e-12)), 0.0)
        starts = np.flatnonzero(codes == 0)
        ends = np.concatenate([starts[1:], [len(codes)]])
        running = np.concatenate([[0.0], np.cumsum(ratio)])
        whole = (running[ends] - running[starts]) / (ends - starts - 1 + self.padding)
        # the best stretch of ``window`` signs inside a longer sentence
        stretch = np.full(len(codes), -np.inf)
        inside = np.flatnonzero(place + self.window <= np.repeat(ends, ends - starts))
        stretch[inside] = (running[inside + self.window] - running[inside]) / (self.window + self.padding)
        return np.maximum(whole, np.maximum.reduceat(stretch, starts))


def fit_model(rows: list[tuple[bool, str]], p: Params = Params()) -> ToxicityModel:
    """From (labelled toxic, text) rows. Repeated sentences are counted, and read and scored once."""
    parts: dict[bool, Counter[str]] = {True: Counter(), False: Counter()}
    for label, text in rows:
        parts[label].update(sentences(text))
    totals = {label: max(1, sum(own.values())) for label, own in parts.items()}
    model = ToxicityModel(parts[True], parts[False], p, p.noise)

    def is_toxic(sentence: str, value: float, limit: float) -> bool:
        """What the labels say of a sentence that is often repeated, else what the model says."""
        yes, no = parts[True][sentence] / totals[True], parts[False][sentence] / totals[False]
        if parts[True][sentence] + parts[False][sentence] >= p.repeated and not no * 6 < yes < no * 12:
            return yes > no * 6  # greetings and the like are a few times more usual where people insult
        return value >= limit

    distinct = list(parts[True] | parts[False])
    for turn in range(p.rounds if model.usable else 0):
        limit = p.clean * (turn + 1) / p.rounds  # the first models still mix the classes
        high = {s: is_toxic(s, v, limit) for s, v in zip(distinct, _scored(model, distinct))}
        toxic = Counter({s: n for s, n in parts[True].items() if high[s]})
        ordinary = Counter({s: n for s, n in parts[False].items() if not high[s]})
        if not toxic or not ordinary:
            break
        del model
        model = ToxicityModel(toxic, ordinary, p)
    return model


def _scored(model: ToxicityModel, parts: list[str], step: int = 4000) -> np.ndarray:
    return np.concatenate([np.zeros(0), *[model.scores(parts[at : at + step]) for at in range(0, len(parts), step)]])


class SentenceScores:
    """Scores of sentences; those that come again are looked up among the last ``most``."""

    def __init__(self, model: ToxicityModel, most: int = 200_000) -> None:
        self.model, self.most, self.known = model, most, {}

    def of_documents(self, texts: list[str | None]) -> list[float]:
        """Per text the score of its most toxic sentence."""
        parts = [sentences(t) if t else [] for t in texts]
        fresh = list({s for own in parts for s in own if s not in self.known})
        if len(self.known) + len(fresh) > self.most:
            self.known = {}
            fresh = list({s for own in parts for s in own})
        self.known.update(zip(fresh, _scored(self.model, fresh).tolist()))
        return [max(map(self.known.__getitem__, own)) if own else 0.0 for own in parts]


def document_scores(model: ToxicityModel, texts: list[str | None]) -> list[float]:
    return SentenceScores(model).of_documents(texts)


def fit_on(documents: DataFrame, labels: DataFrame, p: Params = Params()) -> ToxicityModel:
    """The model from a bounded sample of the labelled documents."""
    rated = require(labels, doc_id="bigint", label="string").filter("doc_id IS NOT NULL AND label IS NOT NULL")
    toxic = F.lower(F.trim("label")) != "ok"
    votes = rated.groupBy("doc_id").agg(F.avg(toxic.cast("int")).alias("share")).select("doc_id", (F.col("share") > 0.5).alias("toxic"))
    quota = votes.withColumn("quota", F.when(F.col("toxic"), F.lit(p.fit_toxic)).otherwise(F.lit(p.fit_ordinary)))
    picked = F.broadcast(hash_rank(quota, ["toxic"], "doc_id", p.seed, quota="quota").select("doc_id", "toxic"))  # the two quotas
    texts = require(documents, doc_id="bigint", text="string").filter("text <> ''").filter(F.length("text") <= p.fit_length).join(picked, "doc_id")
    rows = texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()  # one text per document of the quotas
    return fit_model([(r.toxic, r.text) for r in sorted(rows, key=lambda r: (r.doc_id, r.text))], p)


def score(documents: DataFrame, model: ToxicityModel, p: Params = Params()) -> DataFrame:
    """(doc_id, source, score, toxic) of every document."""
    rows = require(documents, doc_id="bigint", source="string", text="string")
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = SentenceScores(shared.value)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at : at + 256]
                yield part[["doc_id", "source"]].assign(score=known.of_documents(part["text"].tolist()))

    scored = rows.mapInPandas(run, "doc_id bigint, source string, score double")
    return scored.withColumn("toxic", F.col("score") >= p.threshold)


def rates(scored: DataFrame) -> DataFrame:
    """(source, documents, toxic, rate): rates per source."""
    return scored.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.count_if("toxic").alias("toxic")).withColumn("rate", F.round(F.col("toxic") / F.col("documents"), 6))
