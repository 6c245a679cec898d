"""Evaluation texts that leaked into documents.

Method: a distributed positional inverted index. Its terms are the pairs of neighbouring words that occur in a test
text. One pass over the documents stores, per document, the postings of these terms: which term stands at which place.
The index is cut by documents, so a term's postings lie in all parts of it and no list is ever in one task. Everything
else reads the stored index: first the counts of the terms, then the search.

1. Every window of ``Params.window`` terms of a test text is looked up by its rarest terms; their lists are intersected
   after subtracting the term's place in the test text, and every hit is followed along its diagonal to the longest exact
   phrase around it.
2. A document is compared with a test text if such phrases of neighbouring diagonals add up to ``Params.hint`` of the
   words a passage needs, or those of all diagonals (copies in several pieces) to ``Params.hint_share`` of the test text.
   Any copy of ``2 * window`` consecutive words holds a whole window and thus its rarest terms: none of ``Params.passage``
   words or more is missed.
3. Compared are all postings the two have in common: consecutive ones on a diagonal are exact phrases, phrases that lie
   near each other (proximity) make a passage, the passages of a document are chained in the test text's order, and the
   share of the test text they span decides. Passages too short to count alone count in a chain that spans
   ``min_share`` of the test text.

The test texts are a query set: they are taken in blocks of about ``Params.block`` characters, each searched for in all
documents. A block's terms, their counts (one row a term) and its lookups are all that is sent to driver and executors.

Words: lower case, accents and ``ß`` folded, words cut by a hyphen at a line end joined, separators inside figures,
invisible characters and underscores dropped.

Defined cases: NULL and empty documents or test texts match nothing; a test text shorter than two words is never
looked up; ``question`` and ``reference`` are test texts of their own; repeated documents each come out, repeated rows
once; a document holds an item if one of its test texts is held.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavelgrid.llm.storage import stored
from gavelgrid.sources.tables import require

# Letters with marks and what they are folded to.
MARKED = "àâäáãåçèéêëìíîïñòóôöõùúûüýÿšž"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyysz"
_FOLD = str.maketrans({**dict(zip(MARKED, PLAIN)), "ß": "ss", "œ": "oe", "æ": "ae"})
_INVISIBLE = re.compile("[̀-ͯ\xad​‌‍⁠﻿]")
_BROKEN = re.compile("[-‐‑](?<=[^\\W\\d_].)[ \\t]*\\r?\\n[ \\t]*(?=[^\\W\\d_])")
_SEPARATOR = re.compile("['’., \xa0](?<=[0-9].)(?=[0-9])")
_WORD = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class Params:
    window: int = 10  # terms of a test text per lookup
    terms: int = 2  # rarest terms a window is looked up by
    diagonal: int = 32  # width of a band of neighbouring diagonals
    hint: float = 0.8  # of the words of a passage, in phrases around hits on neighbouring diagonals
    hint_share: float = 0.3  # of the words of the test text, in phrases of ``hint_words`` around hits on any diagonals
    hint_words: int = 6
    min_share: float = 0.5  # of the test text
    phrase: int = 3  # words of the shortest exact phrase
    gap: int = 4  # words that may differ between two phrases of a passage
    passage: int = 20  # matching words a passage, or a chain of pieces, needs; less is a usual phrase
    piece: int = 16  # matching words of the shortest piece of a chain
    near_piece: int = 8  # the same where the pieces of a chain follow each other in the document
    near: int = 100  # words of the document between two such pieces
    block: int = 4_000_000  # characters of test texts searched for at once


def raw_words(text: str) -> list[str]:
    low = _INVISIBLE.sub("", text.lower())
    return _WORD.findall(_SEPARATOR.sub("", _BROKEN.sub("", low)))


def folded_words(text: str) -> list[str]:
    return [w.translate(_FOLD) for w in raw_words(text)]


class _WordNumbers(dict):
    """Number of a raw word: that of its folded form in the test texts, 0 if it has none. Remembers bounded many."""

    def __init__(self, known: dict[str, int], most: int = 1 << 20) -> None:
        self.known, self.most = known, most

    def __missing__(self, raw: str) -> int:
        if len(self) >= self.most:
            self.clear()
        self[raw] = number = self.known.get(raw.translate(_FOLD), 0)
        return number


class Terms:
    """The terms of a block of test texts: numbers for words and for pairs of neighbouring words."""

    def __init__(self, texts: list[list[str]]) -> None:
        self.words: dict[str, int] = {}
        numbers = [np.array([self.words.setdefault(w, len(self.words) + 1) for w in text], dtype=np.int64) for text in texts]
        self.base = len(self.words) + 1
        pairs = [n[:-1] * self.base + n[1:] for n in numbers]
        self.pairs = np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *pairs]))
        self.sizes = np.array([len(n) for n in numbers], dtype=np.int64)  # words of each text
        # the terms of all texts in order, with a place that matches nothing before and after each
        self.start = np.concatenate([[1], 1 + np.cumsum(self.sizes)])[: len(texts)]
        self.flat = np.full(int(self.sizes.sum()) + 2, -2, dtype=np.int32)
        for at, own in zip(self.start, pairs):
            self.flat[at : at + len(own)] = np.searchsorted(self.pairs, own)
        # places of a term in a text, by text * number of terms + term
        text = np.repeat(np.arange(len(texts)), self.sizes)
        place = np.arange(len(text)) - np.repeat(self.start - 1, self.sizes)
        term = self.flat[1:-1][: len(text)].astype(np.int64)
        held = term >= 0
        keys = text[held] * len(self.pairs) + term[held]
        order = np.argsort(keys, kind="stable")
        self.keys, first = np.unique(keys[order], return_index=True)
        self.first = np.append(first, len(keys))
        self.bounds = np.searchsorted(self.keys, np.arange(len(texts) + 1) * len(self.pairs))  # keys of each text
        self.places = place[held][order]

    def postings(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, terms) of a sequence of word numbers."""
        live = np.flatnonzero((words[:-1] > 0) & (words[1:] > 0))
        pairs = words[live] * self.base + words[live + 1]
        at = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
        held = self.pairs[at] == pairs
        return live[held].astype(np.int32), at[held].astype(np.int32)


def _slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes add up to about ``most``."""
    first, total = 0, 0
    for i, size in enumerate(sizes):
        total += size
        if total >= most:
            yield first, i + 1
            first, total = i + 1, 0
    if first < len(sizes):
        yield first, len(sizes)


def build_index(documents: DataFrame, terms: Terms) -> DataFrame:
    """(doc_id, places, terms): the postings of every document that has any, as packed int32."""
    shared = documents.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        number = _WordNumbers(known.words).__getitem__
        for batch in batches:
            texts, ids = batch["text"].tolist(), batch["doc_id"].to_numpy()
            for a, b in _slices([len(t) for t in texts], 4_000_000):
                split = [list(map(number, raw_words(t))) for t in texts[a:b]]
                starts = np.cumsum([0, *[len(w) + 1 for w in split]])
                words = np.zeros(starts[-1] + 1, dtype=np.int64)  # a 0 after each document
                for at, own in zip(starts, split):
                    words[at : at + len(own)] = own
                places, found = known.postings(words)
                cuts = np.searchsorted(places, starts)
                rows = [k for k in range(b - a) if cuts[k + 1] > cuts[k]]
                yield pd.DataFrame({
                    "doc_id": ids[a:b][rows],
                    "places": [(places[cuts[k] : cuts[k + 1]] - starts[k]).astype(np.int32).tobytes() for k in rows],
                    "terms": [found[cuts[k] : cuts[k + 1]].tobytes() for k in rows],
                })

    rows = require(documents, doc_id="bigint", text="string").filter("doc_id IS NOT NULL AND text <> ''")
    return rows.mapInPandas(run, "doc_id bigint, places binary, terms binary")


def term_counts(index: DataFrame, terms: int) -> np.ndarray:
    """Postings of every term, over all documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(terms, dtype=np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch["terms"]), dtype=np.int32), minlength=terms)
        live = np.flatnonzero(total)
        yield pd.DataFrame({"term": live.astype(np.int32), "n": total[live]})

    counted = index.select("terms").mapInPandas(run, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    counts = np.zeros(terms, dtype=np.int64)
    for row in counted.collect():  # at most one row per term of the block
        counts[row.term] = row.n
    return counts


class Lookups:
    """The rarest terms of every window of the test texts, by term."""

    def __init__(self, terms: Terms, counts: np.ndarray, p: Params) -> None:
        text, place, term = [], [], []
        for number, (start, size) in enumerate(zip(terms.start, terms.sizes)):
            own = terms.flat[start : start + size - 1]
            at = np.flatnonzero(counts[own] > 0)
            if not len(at):
                continue
            at = at[np.lexsort((at, counts[own[at]], at // p.window))]  # by window, rarest first
            first = np.flatnonzero(np.concatenate([[True], np.diff(at // p.window) > 0]))
            rank = np.arange(len(at)) - np.repeat(first, np.diff([*first, len(at)]))
            at = at[rank < p.terms]
            text.append(np.full(len(at), number))
            place.append(at)
            term.append(own[at])
        join = lambda parts: np.concatenate([np.zeros(0, dtype=np.int64), *parts]).astype(np.int64)
        order = np.argsort(join(term), kind="stable")
        self.text, self.place = join(text)[order], join(place)[order]
        self.first = np.searchsorted(join(term)[order], np.arange(len(counts) + 1))


def _expand(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every number in [low, high) of every row: (row, number)."""
    n = high - low
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + low[row]


def _followed(document: np.ndarray, at: np.ndarray, text: np.ndarray, place: np.ndarray, step: int) -> np.ndarray:
    """How many terms after those at ``at`` and ``place`` agree, one step after the other."""
    n = np.zeros(len(at), dtype=np.int64)
    live = np.arange(len(at))
    while len(live):
        at, place = at + step, place + step
        same = document[at] == text[place]
        live, at, place = live[same], at[same], place[same]
        n[live] += 1
    return n


def _sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct key, sum of its values)."""
    distinct, group = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(group, weights=values, minlength=len(distinct))


def candidates(document: np.ndarray, place: np.ndarray, term: np.ndarray, terms: Terms, lookups: Lookups, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, text) numbers to be compared, of postings sorted by document and place."""
    last = np.flatnonzero(np.concatenate([document[1:] != document[:-1], [True]]))[: len(document)]
    length = np.zeros(int(document[-1]) + 1 if len(document) else 0, dtype=np.int64)
    length[document[last]] = place[last] + 2
    offset = np.cumsum(length) - length + 1
    dense = np.full(int(length.sum()) + 2, -1, dtype=np.int32)
    dense[offset[document] + place] = term
    posting, look = _expand(lookups.first[term], lookups.first[term + 1])
    text = lookups.text[look]
    at, there = offset[document[posting]] + place[posting], terms.start[text] + lookups.place[look]
    before = _followed(dense, at, terms.flat, there, -1)
    words = before + _followed(dense, at, terms.flat, there, 1) + 2
    start, there = at - before, there - before
    _, once = np.unique(start * len(terms.flat) + there, return_index=True)  # one row per phrase
    once = once[words[once] >= p.phrase] if p.phrase > 2 else once
    short = np.flatnonzero(terms.sizes[text] < p.phrase)  # test texts shorter than a phrase
    once = np.union1d(once, short)
    d, t, words = document[posting[once]], text[once], words[once]
    shift = (start[once] - offset[d]) - (there[once] - terms.start[t])
    shift -= shift.min(initial=0)
    pair = d * len(terms.sizes) + t
    width = int(shift.max(initial=0)) // p.diagonal + 2
    chosen = []
    least = p.hint * _needed(terms.sizes, p)
    for half in (0, p.diagonal // 2):
        keys, total = _sums(pair * width + (shift + half) // p.diagonal, words)
        chosen.append(keys[total >= least[keys // width % len(terms.sizes)]] // width)
    keys, total = _sums(pair, np.where(words >= p.hint_words, words, 0))
    chosen.append(keys[total >= p.hint_share * terms.sizes[keys % len(terms.sizes)]])
    pairs = np.unique(np.concatenate(chosen))
    d, t = pairs // len(terms.sizes), pairs % len(terms.sizes)
    by = np.argsort(t, kind="stable")  # so that a text's terms are looked up one after the other
    return d[by], t[by]


def _needed(sizes: np.ndarray, p: Params) -> np.ndarray:
    """Matching words a passage of a test text needs."""
    return np.minimum(p.passage, np.maximum(np.minimum(p.phrase, sizes), -(-sizes // 2)))


def _chain(runs: list[list[int]], near: int | None = None) -> tuple[int, int]:
    """(words spanned, words matched) of the best chain of sorted passages in the order of the test text, its links at
    most ``near`` words of the document apart."""
    if len(runs) < 2:
        return (runs[0][1] - runs[0][0], runs[0][4]) if runs else (0, 0)
    a, b, c, d, n = (np.array(x, dtype=np.int64) for x in zip(*runs))
    spanned, matched = b - a, n.copy()
    for k in range(1, len(runs)):
        overlap = np.maximum(0, b[:k] - a[k])
        links = (a[:k] < a[k]) & (c[:k] < c[k]) & (overlap < b[k] - a[k])
        if near is not None:
            links &= c[k] - d[:k] <= near
        at = links.nonzero()[0]
        if len(at):
            span = spanned[at] + (b[k] - a[k]) - overlap[at]
            match = matched[at] + np.maximum(0, n[k] - overlap[at])
            best = np.lexsort((match, span))[-1]
            spanned[k], matched[k] = max((spanned[k], matched[k]), (span[best], match[best]))
    return max(zip(spanned.tolist(), matched.tolist()))


def _covered(runs: list[list[int]]) -> int:
    """Words of the test text that sorted passages cover together, whatever their order in the document."""
    total, end = 0, 0
    for a, b, *_ in runs:
        if b > end:
            total += b - max(a, end)
            end = b
    return total


def _near_each_other(runs: list[list[int]], near: int | None) -> list[list[list[int]]]:
    """The passages cut where the document has more than ``near`` words between one and all before it; each part sorted.
    No chain goes over such a cut."""
    if near is None or len(runs) < 2:
        return [runs]
    groups: list[list[list[int]]] = []
    end = -near - 1
    for run in sorted(runs, key=lambda r: r[2]):
        if run[2] - end > near:
            groups.append([])
        groups[-1].append(run)
        end = max(end, run[3])
    return [sorted(group) for group in groups]


Phrases = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def exact_phrases(starts: np.ndarray, place: np.ndarray, term: np.ndarray, d: np.ndarray, t: np.ndarray, terms: Terms, p: Params) -> Phrases:
    """(candidate, place in the test text, place in the document, words) of the longest exact phrases of candidates
    (document, text). ``starts`` bounds the postings of each document. Sorted by candidate and diagonal."""
    c, posting = _expand(starts[d], starts[d + 1])
    own_terms, text = term[posting], t[c]
    at = np.full(len(c), -1, dtype=np.int64)
    table = np.full(len(terms.pairs), -1, dtype=np.int32)
    edges = np.concatenate([[0], np.flatnonzero(text[1:] != text[:-1]) + 1, [len(c)]])
    for a, b in zip(edges[:-1], edges[1:]):  # candidates of one test text
        if a < b:
            low, high = terms.bounds[text[a]], terms.bounds[text[a] + 1]
            mine = terms.keys[low:high] - text[a] * len(terms.pairs)
            table[mine] = np.arange(low, high)
            at[a:b] = table[own_terms[a:b]]
            table[mine] = -1
    held = np.flatnonzero(at >= 0)
    row, number = _expand(terms.first[at[held]], terms.first[at[held] + 1])
    c, i, j = c[held[row]], terms.places[number], place[posting[held[row]]].astype(np.int64)
    shift = j - i
    low = shift.min(initial=0)
    diagonal = c * (int(shift.max(initial=0)) - int(low) + 1) + (shift - low)
    by = np.argsort(diagonal, kind="stable")
    c, i, j, diagonal = c[by], i[by], j[by], diagonal[by]
    new = np.concatenate([[True], (diagonal[1:] != diagonal[:-1]) | (j[1:] != j[:-1] + 1)])[: len(j)]
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(j))) + 1
    keep = n >= np.minimum(p.phrase, terms.sizes[t[c[first]]])
    first, n = first[keep], n[keep]
    return c[first], i[first], j[first], n


def promising(phrases: Phrases, sizes: np.ndarray, p: Params) -> tuple[np.ndarray, Phrases]:
    """Candidates that can have a passage or a chain, and the phrases that can be part of a piece. ``sizes``: words of the
    test text of each candidate.

    Phrases of one passage follow each other on diagonals and in the document within a few words. So the words of all
    phrases that are linked like this bound those of a passage, and where they begin and end bounds what it spans.
    """
    c, i, j, n = phrases
    if not len(c):
        return np.zeros(0, dtype=np.int64), phrases
    reach = p.gap + 2
    group = np.cumsum(np.concatenate([[True], (c[1:] != c[:-1]) | (np.diff(j - i) > reach)])) - 1
    by = np.lexsort((j, group))
    c, i, j, n, group = c[by], i[by], j[by], n[by], group[by]
    far = int((j + n).max()) + 1
    end = np.maximum.accumulate(j + n + group * far) - group * far
    first = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (j[1:] - end[:-1] > p.gap)]))
    owner = c[first]
    span = np.maximum.reduceat(i + n, first) - np.minimum.reduceat(i, first)
    words = np.minimum.reduce([np.add.reduceat(n, first), span, np.maximum.reduceat(j + n, first) - j[first]])
    least = _needed(sizes, p)
    piece = words >= np.minimum(p.near_piece, least[owner])
    total, covered = (np.bincount(owner, weights=np.where(piece, x, 0), minlength=len(sizes)) for x in (words, span))
    alone = np.zeros(len(sizes), dtype=bool)
    alone[owner[words >= least[owner]]] = True
    live = np.repeat(piece, np.diff(np.append(first, len(c))))
    return np.flatnonzero(alone | ((total >= least) & (covered >= p.min_share * sizes))), (c[live], i[live], j[live], n[live])


def spans(size: int, phrases: tuple[np.ndarray, np.ndarray, np.ndarray], p: Params) -> tuple[float, float, int]:
    """(share spanned, share matched, longest passage) of the best chain of passages in the order of the test text."""
    least = int(_needed(np.array([size]), p)[0])
    i_, j_, n_ = phrases
    by = np.lexsort((i_, j_))
    # phrases close to each other join into passages: [test start, test end, document start, document end, matched]
    runs: list[list[int]] = []
    live: list[list[int]] = []
    for i, j, n in zip(i_[by].tolist(), j_[by].tolist(), n_[by].tolist()):
        live = [r for r in live if j - r[3] <= p.gap]
        near = [r for r in live if -2 <= i - r[1] <= p.gap and -2 <= j - r[3] and i + n > r[1] and j + n > r[3]]
        if near:
            r = max(near, key=lambda r: r[4])
            overlap = max(0, r[1] - i, r[3] - j)
            r[1], r[3], r[4] = i + n, j + n, r[4] + n - overlap
        else:
            runs.append([i, i + n, j, j + n, n])
            live.append(runs[-1])
    long = sorted(r for r in runs if r[4] >= least)
    spanned, matched = _chain(long)
    for floor, apart in ((p.piece, None), (p.near_piece, p.near)):
        pieces = sorted(r for r in runs if r[4] >= min(floor, least))
        for group in _near_each_other(pieces, apart):
            if _covered(group) < p.min_share * size:
                continue
            whole = _chain(group, apart)
            if whole > (spanned, matched) and whole[0] >= p.min_share * size and whole[1] >= least:
                (spanned, matched), long = whole, pieces
    return spanned / size, matched / size, max((r[4] for r in long), default=0)


def compared(starts: np.ndarray, place: np.ndarray, term: np.ndarray, d: np.ndarray, t: np.ndarray, terms: Terms, p: Params) -> Iterator[tuple[int, tuple[float, float, int]]]:
    """(candidate, spans) of the candidates that have a passage."""
    for a, b in _slices((starts[d + 1] - starts[d]).tolist(), 1_000_000):
        own_t = t[a:b]
        phrases = exact_phrases(starts, place, term, d[a:b], own_t, terms, p)
        chosen, phrases = promising(phrases, terms.sizes[own_t], p)
        bounds = np.searchsorted(phrases[0], np.arange(b - a + 1))
        for c in chosen.tolist():
            found = spans(int(terms.sizes[own_t[c]]), tuple(x[bounds[c] : bounds[c + 1]] for x in phrases[1:]), p)
            if found[0] > 0:
                yield a + c, found


def passages(test: list[str], document: list[str], p: Params) -> tuple[float, float, int]:
    """``spans`` of two texts given as words."""
    terms = Terms([test])
    place, term = terms.postings(np.array([*[terms.words.get(w, 0) for w in document], 0], dtype=np.int64))
    zero = np.zeros(1, dtype=np.int64)
    return next((x for _, x in compared(np.array([0, len(place)]), place, term, zero, zero, terms, p)), (0.0, 0.0, 0))


def search(index: DataFrame, texts: list[tuple[int, str]], terms: Terms, lookups: Lookups, p: Params) -> DataFrame:
    """(doc_id, item_id, field, spanned, matched, longest) of every document row and test text that share a passage."""
    shared = index.sparkSession.sparkContext.broadcast((texts, terms, lookups))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, known, look = shared.value
        for batch in batches:
            ids, packed, listed = batch["doc_id"].to_numpy(), batch["places"].tolist(), batch["terms"].tolist()
            for a, b in _slices([len(x) // 4 for x in packed], 300_000):
                place = np.frombuffer(b"".join(packed[a:b]), dtype=np.int32)
                term = np.frombuffer(b"".join(listed[a:b]), dtype=np.int32)
                starts = np.cumsum([0, *[len(x) // 4 for x in packed[a:b]]])
                d, t = candidates(np.repeat(np.arange(b - a), np.diff(starts)), place, term, known, look, p)
                out = [(ids[a + d[c]], *names[t[c]], *found) for c, found in compared(starts, place, term, d, t, known, p)]
                yield pd.DataFrame(out, columns=["doc_id", "item_id", "field", "spanned", "matched", "longest"])

    return index.mapInPandas(run, "doc_id bigint, item_id bigint, field string, spanned double, matched double, longest int")


def test_texts(items: DataFrame) -> DataFrame:
    """(item_id, field, text): questions and references."""
    rows = require(items, item_id="bigint", question="string", reference="string").filter("item_id IS NOT NULL")
    fields = F.array(
        F.struct(F.lit("question").alias("field"), F.col("question").alias("text")),
        F.struct(F.lit("reference").alias("field"), F.col("reference").alias("text")),
    )
    return rows.select("item_id", F.explode(fields).alias("f")).select("item_id", "f.field", "f.text").filter("text <> ''").distinct()


def leaks(documents: DataFrame, items: DataFrame, p: Params = Params()) -> DataFrame:
    """(doc_id, item_id, field, spanned, matched, longest): the test texts that documents hold."""
    texts = test_texts(items)
    total = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-int(total) // p.block))
    found = []
    for block in range(blocks):
        own = texts.filter(F.pmod(F.xxhash64("item_id", "field", "text"), F.lit(blocks)) == block).collect()  # about p.block characters
        split = sorted((r.item_id, r.field, folded_words(r.text)) for r in own)
        split = [s for s in split if len(s[2]) > 1]
        terms = Terms([s[2] for s in split])
        if split:
            index = stored(build_index(documents, terms))
            lookups = Lookups(terms, term_counts(index, len(terms.pairs)), p)
            found.append(search(index, [s[:2] for s in split], terms, lookups, p))
    if not found:
        shape = "doc_id bigint, item_id bigint, field string, spanned double, matched double, longest int"
        return documents.sparkSession.createDataFrame([], shape)
    return reduce(DataFrame.unionByName, found).groupBy("doc_id", "item_id", "field").agg(
        F.max("spanned").alias("spanned"), F.max("matched").alias("matched"), F.max("longest").alias("longest")
    )
