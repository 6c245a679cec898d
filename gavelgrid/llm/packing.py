"""Filling containers of a fixed number of tokens with documents.

Method: optimal length buckets. Sizes are counted with a public tokenizer; the global histogram of sizes, at most
``capacity`` numbers whatever the data, goes to a dynamic program that chooses the bucket boundaries whose batches
leave the least padding. The boundary of a bucket sets its batches: ``capacity // boundary`` items, so that any of its
items fit the budget, the longest first. From the longest bucket down, what a batch leaves free is topped up with the
longest items of *shorter* buckets that fit; what is left of a bucket below a whole batch is its last batch. So the
boundaries decide which items share a container, and ``Plan.padding`` states what the batches alone would leave.

Only sizes matter, so all this is done on the histogram: a *pattern* (the sizes in a container) is repeated while its
sizes last, and every pattern uses up at least one size, so there are few patterns. Documents find their container by
their exact rank inside their size (``operators.hashrank``) and a binary search in the pattern table; no task ever
holds the documents of a size or a bucket.

Defined cases: an item longer than ``capacity`` is cut into pieces of ``capacity`` tokens and a rest, no other item is
cut; a NULL or empty text has no tokens, takes no space and comes out with the container its rank falls on and slot
NULL; ids may repeat, each row is an item of its own; a document's place depends on
its id, size and the histogram alone.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavelgrid.llm.storage import stored
from gavelgrid.operators.hashrank import hash_rank
from gavelgrid.sources.tables import require

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the published splitting pattern of these byte-level vocabularies.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CAPACITY, BUCKETS = 2048, 24

_ENCODERS: dict[str, object] = {}


def encoder(vocabulary: str):
    """The tokenizer of a ranks file, read once per process."""
    if vocabulary not in _ENCODERS:
        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _ENCODERS[vocabulary] = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[vocabulary]


def token_counts(table: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens) of every row. The vocabulary file is shipped to the executors with the job."""
    table.sparkSession.sparkContext.addFile(vocabulary)
    name = os.path.basename(vocabulary)
    rows = require(table, **{key: "bigint", text: "string"}).select(F.col(key).alias("doc_id"), F.col(text).alias("t"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = encoder(SparkFiles.get(name))
        for batch in batches:
            sizes = [len(tokenizer.encode_ordinary(t)) if t else 0 for t in batch["t"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].to_numpy(), "n_tokens": np.array(sizes, dtype=np.int64)})

    return rows.mapInPandas(count, "doc_id bigint, n_tokens bigint")


def bucket_boundaries(histogram: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """Upper boundaries with the least padding. ``histogram[s]``: items of size s, 1 <= s <= capacity."""
    capacity = len(histogram) - 1
    sizes = np.flatnonzero(histogram[1:]) + 1
    if not len(sizes):
        return []
    items = np.concatenate([[0], np.cumsum(histogram[sizes])]).astype(float)
    tokens = np.concatenate([[0], np.cumsum(histogram[sizes] * sizes)]).astype(float)
    n = len(sizes)
    best = np.full(n + 1, np.inf)
    best[0] = 0
    back = []
    for _ in range(min(buckets, n)):
        new, source = best.copy(), np.full(n + 1, -1)
        for j in range(1, n + 1):  # a bucket that ends with the j-th size
            per_batch = capacity // sizes[j - 1]
            padding = np.ceil((items[j] - items[:j]) / per_batch) * capacity - (tokens[j] - tokens[:j])
            total = best[:j] + padding
            i = int(np.argmin(total))
            if total[i] < new[j]:
                new[j], source[j] = total[i], i
        back.append(source)
        best = new
    bounds, j, level = [], n, len(back) - 1
    while j > 0 and level >= 0:
        i = back[level][j]
        if i >= 0:
            bounds.append(int(sizes[j - 1]))
            j = i
        level -= 1
    return sorted(bounds)


@dataclass
class Plan:
    """Which ranks of a size go to which containers; sorted by (size, first rank)."""

    size: list[int] = field(default_factory=list)
    first: list[int] = field(default_factory=list)  # 0-based rank inside the size
    base: list[int] = field(default_factory=list)  # first container
    each: list[int] = field(default_factory=list)  # items of this size per container
    slot: list[int] = field(default_factory=list)
    containers: int = 0
    padding: int = 0  # tokens the batches of all buckets leave free before they are topped up
    bounds: list[int] = field(default_factory=list)

    def arrays(self) -> tuple[np.ndarray, ...]:
        order = np.lexsort((self.first, self.size))
        return tuple(np.array(x, dtype=np.int64)[order] for x in (self.size, self.first, self.base, self.each, self.slot))


def batch_padding(histogram: np.ndarray, bounds: list[int]) -> int:
    """Tokens left free when every bucket makes batches of ``capacity // boundary`` items of its own."""
    capacity = len(histogram) - 1
    left = 0
    for low, bound in zip([0, *bounds[:-1]], bounds):
        counts, sizes = histogram[low + 1 : bound + 1], np.arange(low + 1, bound + 1)
        left += -(-int(counts.sum()) // (capacity // bound)) * capacity - int((counts * sizes).sum())
    return left


def pack_histogram(histogram: np.ndarray, buckets: int = BUCKETS, bounds: list[int] | None = None) -> Plan:
    """The plan for a histogram of sizes; ``bounds`` replaces the boundaries of the dynamic program."""
    capacity = len(histogram) - 1
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    plan = Plan(bounds=bucket_boundaries(left, buckets) if bounds is None else bounds)
    plan.padding = batch_padding(left, plan.bounds)
    used = np.zeros_like(left)
    for low, bound in reversed(list(zip([0, *plan.bounds[:-1]], plan.bounds))):
        batch = capacity // bound
        while left[low + 1 : bound + 1].any():
            pattern: dict[int, int] = {}
            room, wanted = capacity, batch
            for size in (np.flatnonzero(left[low + 1 : bound + 1]) + low + 1)[::-1]:
                if wanted == 0:
                    break
                pattern[int(size)] = take = int(min(left[size], wanted))
                room -= take * int(size)
                wanted -= take
            top = min(room, low)
            while top > 0:  # shorter buckets only
                fits = np.flatnonzero(left[1 : top + 1])
                if not len(fits):
                    break
                size = int(fits[-1]) + 1
                pattern[size] = take = int(min(left[size], room // size))
                room -= take * size
                top = min(room, size - 1)
            times = int(min(left[s] // q for s, q in pattern.items()))
            slot = 0
            for s, q in pattern.items():
                plan.size.append(s)
                plan.first.append(int(used[s]))
                plan.base.append(plan.containers)
                plan.each.append(q)
                plan.slot.append(slot)
                used[s] += q * times
                left[s] -= q * times
                slot += q
            plan.containers += times
    return plan


def pack(table: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, vocabulary: str = VOCABULARY, seed: int = 5) -> DataFrame:
    """(container_id, slot, doc_id, piece, token_start, token_end, n_tokens): every item in its container."""
    counted = stored(token_counts(table, key, text, vocabulary))
    pieces = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n_tokens") / capacity) - 1, F.lit(0)).cast("int"))
    items = (
        counted.select("doc_id", "n_tokens", F.explode(pieces).alias("piece"))
        .select(
            "doc_id",
            F.concat_ws(":", "doc_id", "piece").alias("item"),
            "piece",
            (F.col("piece") * F.lit(capacity)).cast("bigint").alias("token_start"),
            F.least((F.col("piece") + 1) * F.lit(capacity), F.col("n_tokens")).alias("token_end"),
        )
        .withColumn("n_tokens", F.col("token_end") - F.col("token_start"))
    )
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for row in items.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect():  # at most capacity + 1 rows
        histogram[row.n_tokens] = row.n
    plan = pack_histogram(histogram)
    shared = table.sparkSession.sparkContext.broadcast((plan.arrays(), max(1, plan.containers)))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (size, first, base, each, slot), containers = shared.value
        starts = size * (1 << 44) + first
        for batch in batches:
            n, rank = batch["n_tokens"].to_numpy(), batch["hash_rank"].to_numpy() - 1
            empty = n == 0
            at = np.maximum(np.searchsorted(starts, n * (1 << 44) + rank, side="right") - 1, 0)
            if len(starts):
                inside = rank - first[at]
                container = np.where(empty, rank % containers, base[at] + inside // each[at])
                where = pd.Series(np.where(empty, 0, slot[at] + inside % each[at])).astype("Int32").mask(empty)
            else:
                container, where = rank % containers, pd.Series([pd.NA] * len(batch), dtype="Int32")
            yield batch.assign(container_id=container, slot=where.to_numpy(dtype=object, na_value=None))[
                ["container_id", "slot", "doc_id", "piece", "token_start", "token_end", "n_tokens"]
            ]

    ranked = hash_rank(items, ["n_tokens"], "item", seed)
    return ranked.select("doc_id", "piece", "token_start", "token_end", "n_tokens", "hash_rank").mapInPandas(
        place, "container_id bigint, slot int, doc_id bigint, piece int, token_start bigint, token_end bigint, n_tokens bigint"
    )
