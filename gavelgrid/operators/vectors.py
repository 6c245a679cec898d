"""Exact nearest neighbours of stated queries, and vector arithmetic in SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gavelgrid.functions.text import bind


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, summed in order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalise(v: Column) -> Column:
    """Unit vector; the zero vector stays."""
    scaled = lambda n: F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))
    return bind(F.sqrt(dot(v, v)), scaled)


def hashed_encoder(dims: int = 64) -> Callable[[Column], Column]:
    """A deterministic stand-in for a model that encodes texts: signed hashes of words, added up."""

    @F.pandas_udf("array<float>")
    def encode(texts: pd.Series) -> pd.Series:
        import hashlib

        def one(text: str | None) -> list[float]:
            v = np.zeros(dims, dtype=np.float32)
            for word in (text or "").lower().split():
                h = int.from_bytes(hashlib.md5(word.encode()).digest()[:8], "big")
                v[h % dims] += 1 if h >> 63 else -1
            n = np.linalg.norm(v)
            return (v / n if n else v).tolist()

        return texts.map(one)

    return encode


QUERY_BLOCK = 16_384  # queries sent to the rows at once


class Best:
    """The k best hits of every query so far; ties to ``digits`` digits go to the smaller id."""

    def __init__(self, queries: int, k: int, digits: int = 9) -> None:
        self.k, self.digits, self.edge = k, digits, np.full(queries, -np.inf)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def pick(self, asked: np.ndarray, items: np.ndarray, scores: np.ndarray, least_score: float) -> None:
        """Takes what can be among the best of scores (asked, items), NaN excluded; all from ``least_score`` on count."""
        least, place = self.edge[asked], len(items) - self.k
        new = np.isinf(least)
        if place > 0 and new.any():
            least[new] = np.partition(scores[new], place, axis=1)[:, place] - 10.0**-self.digits
        at, item = np.divmod(np.flatnonzero(scores >= np.maximum(least, least_score)[:, None]), len(items))
        self.add(asked[at], items[item], scores[at, item])

    def add(self, query: np.ndarray, item: np.ndarray, score: np.ndarray) -> None:
        self.parts.append((query, item, score))
        self.held += len(query)
        if self.held > 4 * self.k * len(self.edge) + 200_000:
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        query, item, score = (np.concatenate(x) for x in zip(*self.parts)) if self.parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        order = np.lexsort((item, -np.round(score, self.digits), query))
        query, item, score = query[order], item[order], score[order]
        first = np.searchsorted(query, query)
        place = np.arange(len(query)) - first
        full = place == self.k - 1
        self.edge[query[full]] = score[full] - 10.0**-self.digits
        keep = place < self.k
        self.parts = [(query[keep], item[keep], score[keep])]
        self.held = int(keep.sum())
        return self.parts[0]


def hide_own(scores: np.ndarray, own: np.ndarray, ids: np.ndarray, value: float) -> None:
    """Sets the scores (query, item) where the query, of the sorted ``own``, is the item itself."""
    low, high = np.searchsorted(own, ids), np.searchsorted(own, ids, side="right")
    times = high - low
    item = np.repeat(np.arange(len(ids)), times)
    scores[np.arange(len(item)) - np.repeat(np.cumsum(times) - times - low, times), item] = value


def exact_knn(
    queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int | None, segment: str | None = None, skip_self: bool = True,
    min_score: float | None = None, per_segment: bool = False, query_block: int = QUERY_BLOCK, digits: int = 9,
) -> DataFrame:
    """(query, key, score, rank): the k rows with the largest inner product, of all rows (or all of the same segment).

    Filters belong in front of it. The stated queries go to the rows in blocks of about ``query_block``; the rows stay
    where they are. Every task multiplies its rows with the block and keeps the k best hits of each query, which a
    ranking window over all tasks merges. ``min_score`` is applied before anything leaves a task; with ``k = None`` all
    hits from it on come out, without a rank. With ``per_segment`` the k best of every segment come out, for all queries;
    the segment of a query is then of no account.

    Defined cases: NULL vectors and keys are skipped, and vectors of another length than the queries have most often;
    hits equal to ``digits`` digits go to the smaller key.
    """
    if k is None and min_score is None:
        raise ValueError("either k or min_score is needed")
    spark = rows.sparkSession
    seg = F.col(segment).cast("string") if segment else F.lit("")
    typed = lambda df, s: df.select(s.alias("s"), F.col(key).cast("bigint").alias("i"), F.col(vector).cast("array<double>").alias("v")).filter("v IS NOT NULL AND i IS NOT NULL AND NOT exists(v, x -> x IS NULL)")
    q, r = typed(queries, F.lit("") if per_segment else seg), typed(rows, seg).filter("s IS NOT NULL")
    lengths = {x.n: x.c for x in q.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "n").limit(1).collect()}
    schema = "query bigint, s string, item bigint, score double"
    if not lengths:
        return spark.createDataFrame([], schema).selectExpr("query", f"item AS `{key}`", "score", "CAST(NULL AS int) AS rank")
    dims, total = next(iter(lengths.items()))
    blocks = -(-total // query_block)
    found = []
    for number in range(blocks):
        part = q.filter((F.size("v") == dims) & (F.pmod(F.xxhash64("i"), F.lit(blocks)) == number)).toArrow()  # about query_block rows
        order = np.argsort(part["i"].to_numpy(), kind="stable")
        matrix = part["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)[order]
        segments = np.array(part["s"].to_pylist(), dtype=object)[order]
        found.append(_against(r.filter(F.size("v") == dims), part["i"].to_numpy()[order], segments, matrix, k, skip_self, min_score, per_segment, schema, digits))
    hits = reduce(DataFrame.unionByName, found)
    if k is None:
        return hits.select("query", F.col("item").alias(key), "score", F.lit(None).cast("int").alias("rank"))
    best = Window.partitionBy("query", *(["s"] if per_segment else [])).orderBy(F.desc(F.round("score", digits)), "item")
    ranked = hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query", F.col("item").alias(key), "score", "rank")


def _against(rows: DataFrame, own: np.ndarray, segments: np.ndarray, matrix: np.ndarray, k: int | None, skip_self: bool, min_score: float | None, per_segment: bool, schema: str, digits: int = 9) -> DataFrame:
    """Hits of one block of queries in all rows."""
    shared = rows.sparkSession.sparkContext.broadcast((own, segments, matrix))
    floor = max(-np.inf if min_score is None else min_score, np.finfo(float).min)  # infinite scores are none

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, segments, matrix = shared.value
        numbers = {s: np.flatnonzero(segments == s) for s in set(segments.tolist())}
        best: dict[str, Best] = {}

        def pack(query: np.ndarray, s: str, item: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(own[query]), pa.array([s] * len(query), pa.string()), pa.array(item), pa.array(score)], ["query", "s", "item", "score"])

        for batch in batches:
            ids = batch.column("i").to_numpy(zero_copy_only=False)
            vectors = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
            names = np.array(batch.column("s").to_pylist(), dtype=object)
            for s in sorted(set(names.tolist())):
                asked = np.arange(len(own)) if per_segment else numbers.get(s, ())
                if not len(asked):
                    continue
                held = np.flatnonzero(names == s)
                state = best.setdefault(s if per_segment else "", Best(len(own), k, digits)) if k else None
                for a in range(0, len(held), 4096):
                    mine = held[a : a + 4096]
                    for b in range(0, len(asked), 1024):
                        rows_ = asked[b : b + 1024]
                        scores = matrix[rows_] @ vectors[mine].T
                        if not np.isfinite(scores.sum()):
                            scores[~np.isfinite(scores)] = -np.inf
                        if skip_self:
                            hide_own(scores, own[rows_], ids[mine], -np.inf)
                        if state:
                            state.pick(rows_, ids[mine], scores, floor)
                            continue
                        at, item = np.nonzero(scores >= floor)
                        if len(at):
                            yield pack(rows_[at], s, ids[mine[item]], scores[at, item])
                    if state and np.isinf(state.edge).any():
                        state.cut()
        for s, state in best.items():
            yield pack(state.cut()[0], s, *state.cut()[1:])

    return rows.mapInArrow(run, schema)
