"""The k most similar vectors of every vector.

Method: balanced posting lists, in two levels. The vectors are cut into cells, the vectors of a cell into lists, both by
balanced k-means. A vector is posted to its nearest cell and list and, if it lies near a boundary, also to further ones
whose centroid is almost as near. Centroids are searched through an in-memory graph; a query visits the cells, and in
them the lists, whose distance is within a ratio of its nearest one. Within the visited lists similarities are exact.

Scale: the cells are fitted on at most ``Params.sample`` vectors and are at most ``Params.max_cells``; they are what is
broadcast. Every vector is posted. A cell is searched by one task, which a vector reaches once, whatever number of lists
it is posted to or visits there; the lists of a cell are fitted in that task, and their number grows with the cell, so
that the comparisons of a vector stay the same as data grow. A cell of more than ``Params.block`` postings is cut into
parts with lists of their own, each visited by all queries of the cell, so no task holds more. Exact copies (any length
of vector, same direction) are one vector while searching, however many there are, and get expanded to rows at the end;
they are told by a 128-bit digest of the vector. With ``exhaustive`` every query visits every list of every cell.

Defined cases: a vector is usable if it has ``dims`` finite numbers, not all 0; its length is immaterial; a repeated id
counts once, with the smallest of its usable vectors; NULL ids are dropped; similarities equal to ``SIM_DIGITS`` digits go to
the smaller id; fewer than k other rows give fewer neighbours; no usable row gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gavelgrid.llm.storage import stored
from gavelgrid.sources.tables import require


ALL_ENTRIES = 512
SIM_DIGITS = 6  # similarities are compared to so many digits, so that rounding of float32 doesn't break ties


@dataclass(frozen=True)
class Params:
    dims: int = 64
    k: int = 5
    sample: int = 24_000  # vectors the cells, and the lists of a cell, are fitted on
    per_cell: int = 8000  # vectors a cell should hold
    max_cells: int = 4096
    cell_copies: int = 3  # cells a boundary vector is posted to
    cell_post_ratio: float = 1.1  # distance to a further cell over the distance to the nearest, for posting
    cell_probes: int = 4  # cells a query visits at most
    cell_probe_ratio: float = 1.25  # the same ratio for visiting
    per_list: int = 256  # vectors a list should hold
    copies: int = 3  # the same for the lists of a cell
    post_ratio: float = 1.1
    probes: int = 12
    probe_ratio: float = 1.3
    beam: int = 48  # width of the graph search
    degree: int = 24  # neighbours of a centroid in the graph
    block: int = 65_536  # postings of a part of a cell
    sent_ids: int = 500_000  # ids of copies that are broadcast; more meet the vectors in a shuffle
    exhaustive: bool = False
    seed: int = 7


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _unpack(cells: pd.Series, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(cells), dtype=np.float32).reshape(-1, dims)


def usable_vectors(table: DataFrame, dims: int = 64) -> DataFrame:
    """(id, code, vec): one unit vector as packed float32, and its digest, per usable id."""
    rows = require(table, chunk_rowid="bigint", embedding="array<float>").filter(F.col("chunk_rowid").isNotNull() & (F.size("embedding") == dims))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    good = rows.filter(~F.exists("embedding", bad) & F.exists("embedding", lambda x: x != 0))
    # a repeated id: the smallest vector, which is the same in every run
    once = good.groupBy("chunk_rowid").agg(F.min("embedding").alias("embedding"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                unit = _unit(np.stack(batch["embedding"].to_numpy()).astype(np.float64)).astype(np.float32)
                packed = [row.tobytes() for row in unit]
                codes = [blake2b(vec, digest_size=16).digest() for vec in packed]
                yield pd.DataFrame({"id": batch["chunk_rowid"], "code": codes, "vec": packed})

    return once.mapInPandas(pack, "id bigint, code binary, vec binary")


def classes(vectors: DataFrame) -> DataFrame:
    """(id, rep, n): exact copies as one class of n members, named by its smallest id."""
    sizes = vectors.groupBy("code").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))
    return vectors.select("id", "code").join(sizes, "code").select("id", "rep", "n")


# --- centroids ------------------------------------------------------------------------------------------------------


def balanced_centroids(sample: np.ndarray, lists: int, seed: int, rounds: int = 8, slack: float = 1.5) -> np.ndarray:
    """k-means whose clusters are kept from growing beyond ``slack`` times the mean: an oversized one is split."""
    rng = np.random.default_rng(seed)
    lists = max(1, min(lists, len(sample)))
    centres = sample[np.sort(rng.choice(len(sample), lists, replace=False))].astype(np.float32).copy()
    for _ in range(rounds):
        near = np.concatenate([np.argmax(part @ centres.T, axis=1) for part in np.array_split(sample, max(1, len(sample) // 4096))])
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        sizes = np.bincount(near, minlength=lists)
        live = sizes > 0
        centres[live] = sums[live] / np.maximum(np.linalg.norm(sums[live], axis=1, keepdims=True), 1e-12)
        # the centre of an empty or tiny cluster moves into the largest one
        order = np.argsort(-sizes, kind="stable")
        small = np.flatnonzero(sizes * 4 < len(sample) / lists)
        for big, weak in zip(order, small):
            if sizes[big] <= slack * len(sample) / lists:
                break
            members = np.flatnonzero(near == big)
            centres[weak] = sample[members[rng.integers(len(members))]]
    return _unit(np.where(np.linalg.norm(centres, axis=1, keepdims=True) > 0, centres, sample[:1])).astype(np.float32)


class CentroidGraph:
    """Nearest-neighbour graph over the centroids with evenly spread entry points; beam search for many queries at once.

    Up to ``ALL_ENTRIES`` centroids are all entry points, so that the search ends where it begins."""

    def __init__(self, centres: np.ndarray, degree: int) -> None:
        self.centres = centres
        n = len(centres)
        if n <= ALL_ENTRIES:
            self.near, self.entries = np.zeros((n, 0), dtype=np.int32), np.arange(n, dtype=np.int32)
            return
        degree = max(1, min(degree, n - 1)) if n > 1 else 0
        near = np.zeros((n, degree), dtype=np.int32)
        for part in np.array_split(np.arange(n), max(1, n // 1024)):
            sims = centres[part] @ centres.T
            sims[np.arange(len(part)), part] = -2
            near[part] = np.argsort(-sims, axis=1, kind="stable")[:, :degree]
        self.near = near
        self.entries = np.unique(np.linspace(0, n - 1, max(1, int(4 * np.sqrt(n)))).astype(np.int32))

    def search(self, queries: np.ndarray, beam: int, rounds: int = 6) -> tuple[np.ndarray, np.ndarray]:
        """(centroid numbers, similarities), the best ``beam`` found per query, best first."""
        n = len(self.centres)
        beam = min(beam, n)
        sims = queries @ self.centres[self.entries].T
        if beam < len(self.entries):
            order = np.argpartition(-sims, beam - 1, axis=1)[:, :beam]
            order = np.take_along_axis(order, np.lexsort((order, -np.take_along_axis(sims, order, 1)), axis=1), 1)
        else:
            order = np.argsort(-sims, axis=1, kind="stable")
        found, value = self.entries[order], np.take_along_axis(sims, order, 1)
        width = min(8, found.shape[1])
        for _ in range(rounds):
            if not self.near.shape[1]:
                break
            ahead = self.near[found[:, :width]].reshape(len(queries), -1)
            ahead_value = np.einsum("qd,qcd->qc", queries, self.centres[ahead])
            ids = np.concatenate([found, ahead], axis=1)
            values = np.concatenate([value, ahead_value], axis=1)
            by_id = np.argsort(ids, axis=1, kind="stable")
            ids, values = np.take_along_axis(ids, by_id, 1), np.take_along_axis(values, by_id, 1)
            values[:, 1:][ids[:, 1:] == ids[:, :-1]] = -3  # found twice
            best = np.argsort(-values, axis=1, kind="stable")[:, :beam]
            new, new_value = np.take_along_axis(ids, best, 1), np.take_along_axis(values, best, 1)
            if new.shape == found.shape and np.array_equal(new, found):
                break
            found, value, width = new, new_value, min(width + 8, new.shape[1])
        return found, value


def _within(found: np.ndarray, value: np.ndarray, most: int, ratio: float) -> list[np.ndarray]:
    """Lists whose distance is at most ``ratio`` times that of the nearest list."""
    distance = np.sqrt(np.maximum(2 - 2 * value[:, :most], 0))
    keep = (distance <= ratio * distance[:, :1] + 1e-6) & (value[:, :most] > -2)
    return [row[mask] for row, mask in zip(found[:, :most], keep)]


# --- search ---------------------------------------------------------------------------------------------------------


def _lists_of(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) pairs of ragged rows."""
    return np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate([np.zeros(0, dtype=np.int64), *rows]).astype(np.int64)


def _top(query: np.ndarray, other: np.ndarray, sim: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``wanted`` best different others of every query; ties go to the smaller one."""
    order = np.lexsort((-sim, other, query))
    query, other, sim = query[order], other[order], sim[order]
    once = np.ones(len(query), dtype=bool)
    once[1:] = (query[1:] != query[:-1]) | (other[1:] != other[:-1])
    query, other, sim = query[once], other[once], sim[once]
    order = np.lexsort((other, -sim, query))
    query, other, sim = query[order], other[order], sim[order]
    keep = np.arange(len(query)) - np.searchsorted(query, query) < wanted
    return query[keep], other[keep], sim[keep]


def _best_of_block(queries: np.ndarray, own: np.ndarray, rows: np.ndarray, ids: np.ndarray, wanted: int, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, id, similarity): the rows that may be among the ``wanted`` best of a query, ties included. ``ids``
    are in order; ``edge`` holds what each query's ``wanted`` best rows reach so far and is raised."""
    parts = []
    for at in range(0, len(queries), 1024):
        sims = queries[at : at + 1024] @ rows.T
        place = np.minimum(np.searchsorted(ids, own[at : at + 1024]), len(ids) - 1)
        itself = np.flatnonzero(ids[place] == own[at : at + 1024])
        sims[itself, place[itself]] = -2
        if len(ids) > wanted:
            best = np.partition(sims, len(ids) - wanted, axis=1)[:, len(ids) - wanted] - 2 * 10.0**-SIM_DIGITS
            edge[at : at + 1024] = np.maximum(edge[at : at + 1024], best)
        q, r = np.nonzero(sims > np.maximum(edge[at : at + 1024], -1.5)[:, None])
        parts.append((q + at, ids[r], np.round(sims[q, r], SIM_DIGITS)))
    return tuple(np.concatenate(x) for x in zip(*parts))


def search_cell(vectors: np.ndarray, ids: np.ndarray, held: np.ndarray, p: Params, wanted: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, id, similarity) of the ``wanted`` best rows in ``held`` of every row, by posting lists."""
    rows, row_ids = vectors[held], ids[held]
    lists = 1 if p.exhaustive else max(1, round(len(rows) / p.per_list))
    none = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.float32))
    if not len(rows):
        return none
    if lists == 1:
        return _top(*_best_of_block(vectors, ids, rows, row_ids, wanted, np.full(len(vectors), -2.0)), wanted)
    sample = rows[:: max(1, len(rows) // p.sample)]
    graph = CentroidGraph(balanced_centroids(sample, lists, p.seed, rounds=6), p.degree)
    posts, probes = [], []
    for at in range(0, len(vectors), 1024):
        found, value = graph.search(vectors[at : at + 1024], p.beam)
        posts += _within(found, value, p.copies, p.post_ratio)
        probes += _within(found, value, p.probes, p.probe_ratio)
    row, post_list = _lists_of([posts[i] for i in held])
    query, probe_list = _lists_of(probes)
    by_post, by_probe = np.argsort(post_list, kind="stable"), np.argsort(probe_list, kind="stable")
    post_cut, probe_cut = np.searchsorted(post_list[by_post], np.arange(lists + 1)), np.searchsorted(probe_list[by_probe], np.arange(lists + 1))
    parts, kept, edge = [none], 0, np.full(len(vectors), -2.0)
    for number in range(lists):
        mine, asked = row[by_post[post_cut[number] : post_cut[number + 1]]], query[by_probe[probe_cut[number] : probe_cut[number + 1]]]
        if len(mine) and len(asked):
            reached = edge[asked]
            q, other, sim = _best_of_block(vectors[asked], ids[asked], rows[mine], row_ids[mine], wanted, reached)
            edge[asked] = reached
            parts.append((asked[q], other, sim))
            kept += len(q)
            if kept > 2_000_000:
                parts, kept = [_top(*(np.concatenate(x) for x in zip(*parts)), wanted)], 0
    return _top(*(np.concatenate(x) for x in zip(*parts)), wanted)


def fit_cells(reps: DataFrame, total: int, p: Params) -> np.ndarray:
    """Centroids of the cells, from the ``sample`` vectors with the lowest hashes."""
    share = min(1.0, 1.5 * p.sample / total)
    low = F.pmod(F.xxhash64("rep"), F.lit(1 << 40))
    picked = reps.filter(low <= int(share * (1 << 40))).orderBy(low, "rep").limit(p.sample).select("vec").toPandas()
    if picked.empty:
        picked = reps.orderBy("rep").limit(p.sample).select("vec").toPandas()
    sample = _unpack(picked["vec"], p.dims)
    sample = sample[np.lexsort(sample.T)]
    return balanced_centroids(sample, int(min(p.max_cells, max(1, -(-total // p.per_cell)), max(1, len(sample) // 4))), p.seed)


def search_classes(reps: DataFrame, total: int, p: Params) -> DataFrame:
    """(rep, other, sim): for every class the best other classes of the lists it visits, more than k of them."""
    spark = reps.sparkSession
    schema, wanted = "rep bigint, other bigint, sim float", p.k + 1
    if total == 0:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(fit_cells(reps, total, p))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        graph = CentroidGraph(shared.value, p.degree)
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.iloc[at : at + 1024]
                found, value = graph.search(_unpack(part["vec"], p.dims), p.beam)
                posts = _within(found, value, p.cell_copies, p.cell_post_ratio)
                visits = [np.arange(len(shared.value))] * len(part) if p.exhaustive else _within(found, value, p.cell_probes, p.cell_probe_ratio)
                if p.exhaustive:
                    posts = [own[:1] for own in posts]
                # the cells a vector is posted to come first
                cells = [np.concatenate([a, b[~np.isin(b, a)]]).astype(np.int32) for a, b in zip(posts, visits)]
                yield pd.DataFrame({"rep": part["rep"].to_numpy(), "vec": part["vec"].to_numpy(), "cells": cells, "posts": [len(a) for a in posts]})

    placed = stored(reps.select("rep", "vec").mapInPandas(assign, "rep bigint, vec binary, cells array<int>, posts int"))
    visits = placed.select("rep", "vec", "posts", F.posexplode("cells").alias("pos", "cell")).withColumn("held", F.col("pos") < F.col("posts"))
    parts = placed.select(F.explode(F.slice("cells", F.lit(1), F.col("posts"))).alias("cell")).groupBy("cell").agg(
        F.ceil(F.count(F.lit(1)) / p.block).cast("int").alias("parts")
    )
    split = visits.join(F.broadcast(parts), "cell")  # one row per cell, at most max_cells
    own = F.pmod(F.xxhash64("rep"), F.col("parts"))
    split = split.select("cell", "rep", "vec", "held", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    rows = split.select("cell", "part", "rep", "vec", (F.col("held") & (F.col("own") == F.col("part"))).alias("held"))

    def search(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("rep")
        ids = part["rep"].to_numpy()
        query, other, sim = search_cell(_unpack(part["vec"], p.dims), ids, np.flatnonzero(part["held"].to_numpy()), p, wanted)
        return pd.DataFrame({"rep": ids[query], "other": other, "sim": sim.astype(np.float32)})

    hits = rows.groupBy("cell", "part").applyInPandas(search, schema).repartition("rep")
    best = Window.partitionBy("rep").orderBy(F.desc("sim"), "other")
    ranked = hits.groupBy("rep", "other").agg(F.max("sim").alias("sim")).withColumn("rank", F.row_number().over(best))
    return ranked.filter(F.col("rank") <= wanted).drop("rank")


def nearest(table: DataFrame, p: Params = Params()) -> DataFrame:
    """(rowid, neighbour, similarity, rank): the k most similar other rows of every row.

    Classes of exact copies are searched once. A row's candidates are at most k + 1 other members of its own class
    and at most k + 1 members of each neighbour class, always those with the smallest ids, since no others can be
    among the k best. So a class with many copies adds k rows per member and never all its pairs.
    """
    vectors = stored(usable_vectors(table, p.dims))
    members = stored(classes(vectors))
    copies = members.filter("n > 1")
    further = copies.filter("id <> rep").select("id")
    further = F.broadcast(further) if further.count() <= p.sent_ids else further
    reps = vectors.join(further, "id", "left_anti").select(F.col("id").alias("rep"), "vec")
    near = search_classes(reps, members.filter("id = rep").count(), p)
    heads = _first_members(copies, p.k + 1)  # classes of one member need none
    own = heads.select("rep", F.col("rep").alias("other"), F.lit(1.0).cast("float").alias("sim"))
    lists = near.unionByName(own).join(heads.select(F.col("rep").alias("other"), "heads"), "other", "left")
    lists = lists.withColumn("heads", F.coalesce("heads", F.array("other")))
    per_class = lists.groupBy("rep").agg(F.collect_list(F.struct((-F.col("sim")).alias("far"), F.col("heads"))).alias("c"))  # at most k + 2 classes
    ordered = F.array_sort(F.flatten(F.transform("c", lambda x: F.transform(x["heads"], lambda h: F.struct(x["far"].alias("far"), h.alias("id"))))))
    candidates = per_class.select("rep", F.slice(ordered, 1, p.k + 1).alias("best"))
    rows = members.join(candidates, "rep").select("id", F.slice(F.filter("best", lambda b: b["id"] != F.col("id")), 1, p.k).alias("best"))
    return rows.select(F.col("id").alias("rowid"), F.posexplode("best").alias("pos", "b")).select(
        "rowid", F.col("b.id").alias("neighbour"), (-F.col("b.far")).alias("similarity"), (F.col("pos") + 1).alias("rank")
    )


def _first_members(copies: DataFrame, count: int) -> DataFrame:
    """(rep, heads): the ``count`` smallest ids of each class; the window keeps no more than that per class and task."""
    first = Window.partitionBy("rep").orderBy("id")
    return copies.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= count).groupBy("rep").agg(F.array_sort(F.collect_list("id")).alias("heads"))


def similar_pairs(table: DataFrame, threshold: float = 0.9, p: Params = Params()) -> DataFrame:
    """(rowid_a, rowid_b), smaller first: neighbours in either direction with at least ``threshold`` similarity."""
    close = nearest(table, p).filter(F.col("similarity") >= threshold)
    return close.select(F.least("rowid", "neighbour").alias("rowid_a"), F.greatest("rowid", "neighbour").alias("rowid_b")).distinct()
