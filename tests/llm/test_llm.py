"""Each operator on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

from __future__ import annotations

import dataclasses
import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gavelgrid.llm import languages, leakage, ledger, neighbours, packing, proportions, splitting, toxicity

T = dt.datetime


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# --- 1 --------------------------------------------------------------------------------------------------------------

DECISIONS = "decision_id string, indexed_at timestamp_ntz, month string, _h string"
LEDGER = "decision_id string, wave int, selected_at timestamp_ntz, origin string"


def _decisions(spark, data):
    return spark.createDataFrame([(*d, "clash", "clash") for d in data], DECISIONS)


def test_ledger_is_stable_as_data_grows(spark):
    data = [(f"id{i}", T(2021, 1 + i % 6, 1 + i % 28)) for i in range(600)] + [("BGE 1 I 2", T(2021, 1, 1)), ("1_I_2", T(2021, 2, 1)), (None, None), ("", None), ("undated", None)]
    picks = spark.createDataFrame([("id5", 1, None, None), ("id5", 2, None, None), ("bge_1_I_2", None, None, None), ("lost", 1, None, None), (None, 1, None, None)], LEDGER)
    first = ledger.selection(_decisions(spark, data), picks, 0.2)
    again = ledger.selection(_decisions(spark, random.Random(1).sample(data, len(data)) + data[:50]).repartition(7), picks, 0.2)
    assert rows(first) == rows(again)
    chosen = {r.decision_id: r for r in first.collect()}
    assert {"id5", "bge_BGE_1_I_2", "lost"} <= set(chosen) and not chosen["lost"].present and chosen["id5"].ledger_wave == 1
    per_month = first.filter("present").groupBy("month").count().collect()
    assert all(r["count"] == -(-(101 if r.month == "2021-01" else 100) // 5) for r in per_month if r.month != "unknown")
    grown = data + [(f"new{i}", T(2021, 7, 1 + i % 28)) for i in range(300)]
    book = ledger.advance_ledger(picks, first, 3, "2022-01-01 00:00:00")
    for again_with in (picks, book):
        later = {r.decision_id for r in ledger.selection(_decisions(spark, grown), again_with, 0.2).collect()}
        assert set(chosen) <= later and any(k.startswith("new") for k in later)
    # with the ledger written back, even records of an old month take nothing away
    late = data + [(f"old{i}", T(2021, 1, 2)) for i in range(200)]
    assert set(chosen) <= {r.decision_id for r in ledger.selection(_decisions(spark, late), book, 0.2).collect()}


def test_ledger_without_rows(spark):
    none = _decisions(spark, [])
    assert ledger.selection(none, spark.createDataFrame([], LEDGER), 0.5).count() == 0
    with pytest.raises(ValueError):
        ledger.selection(none, spark.createDataFrame([], LEDGER), 2)


def test_waves_write_the_ledger(spark, tmp_path):
    target = str(tmp_path / "ledger")
    data = [(f"id{i}", T(2021, 1 + i % 3, 1)) for i in range(300)]
    first = rows(ledger.run_wave(_decisions(spark, data), target, 0.1, 1, "2021-12-31 00:00:00"))
    assert len(first) == 30 and first == rows(ledger.run_wave(_decisions(spark, data), target, 0.5, 1, "2022-01-01 00:00:00"))  # drawn once
    late = [(f"late{i}", T(2021, 1 + i % 3, 2)) for i in range(300)] + [(f"new{i}", T(2021, 4, 1)) for i in range(50)]
    second = rows(ledger.run_wave(_decisions(spark, data + late), target, 0.1, 2, "2022-12-31 00:00:00"))
    assert set(first) <= set(second) and len(second) == 60 + 5
    assert {r[1] for r in set(second) - set(first)} == {2}


# --- 2 --------------------------------------------------------------------------------------------------------------


def _pieces(spark, texts, limit=100, overlap=10):
    df = spark.createDataFrame([(i, t, "clash", "clash") for i, t in enumerate(texts)], "k int, t string, whole string, spans string")
    split = splitting.split_items(df.select("k", "t"), "t", ["k"], limit, overlap)
    return {r.k: [(s.char_start, s.char_end, s.pieces) for s in r.spans] for r in split.collect()}


def test_split_properties(spark):
    rng = random.Random(3)
    words = ["Gericht", "über", "a", "Entscheid,", "ist.", "so!", "😀", "ja;", "\n", "\n\n", "langes" * 5]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 300))) for _ in range(60)]
    texts += [None, "", " \n\t ", "x" * 1000, "x" * 100, "x" * 101, "  \n" + "y" * 100 + "\n\t ", "😀" * 350, "wort " * 5000]
    for i, spans in _pieces(spark, texts).items():
        text = texts[i] or ""
        body = text.strip(" \t\n")
        if not body:
            assert spans == []
            continue
        lead = text.index(body)
        assert spans[0][0] == lead and spans[-1][1] == lead + len(body) and all(n == len(spans) for *_, n in spans)
        assert all(0 < e - s <= 100 for s, e, _ in spans)
        assert all(b[0] == max(a[1] - 10, lead) for a, b in zip(spans, spans[1:]))
        assert (len(spans) == 1) == (len(body) <= 100)


def test_split_prefers_strong_boundaries(spark):
    line = "a" * 60 + "\n" + "b b. " * 30
    assert _pieces(spark, [line])[0][0][1] == 61
    sentence = "c" * 50 + ". " + "d" * 20 + " " + "e" * 200
    assert _pieces(spark, [sentence])[0][0][1] == 52
    early = "f" * 20 + ". " + "g, " * 10 + "h" * 200  # the only sentence end lies in the lower half
    assert _pieces(spark, [early])[0][0][1] == 22


def test_found_and_pieces_of_both_tables(spark):
    long = "Satz eins ist hier. " * 200
    decisions = spark.createDataFrame([("d", "xx" + long, "c"), ("d", "xx" + long, "c"), (None, long, "c"), ("e", "kurz", "c"), ("f", None, "c")], "decision_id string, full_text string, spans string")
    chunks = spark.createDataFrame([(1, "d", 2, " " + long), (2, "d", 77, long), (3, "z", None, long), (4, "d", 0, "kurz"), (None, "d", 0, long)], "id long, decision_id string, char_start int, text string")
    assert rows(splitting.oversized(decisions, chunks)) == [("chunks", "1"), ("chunks", "2"), ("chunks", "3"), ("decisions", "d")]
    pieces = splitting.oversized_pieces(decisions, chunks).collect()
    for p in pieces:
        assert len(p.text) <= 2200
        if p.item_key == "3":
            assert p.char_start is None
        elif p.item_table == "decisions" or p.item_key == "2":
            assert ("xx" + long)[p.char_start : p.char_end] == p.text
    none = splitting.oversized_pieces(decisions.limit(0), chunks.limit(0))
    assert none.count() == 0


# --- 4 --------------------------------------------------------------------------------------------------------------


def test_notations(spark):
    given = ["de", " DE", "de-CH", "german", "deu", "xx", None, ""]
    got = [r[0] for r in spark.createDataFrame([(g,) for g in given], "x string").select(proportions.language_of(F.col("x"))).collect()]
    assert got == ["de"] * 5 + [None] * 3
    dates = ["1953-12-31", "01.05.2008", "19540101", "2020", "1968-12-04T00:00:00", "0000-00-00", "s.d.", None]
    got = [r[0] for r in spark.createDataFrame([(d,) for d in dates], "x string").select(proportions.period_of(F.col("x"))).collect()]
    assert got == ["1875-1953", "2000-2009", "1954-1999", "2020+", "1954-1999", "unknown", "unknown", "unknown"]
    cantons = ["Bund", "zh", "Zürich ", "Genève", "Nirgendwo", None]
    got = [r[0] for r in spark.createDataFrame([(c,) for c in cantons], "x string").select(proportions.canton_of(F.col("x"))).collect()]
    assert got == ["CH", "ZH", "ZH", "GE", None, None]


def test_divisor_seats_are_the_smallest_priorities():
    rng = np.random.default_rng(0)
    for _ in range(30):
        targets, counts = rng.choice([0, 0.5, 1, 3, 7.5], 6), rng.integers(0, 12, 6)
        n = int(rng.integers(0, 40))
        seats = proportions.divisor_seats(targets.astype(float), counts, n)
        assert (seats <= counts).all() and seats.sum() == min(n, counts.sum())
        every = sorted(((r + 0.5) / t, c) for c, t in enumerate(targets) if t > 0 for r in range(counts[c]))
        taken = np.bincount([c for _, c in every[:n]], minlength=6)
        worst = every[min(n, len(every)) - 1][0] if every and n else 0
        sure = np.bincount([c for v, c in every if v < worst - 1e-9], minlength=6)
        assert (seats >= np.minimum(sure, taken)).all()
    assert list(proportions.divisor_seats(np.array([90, 5, 5]), np.array([500, 2, 500]), 100, np.array([3, 3, 10]))) == [88, 2, 10]
    assert proportions.divisor_seats(np.array([1, 1]), np.array([9, 9]), 3, np.array([5, 5])).sum() == 3


def _pool(spark, n=2000):
    rng = random.Random(2)
    data = []
    for i in range(n):
        data.append((f"d{i}", T(2021, 1, 1), True, rng.choice(["de"] * 12 + ["fr "] * 6 + ["it"] + [None]), rng.choice(["ZH", "Bund", "vd", None]), rng.choice(["bger", "BGE", "x"]), rng.choice(["1950", "1999-01-01", "2024-01-01", "?"])))
    data += [("d0", T(2022, 1, 1), False, "rm", "ZH", "bger", "2020"), ("BGE 1 I 1", None, True, "rm", None, None, None), (None, None, True, "de", "ZH", "x", "2000")]
    return spark.createDataFrame([(*d, "clash") for d in data], "decision_id string, indexed_at timestamp_ntz, has_full_text boolean, language string, canton string, court string, decision_date string, cell string")


def test_proportional_sample(spark):
    targets = spark.createDataFrame(
        [("language", "de", 50, 5), ("language", "fr", 40, 5), ("language", "rm", 10, 3), ("canton", "CH", 70, 1), ("canton", "VD", 30, 1), ("court", "bge", 60, 1), ("court", "bger", 40, 1), ("period", "2020+", 50, 1), ("period", "1954-1999", 50, 1), ("period", "1954-1999", 50, 1)],
        "dimension string, category string, target_pct int, min_rows int",
    )
    pool = proportions.sampling_pool(_pool(spark))
    assert pool.filter("decision_id = 'd0'").count() == 0 and pool.count() == 2000
    drawn = proportions.ProportionalSample(pool, targets)
    got = drawn.rows.collect()
    per = {}
    for r in got:
        per.setdefault(r.dimension, set()).add(r.decision_id)
    assert {d: len(v) for d, v in per.items()} == dict.fromkeys(proportions.DIMENSIONS, 400) and len(got) == 1600
    report = {(r.dimension, r.category): r for r in drawn.report.collect()}
    assert len(report) == 9 and not report["language", "rm"].can_be_met and report["language", "rm"].drawn == 1
    for key, share in {("canton", "CH"): 0.7, ("court", "bge"): 0.6, ("period", "2020+"): 0.5, ("language", "de"): 399 / 400 * 50 / 90}.items():
        assert abs(report[key].drawn / 400 - share) <= 1 / 400
    assert sum(r.floor for r in got if r.category == "fr") == 5
    unmet = drawn.report.filter("NOT can_be_met")._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" in unmet  # the ranks decide, not a count of the pool
    again = proportions.ProportionalSample(proportions.sampling_pool(_pool(spark).repartition(5)), targets)
    assert sorted(map(tuple, again.rows.collect())) == sorted(map(tuple, got))
    empty = proportions.ProportionalSample(pool.limit(0), targets)
    assert empty.rows.count() == 0 and empty.report.filter("can_be_met").count() == 0
    untargeted = proportions.ProportionalSample(pool, targets.limit(0))
    assert untargeted.rows.count() == 0 and untargeted.report.count() == 0


# --- 5 --------------------------------------------------------------------------------------------------------------


def _vectors(spark, data):
    return spark.createDataFrame([(i, v, "clash", 0) for i, v in data], "chunk_rowid long, embedding array<float>, rep string, list int")


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 64))
    data = [(i, (centres[i % 40] + 0.6 * rng.normal(size=64)).astype("f4")) for i in range(3000)]
    hot = centres[0].astype("f4")
    data += [(3000 + i, hot * (1 + i % 3)) for i in range(1500)]  # a third of the rows, in one direction
    given = [(i, [float(x) for x in v]) for i, v in data]
    given += [(10, given[10][1]), (None, given[0][1]), (9001, None), (9002, [0.0] * 64), (9003, [1.0] * 63), (9004, [float("nan")] * 64), (9005, [1.0] * 63 + [None])]
    p = neighbours.Params(per_cell=400, per_list=32, sample=1500, block=256)  # cells of several lists, some cells in parts
    ids = np.array([i for i, _ in data])
    x = np.stack([v for _, v in data])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for params, least in ((p, 0.9), (dataclasses.replace(p, exhaustive=True, sent_ids=0), 1.0)):
        got: dict = {}
        for r in neighbours.nearest(_vectors(spark, given), params).collect():
            got.setdefault(r.rowid, {})[r["rank"]] = (r.neighbour, r.similarity)
        assert set(got) == set(ids.tolist())
        assert [got[3000][k][0] for k in range(1, 6)] == [3001, 3002, 3003, 3004, 3005]  # ties: smaller ids
        assert [got[4000][k][0] for k in range(1, 6)] == [3000, 3001, 3002, 3003, 3004]
        hits = 0
        for i in range(0, 3000, 10):
            sims = x @ x[i]
            sims[i] = -2
            best = np.sort(sims)[::-1][4]
            hits += sum(sims[np.where(ids == j)[0][0]] >= best - 1e-6 for j, _ in got[i].values())
        assert hits / (300 * 5) >= least
    pairs = neighbours.similar_pairs(_vectors(spark, given[:50]), 0.9, p)
    assert all(r.rowid_a < r.rowid_b for r in pairs.collect())


@pytest.mark.parametrize("n", [0, 1, 2, 4])
def test_neighbours_of_few_rows(spark, n):
    data = [(i, [1.0 + i] + [1.0] * 63) for i in range(n)]
    assert neighbours.nearest(_vectors(spark, data)).count() == n * (n - 1)


def test_centroid_graph_finds_the_nearest():
    rng = np.random.default_rng(0)
    for lists in (300, 900):  # all centroids are entry points, or the graph is walked
        centres = neighbours.balanced_centroids(rng.normal(size=(3000, 64)).astype("f4"), lists, 1)
        queries = rng.normal(size=(200, 64)).astype("f4")
        found, _ = neighbours.CentroidGraph(centres, 24).search(queries, 48)
        assert (found[:, 0] == np.argmax(queries @ centres.T, axis=1)).mean() > 0.95


# --- 6 --------------------------------------------------------------------------------------------------------------

DE = "Die Beschwerdeführerin hat den Vertrag nicht erfüllt, weil das Gericht die Frist nicht verlängert hatte und der Mieter nicht bezahlen wollte. "
FR = "Le recourant n'a pas respecté le délai, car le tribunal avait refusé de prolonger la procédure et le locataire ne voulait pas payer le loyer. "
IT = "Il ricorrente non ha rispettato il termine, perché il tribunale aveva rifiutato di prolungare la procedura e l'inquilino non voleva pagare. "
EN = "The appellant did not comply with the deadline because the court had refused to extend the proceedings and the tenant would not pay. "


def test_languages(spark):
    data = [
        (1, "de", DE), (2, "fr", DE), (3, None, FR), (4, "it-CH", IT), (5, "de", DE + "\n" + FR * 2), (6, "??", EN), (7, "en", EN + " «in dubio pro reo» "),
        (8, "de", None), (9, None, ""), (10, None, "Kurz, ja."), (11, None, "123 456 " * 50), (2, "fr", DE), (12, "de", (DE * 3 + "\n" + FR * 3) * 20), (13, "DE ", DE + "«c'est la vie»"),
    ]
    df = spark.createDataFrame([(*d, "clash", "clash") for d in data], "id long, language string, text string, k string, stretches string")
    profiles = languages.fit_on(df, "id", "language", "text")
    found = languages.identify(df, "id", "language", "text", profiles)
    assert rows(languages.label_cases(found)) == sorted([("12", "de"), ("12", "fr"), ("2", "de"), ("3", "fr"), ("5", "de"), ("5", "fr"), ("6", "en")], key=str)
    for r in found.collect():
        assert r.confidence is None or 0 < r.confidence <= 1
        assert all(a.char_end <= b.char_start for a, b in zip(r.stretches, r.stretches[1:]))
    five = found.filter("key = '5'").first()
    assert [s.language for s in five.stretches] == ["de", "fr"] and abs(five.stretches[1].char_start - len(DE) - 1) < 3
    empty = languages.identify(df.limit(0), "id", "language", "text", languages.fit_on(df.limit(0), "id", "language", "text"))
    assert languages.label_cases(empty).count() == 0


def test_profiles_survive_wrong_labels():
    texts = [("de", DE)] * 30 + [("fr", FR)] * 30 + [("rm", DE)] * 40 + [("de", FR)] * 20
    p = languages.fit_profiles(texts)
    assert [s[0][2] for s in languages.stretches([DE, FR, IT, EN], p, languages.Params())] == ["de", "fr", "it", "en"]


# --- 7 --------------------------------------------------------------------------------------------------------------


def test_packing_plan_is_near_the_optimum():
    rng = np.random.default_rng(0)
    for histogram in (rng.integers(0, 30, 101), np.eye(101, dtype=int)[60] * 7, np.zeros(101, dtype=int), np.eye(101, dtype=int)[100] * 3):
        histogram[0] = 0
        plan = packing.pack_histogram(histogram)
        total = int((histogram * np.arange(101)).sum())
        assert plan.containers >= -(-total // 100)
        size, first, base_, each, slot = plan.arrays()
        fill: dict[int, int] = {}
        for s in range(1, 101):
            starts = np.flatnonzero(size == s)
            for rank in range(histogram[s]):
                k = starts[np.searchsorted(first[starts], rank, side="right") - 1]
                c = base_[k] + (rank - first[k]) // each[k]
                fill[c] = fill.get(c, 0) + s
        assert len(fill) == plan.containers and all(v <= 100 for v in fill.values())
    assert packing.bucket_boundaries(np.array([0, 0, 5, 0, 5, 0]), 2) == [2, 4]


def test_packing_buckets_decide_the_containers():
    rng = np.random.default_rng(3)
    histogram = np.concatenate([[0], rng.integers(0, 40, 60)])
    best = packing.pack_histogram(histogram, 4)
    assert best.padding == packing.batch_padding(histogram, best.bounds)
    for _ in range(200):  # no other boundaries leave less
        bounds = sorted({*map(int, rng.choice(np.arange(1, 60), 3, replace=False)), 60})
        assert packing.batch_padding(histogram, bounds) >= best.padding
    one, many = packing.pack_histogram(histogram, bounds=[60]), packing.pack_histogram(histogram, bounds=[20, 40, 60])
    assert one.containers == histogram.sum() and one.containers > many.containers > 0  # one bucket: one item a container
    assert many.arrays()[2].tolist() != best.arrays()[2].tolist()


def _first_fit(sizes):
    """Containers that first-fit-decreasing needs."""
    free: list[int] = []
    for size in sorted((s for s in sizes if s), reverse=True):
        place = next((i for i, room in enumerate(free) if room >= size), None)
        if place is None:
            free.append(2048 - size)
        else:
            free[place] -= size
    return len(free)


def test_packing(spark):
    rng = random.Random(0)
    texts = [" ".join(rng.choice(["Gericht", "und", "Entscheid", "Frist"]) for _ in range(rng.choice([3, 50, 400, 900]))) for _ in range(120)]
    texts += ["Satz " * 5000, "", None] + ["gleich lang hier"] * 60
    df = spark.createDataFrame([(i, t, 1, "clash") for i, t in enumerate(texts)] + [(0, texts[0], 1, "clash")], "doc_id long, text string, piece int, hash_rank string")
    got = packing.pack(df).toPandas()
    sizes = got.groupby("container_id").n_tokens.sum()
    assert sizes.max() <= 2048 and len(sizes) <= _first_fit(got.n_tokens)
    whole = got[got.doc_id == 120].sort_values("piece")
    assert list(whole.token_start) == [k * 2048 for k in range(len(whole))] and list(whole.token_end[:-1]) == list(whole.token_start[1:])
    encoder = packing.encoder(packing.VOCABULARY)
    for i in (1, 5, 120):
        tokens = encoder.encode_ordinary(texts[i])
        parts = got[got.doc_id == i].sort_values("piece")
        assert "".join(encoder.decode(tokens[a:b]) for a, b in zip(parts.token_start, parts.token_end)) == texts[i]
    assert (got[got.doc_id != 120].groupby(["doc_id", "piece"]).size().drop((0, 0)) == 1).all() and len(got[got.doc_id == 0]) == 2
    held = got[got.n_tokens > 0]
    assert not held.duplicated(["container_id", "slot"]).any() and got[got.n_tokens == 0].slot.isna().all()
    assert packing.pack(df.limit(0)).count() == 0 and packing.pack(df.filter("text = ''")).count() == 1


# --- 8 --------------------------------------------------------------------------------------------------------------


def _sentence(rng):
    return " ".join(rng.choice("der die das Gericht Frist Vertrag Miete Kläger hat war nicht am vom weil Bank Amt Urteil Zürich Basel Bern 12 37 99 1998 2004".split()) for _ in range(12)) + ". "


def test_leaks(spark):
    rng = random.Random(5)
    items = [(i, "".join(_sentence(rng) for _ in range(10)), "".join(_sentence(rng) for _ in range(8)) if i else None, "clash") for i in range(6)]
    noise = lambda n: "".join(_sentence(rng) for _ in range(n))
    edited = items[1][1].replace("Gericht", "Tribunal", 2).upper().replace("ZÜRICH", "ZÜRICH")
    broken = items[2][2][:60].replace("Vertrag", "Ver-\ntrag") + items[2][2][60:]
    docs = [
        (1, noise(20) + items[0][1] + noise(5)), (2, edited), (3, noise(3) + broken), (4, noise(40)), (5, items[3][1][: len(items[3][1]) * 2 // 3] + noise(30)),
        (6, noise(5) + items[4][1][:80]), (7, None), (8, ""), (9, items[5][2][:300] + noise(2) + items[5][2][300:]), (10, noise(20) + items[0][1]), (10, noise(20) + items[0][1]), (None, items[0][1]),
    ]
    documents = spark.createDataFrame([(*d, "clash", 1) for d in docs], "doc_id long, text string, words string, item_id int")
    tests = spark.createDataFrame([*items, (77, "", None, "clash"), (78, "ein", "wort", "clash"), (None, items[0][1], None, "clash"), items[0]], "item_id long, question string, reference string, term string")
    found = leakage.leaks(documents, tests).filter("spanned >= 0.5").select("doc_id", "item_id").distinct()
    assert rows(found) == sorted([(1, 0), (2, 1), (3, 2), (5, 3), (9, 5), (10, 0)], key=str)
    assert leakage.leaks(documents.limit(0), tests).count() == 0 and leakage.leaks(documents, tests.limit(0)).count() == 0


def test_passages_keep_the_order():
    test = [f"w{i}" for i in range(100)]
    p = leakage.Params()
    assert leakage.passages(test, test[:50] + ["x"] * 9 + test[50:], p)[0] == 1.0
    assert leakage.passages(test, test[50:] + ["x"] * 9 + test[:50], p)[0] == 0.5
    assert leakage.passages(test, test[:10] + ["x"] * 9 + test[40:50], p)[0] == 0.0
    changed = [w if i % 11 else "neu" for i, w in enumerate(test)]
    assert leakage.passages(test, changed, p)[0] > 0.95


def test_leaks_in_short_pieces(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    vocabulary = [word() for _ in range(400)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [text(160) for _ in range(4)]

    def pieces(test, size, share):
        step = round(size / share)
        return [w for i in range(0, len(test), step) for w in test[i : i + size] + text(60)]

    docs = [(i, pieces(items[i % 4], size, 0.65)) for i, size in enumerate((8, 12, 15, 19))]
    docs += [(10, pieces(items[0], 12, 0.25)), (11, text(2000)), (12, [w for i in (120, 80, 40, 0) for w in items[1][i : i + 19] + text(60)])]
    documents = spark.createDataFrame([(i, " ".join(ws)) for i, ws in docs], "doc_id long, text string")
    tests = spark.createDataFrame([(i, " ".join(ws), None) for i, ws in enumerate(items)], "item_id long, question string, reference string")
    found = leakage.leaks(documents, tests).filter("spanned >= 0.5").select("doc_id", "item_id")
    assert rows(found) == [(0, 0), (1, 1), (2, 2), (3, 3)]


def test_every_copy_of_a_passage_is_found(spark):
    """One copy of ``passage`` words is found wherever it lies in a test text of any length, and in every block of test texts."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(3)) for _ in range(60)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    items = [text(n) for n in (40, 41, 300, 1000)]
    docs = [(k, at, items[k][at : at + 20]) for k in range(4) for at in rng.sample(range(len(items[k]) - 20), 12)]
    documents = spark.createDataFrame([(i, " ".join(text(30) + part + text(30))) for i, (_, _, part) in enumerate(docs)], "doc_id long, text string")
    tests = spark.createDataFrame([(i, " ".join(ws), None) for i, ws in enumerate(items)], "item_id long, question string, reference string")
    for p in (leakage.Params(), leakage.Params(block=500)):
        found = {(r.doc_id, r.item_id) for r in leakage.leaks(documents, tests, p).filter("longest >= 20").collect()}
        assert {(i, k) for i, (k, _, _) in enumerate(docs)} <= found


# --- 9 --------------------------------------------------------------------------------------------------------------


def test_plain_undoes_disguises():
    assert toxicity.plain("Du 1d1ot, s.a.l.o.p.e, FIIIIICK! Drec​ksack am 3.4.2020") == "du idiot, salope, fick! drecksack am 00"
    assert toxicity.plain("Art. 19a OR, Fr. 1'000.–") == "art. 0a or, fr. 00.-"


def _rated(spark, n=400):
    rng = random.Random(4)
    subjects, verbs = ["Die Bank", "Der Mieter", "Das Amt", "Die Klägerin"], ["bestreitet die Forderung", "zahlte den Lohn", "kündigte den Vertrag", "legte Beschwerde ein"]
    insults = ["Du bist ein elender Schuft", "Halt den Mund, du Tölpel", "Ihr gehört alle verprügelt, ihr Pack", "Dieser Kerl ist ein Schuft und Tölpel"]
    sober = ["Der Kläger soll den Beamten als «Schuft» bezeichnet haben", "Das Wort «Tölpel» gilt nach Art. 177 als Beschimpfung"]
    ordinary = lambda k: ". ".join(f"{rng.choice(subjects)} {rng.choice(verbs)} am {rng.randint(1, 28)}. Mai {rng.randint(1990, 2024)}" for _ in range(k)) + ". "
    docs, labels, truth = [], [], {}
    for i in range(n):
        bad = i % 4 == 0
        text = ordinary(3) + (rng.choice(insults) + "! " if bad else rng.choice(sober) + ". " if i % 4 == 1 else "") + ordinary(2)
        if bad and i % 8 == 0:
            text = text.replace("Schuft", "Sch​uft").replace("Tölpel", "T Ö L P E L")
        docs.append((i, f"s{i % 3}", text))
        truth[i] = bad
        if i < n // 2:
            label = "hate" if bad else "ok"
            labels.append((i, "ok" if i % 37 == 0 else label))
    docs += [(n, "s0", None), (n + 1, None, ""), (0, "s0", docs[0][2])]
    labels += [(None, "hate"), (3, None), (1, "hate"), (1, "ok")]
    return (
        spark.createDataFrame([(*d, "clash", 0.5) for d in docs], "doc_id long, source string, text string, toxic string, score double"),
        spark.createDataFrame([(*x, 1) for x in labels], "doc_id long, label string, share int"),
        truth,
    )


def test_toxicity_on_held_out_documents(spark):
    documents, labels, truth = _rated(spark)
    scored = toxicity.score(documents, toxicity.fit_on(documents, labels)).collect()
    got = {r.doc_id: r.toxic for r in scored}
    held = [i for i in truth if i >= 200]
    assert sum(got[i] == truth[i] for i in held) / len(held) >= 0.97
    assert not got[400] and not got[401] and len(scored) == 403
    rates = {r.source: (r.documents, r.toxic) for r in toxicity.rates(toxicity.score(documents, toxicity.fit_on(documents, labels))).collect()}
    assert sum(n for n, _ in rates.values()) == 403 and set(rates) == {"s0", "s1", "s2", None}


def test_toxicity_without_labels(spark):
    documents, labels, _ = _rated(spark, 20)
    assert all(r.score == 0 for r in toxicity.score(documents, toxicity.fit_on(documents, labels.limit(0))).collect())
    assert toxicity.score(documents.limit(0), toxicity.fit_on(documents, labels)).count() == 0
