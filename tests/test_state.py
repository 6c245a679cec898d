"""Stored runs, published versions, jobs, grading and the wording functions on small cases."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gavelgrid.functions import rewriting
from gavelgrid.operators import chunking, evaluation, vectors
from gavelgrid.session import checkpointed
from gavelgrid.sources import files
from gavelgrid.streaming import events as streams


def test_versions_are_never_replaced(spark, tmp_path):
    target = str(tmp_path / "table")
    assert streams.read_version(spark, target) is None and streams.newest_version(spark, target) is None
    for name, n in (("v1", 3), ("v2", 5)):
        streams.publish_version(spark.range(n), target, name)
    assert streams.read_version(spark, target).count() == 5 and files.list_names(spark, f"{target}/_versions") == ["v1", "v2"]
    spark.range(9).write.parquet(f"{target}/v3")  # a crash before the marker
    assert streams.read_version(spark, target).count() == 5
    for name in ("", "_x", "a/b"):
        with pytest.raises(ValueError):
            streams.publish_version(spark.range(1), target, name)


def test_cached_run_and_report(spark, tmp_path):
    calls = []
    compute = lambda: calls.append(1) or spark.range(4)
    assert [files.cached_run(spark, str(tmp_path / "run"), compute).count() for _ in range(2)] == [4, 4] and len(calls) == 1
    files.write_report(spark.range(2), str(tmp_path / "report"), {"k": 5})
    files.write_report(spark.range(2), str(tmp_path / "report"), {"k": 6})
    assert len(files.list_names(spark, str(tmp_path / "report"))) == 2


def test_read_cases(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "a.yaml").write_text("- {id: 1, suite: s, question: q, rubric: [x, 2]}\n- {id: 2, suite: t}\n", encoding="utf-8")
    assert [tuple(r) for r in files.read_cases(spark, [str(tmp_path / "a.yaml")], "s").collect()] == [("1", "s", "q", None, ["x", "2"])]


def test_jobs_and_deltas(spark, tmp_path):
    now = dt.datetime(2024, 1, 1, 12)
    jobs = spark.createDataFrame([(1, None), (2, now - dt.timedelta(minutes=30)), (3, now - dt.timedelta(minutes=31))], "id int, done timestamp_ntz")
    assert sorted(r.id for r in streams.unexpired(jobs, "done", F.lit(now).cast("timestamp_ntz")).collect()) == [1, 2]
    manifest = spark.createDataFrame([("2024-01-02", "b"), ("2024-01-01", "a"), ("2024-01-03", "c")], "date string, path string")
    assert [r.path for r in streams.pending_deltas(manifest, "2024-01-01", "2023-12-01").collect()] == ["b", "c"]
    assert [r.path for r in streams.pending_deltas(manifest, None, "2024-01-02").collect()] == ["c"]
    spark.range(5).write.parquet(str(tmp_path / "in"))
    seen = []
    for _ in range(2):
        streams.drain(spark.readStream.schema("id long").parquet(str(tmp_path / "in")), lambda batch, _: seen.append(batch.count()), str(tmp_path / "cp"))
    assert sum(seen) == 5


def test_grading_and_severity(spark):
    df = spark.createDataFrame([(True, True), (False, True), (False, False)], "e boolean, c boolean")
    assert [r[0] for r in df.select(evaluation.grading(F.col("e"), F.col("c"))).collect()] == ["unjudged", "exact", "judge"]
    flags = [(False, True, False, True, True), (True, False, False, True, True), (True, True, True, True, True), (True, True, False, False, True), (True, True, False, True, True), (True, True, False, True, False)]
    df = spark.createDataFrame(flags, "a boolean, b boolean, c boolean, d boolean, e boolean")
    assert [r[0] for r in df.select(evaluation.severity(*map(F.col, "abcde"))).collect()] == [5, 5, 5, 5, 2, 3]


def test_statutes_are_a_section_of_their_own(spark):
    df = spark.createDataFrame([(1, "Art. 1 OR\nZum Abschlusse eines Vertrages ist die übereinstimmende Willensäusserung erforderlich."), (2, None), (3, "")], "id int, t string")
    assert {r.section for r in chunking.chunk_documents(df, "id", "t", section="law").collect()} == {"law"}


def test_hashed_encoder(spark):
    df = spark.createDataFrame([("Miete Frist",), ("frist miete",), ("",), (None,)], "t string")
    a, b, c, d = (r[0] for r in df.select(vectors.hashed_encoder(16)("t")).collect())
    assert a == b and abs(sum(x * x for x in a) - 1) < 1e-6 and c == d == [0.0] * 16


def test_exact_search_edges(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [0.5, 0.5], "a"), (3, [0.0, 1.0], None), (4, None, "b"), (5, [1.0], "b"), (None, [1.0, 1.0], "a")], "id long, v array<double>, s string")
    queries = rows.filter("id IN (1, 2)")
    pairs = lambda df: sorted((r.query, r.id) for r in df.collect())
    assert pairs(vectors.exact_knn(queries, rows, "id", "v", 2)) == [(1, 2), (1, 3), (2, 1), (2, 3)]
    assert pairs(vectors.exact_knn(queries, rows, "id", "v", None, min_score=0.4)) == [(1, 2), (2, 1), (2, 3)]
    assert pairs(vectors.exact_knn(queries, rows, "id", "v", 5, segment="s")) == [(1, 2), (2, 1)]
    assert vectors.exact_knn(queries.filter("id > 9"), rows, "id", "v", None, min_score=0.0).count() == 0
    with pytest.raises(ValueError):
        vectors.exact_knn(queries, rows, "id", "v", None)


def test_wording():
    assert rewriting.localise("Art. 41 OR und BGE 1 I 2. Nach CPC.", "fr") == "Art. 41 CO und ATF 1 I 2. Nach CPC."
    assert rewriting.rewrite_aliases("CO, COX, ATF", {"CO": "OR", "ATF": "BGE"}) == "OR, COX, BGE"
    assert rewriting.sanitised("Art. 41 OR Haftung", "responsabilité Art. 99 CC") == "responsabilité Art. 41 OR"
    assert rewriting.without_unknown_articles("Nach Art. 41 OR haftet er (Art. 97 OR).", "Art. 41") == "Nach Art. 41 OR haftet er."
    assert rewriting.renumbered(["a [1] [2]", "b [1]"]) == ["a [1] [2]", "b [3]"]
    assert rewriting.option_letters("Wähle:\nA) x\nB) y\nC) z") == ["A", "B", "C"] and rewriting.option_letters("A) x\nB) y") == []
    assert rewriting.statements("Frage\n1. eins\n2. zwei") == [("1", "eins"), ("2", "zwei")]
    assert rewriting.court_label("be_obergericht", {"be": "Bern"}) == "Bern Obergericht"
    assert rewriting.recovered_json('{"a": 1, "b": "x') == {"a": 1}
    assert chunking.first_sentence("Nach Art. 5 gilt das nicht mehr. Weiter") == ("Nach Art. 5 gilt das nicht mehr.", "Weiter")
    assert evaluation.mcnemar(0, 0) == 1.0 and abs(evaluation.mcnemar(1, 8) - 0.0390625) < 1e-12


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext, conf = Context(), spark.conf

    class Frame:
        sparkSession = Session()

    if spark.conf.get("spark.checkpoint.dir", None) is None:
        with pytest.raises(ValueError):
            checkpointed(Frame())
