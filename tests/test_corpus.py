from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gavelgrid.functions import rewriting as rw
from gavelgrid.plans.corpus import Corpus
from gavelgrid.sources.files import page_to_text


def test_rewriting():
    assert rw.localise("nach Art. 5 OR, siehe BGE 1 I 1 und ZGB.", "fr") == "nach Art. 5 CO, siehe ATF 1 I 1 und CC."
    assert rw.rewrite_aliases("CO und COO", {"CO": "OR"}) == "OR und COO"
    assert rw.sanitised("Frist nach Art. 5 OR", "délai selon Art. 9 ZGB") == "délai selon Art. 5 OR"
    assert rw.without_unknown_articles("Klage nach Art. 5 OR, und Art. 9 ZGB.", "es gilt 5") == "Klage nach Art. 5 OR, und."
    text, table = rw.placeholders("gemäss BGE 1 I 1 und Art. 5 OR")
    assert rw.restored(text.replace("gemäss", "selon"), table) == "selon BGE 1 I 1 und Art. 5 OR"
    assert rw.option_letters("Wähle die Antwort\nA) x\nB) y\nC) z") == ["A", "B", "C"] and rw.option_letters("A) x\nB) y") == []
    assert rw.renumbered(["a [1] b [2]", "c [1]"]) == ["a [1] b [2]", "c [3]"]
    assert rw.statements("Frage\ni) eins\nii) zwei") == [("i", "eins"), ("ii", "zwei")]
    assert rw.option_statements("i and ii", ["i", "ii", "iii"]) == {"i", "ii"} and rw.option_statements("1 to 3", ["1", "2", "3", "4"]) == {"1", "2", "3"}
    assert rw.statement_scores({"i": True}, rw.truth_key({"i"}, ["i", "ii"], False)) == (0.5, 0.5)
    assert rw.recovered_json('```json\n{"a": 1}\n```') == {"a": 1} and rw.recovered_json('{"a": 1, "b": [1, 2') == {"a": 1} and rw.recovered_json("nein") == {}
    assert rw.search_terms("Kündigung der Wohnung", (2020, 3, 4))[0] == "4.3.2020"
    assert rw.file_name("/tmp/a b.pdf?x") == "a_b.pdf" and rw.duration(3725) == "1:02:05"
    assert rw.court_label("zh_obergericht", {"zh": "Zürich"}) == "Zürich Obergericht"
    assert rw.protected_phrases("Treu und Glauben gilt", {"bonne foi": ["treu und glauben"]}) == {"treu und glauben": "bonne foi"}
    assert rw.memo("T", [("A", ["x [1]"]), ("B", ["y [1]"])], ["s"]).count("[2]") == 1


def test_column_of(spark):
    df = spark.createDataFrame([("a  OR",), (None,)], "t string")
    assert [r[0] for r in df.select(rw.column_of(lambda t: rw.localise(t, "fr"))(F.col("t"))).collect()] == ["a  CO", None]


def test_page_to_text(spark):
    page = [("heading", 2, "Titel"), ("page_footer", None, "3"), ("list_item", None, "Punkt"), ("text", None, "Satz"), ("text", None, " ")]
    df = spark.createDataFrame([(page,)], "e array<struct<type:string,level:int,text:string>>")
    assert df.select(page_to_text(F.col("e"))).first()[0] == "## Titel\n\n- Punkt\n\nSatz"


@pytest.fixture(scope="module")
def corpus(spark):
    return Corpus(spark, "/root/testdata/sf0.001")


def test_filters(corpus):
    everything = corpus.decisions().count()
    assert corpus.decisions(language=["de"]).count() < everything and corpus.decisions(language=[]).count() == 0
    assert corpus.decisions(language=None).count() == everything
    with pytest.raises(ValueError):
        corpus.decisions(colour=["red"])
    assert sum(r.n for r in corpus.count_decisions("court").collect()) == everything


def test_search_and_read(corpus):
    hits = corpus.keyword_search('"der Mieter"', k=5).collect()
    assert [h["rank"] for h in hits] == list(range(1, len(hits) + 1)) and hits
    assert corpus.keyword_search("??").count() == 0
    assert corpus.broad_search("Mieter Kaution", k=3).count() == 3
    first = corpus.decisions().filter("full_text IS NOT NULL").first()
    page = corpus.read_decision(first.decision_id, size=50).first()
    assert len(page.page) <= 50 and corpus.read_decision("BGE 999 I 1").count() == 0
    vector = corpus.table("passage_vectors").filter("embedding IS NOT NULL AND chunk_rowid = 3").first()
    if vector is not None:
        assert corpus.similar_passages(vector.embedding, k=1).first().id == 3
    assert corpus.search_laws("Vertrag Mieter", k=2).count() <= 2
    assert corpus.citing_decisions("BGE 199 III 159", limit=3).count() <= 3
    assert corpus.list_decisions(limit=4).count() == 4 and corpus.list_values("court").count() > 3
    assert corpus.search_case_file("casefile_a", "Kaution hinterlegt").count() <= 10
