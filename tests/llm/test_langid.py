from pyspark.sql import functions as F

from vitrina.llm import langid
from vitrina.llm.common import table
from vitrina.llm.queries import LLM_QUERIES


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    found = LLM_QUERIES["op3_language"](spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    rows = found.collect()
    held_out = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and 250 < len(held_out) < 420
    assert sum(r.lang == r.lang_pred for r in held_out) / len(held_out) > 0.97
    assert sum(r.rejected for r in rows) / len(rows) < 0.02
    assert all(0 <= r.score <= 1 for r in rows)


def test_edges(spark, docs_of):
    english = "the house of the man and the dog was there with all of them "
    german = "das haus und der hund des mannes waren mit allen dort und nicht "
    rows = [(1, english * 3, "en"), (2, german * 3, "de"), (3, "x", None), (4, None, "en"), (5, english * 3, "en")]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(labelled)
    assert [name for name, _ in model.dictionaries] == ["de", "en"]
    docs = docs_of([(1, None), (2, ""), (3, "12 ² Ⅷ !!"), (4, english), (5, german), (6, german * 2000), (6, german * 2000), (7, "퟿")])
    found = {r.doc_id: r.p for r in docs.select("doc_id", langid.prediction(model, F.col("text")).alias("p")).collect()}
    assert [found[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and found[1].score == 0
    assert found[4].lang_pred == "en" and found[5].lang_pred == found[6].lang_pred == "de"
    kept = langid.accepted(docs, model)
    assert kept.columns == docs.columns
    assert {4, 5, 6} <= {r.doc_id for r in kept.collect()} and not {1, 2, 3} & {r.doc_id for r in kept.collect()}
    nothing = langid.fit(labelled.limit(0))
    assert nothing.dictionaries == ()
    assert {r.p.lang_pred for r in docs.select(langid.prediction(nothing, F.col("text")).alias("p")).collect()} == {"und"}
    assert langid.accepted(docs.limit(0), model).count() == 0


def test_narrow_margins_are_rejected():
    model = langid.LanguageModel((("a", b"same words here "), ("b", b"same words here ")))
    name, score, margin, rejected = model.open()("same words")
    assert (name, score, margin, rejected) == ("a", 0.5, 0.0, True)
