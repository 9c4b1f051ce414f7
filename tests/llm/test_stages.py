"""What the filtering stages do with names, repeats and missing ratings."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vitrina.llm import langid, minhash, quality
from vitrina.session import materialize

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ["__language", "__grading", "__key", "__node", "__LANGUAGE_", "id", "node", "n", "text_", "label"]


def docs(spark, rows):
    frame = spark.createDataFrame(rows, DOCS)
    return frame.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHING)])


ROWS = [
    (1, "the cat sat on the mat with the dog and the other cat of the house", "en", "a", 0),
    (2, "der Hund und die Katze sind in dem Haus und der Garten ist auch da", "de", "a", 0),
    (2, "die Katze ist nicht in dem Garten und der Hund ist in dem Haus", "de", None, 0),
    (2, "der Hund und die Katze sind in dem Haus und der Garten ist auch da", "de", "a", 0),
    (None, None, None, None, None), (None, "", "en", "b", 0), (3, "the cat sat on the mat with the dog and the other cat of the house", "en", "b", 0),
]


def test_columns_of_any_name_stay(spark):
    frame = docs(spark, ROWS)
    model = langid.fit(frame)
    found = langid.accepted(frame, model)
    assert found.columns == frame.columns and {tuple(r) for r in found.collect()} <= {tuple(r) for r in frame.collect()}
    ratings = spark.createDataFrame([(1, 2), (2, 0)], "doc_id long, grade int")
    found = quality.selected(frame, quality.fit(frame, ratings, 3))
    assert found.columns == frame.columns and set(found.select("doc_id").toPandas().doc_id.dropna()) >= {1, 3}
    found = minhash.one_of_each(frame)
    kept = [tuple(r) for r in found.collect()]
    assert found.columns == frame.columns and set(kept) <= {tuple(r) for r in frame.collect()}
    # Of equal texts one stays, of different texts with one id both, and texts without words.
    assert sorted((r[0] is not None, r[0] or 0, r[1] or "") for r in kept) == [
        (False, 0, ""), (False, 0, ""), (True, 1, ROWS[0][1]), (True, 2, ROWS[1][1]), (True, 2, ROWS[2][1]),
    ]


def test_without_ratings_all_rows_stay(spark):
    frame = docs(spark, ROWS)
    for rows in ([], [(99, 2)], [(None, 1), (1, 7)]):
        model = quality.fit(frame, spark.createDataFrame(rows, "doc_id long, grade int"), 3)
        assert not model.trained and quality.selected(frame, model).count() == len(ROWS)


def test_repeated_ids_train_alike(spark):
    rows = [(i % 4, f"text number {i} of many words and signs {i * 7}", "en", "a", 0) for i in range(40)]
    ratings = spark.createDataFrame([(i, i % 3) for i in range(4)], "doc_id long, grade int")
    fits = [quality.fit(docs(spark, rows[::step]).repartition(n), ratings, 3) for step, n in ((1, 1), (-1, 5), (1, 7))]
    assert all((m.weights == fits[0].weights).all() for m in fits)


def test_dictionaries_take_from_every_text():
    parts = [bytes([65 + i]) * n for i, n in enumerate((5, 100, 100, 40))]
    assert langid._joined(parts, 1000) == b" ".join(parts) + b" "
    cut = langid._joined(parts, 100)
    assert len(cut) <= 100 and [cut.count(bytes([65 + i])) for i in range(4)] == [5, 30, 30, 30]
    assert langid._joined([], 10) == b""


@pytest.mark.parametrize("rows", [[], ROWS])
def test_pipeline_on_odd_tables(spark, rows, tmp_path):
    """Empty tables, no labels, null ids, repeated rows and extra columns run through all stages."""
    frame = docs(spark, rows)
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        now = materialize(stage(spark, now, str(tmp_path)), "stage")
        assert name == "packing" or now.columns == frame.columns
    assert (now.count() > 0) == bool(rows)
