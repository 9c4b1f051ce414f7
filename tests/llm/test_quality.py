import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from vitrina.llm import quality
from vitrina.llm.common import table
from vitrina.llm.queries import GRADES, ratings


def test_held_out_selection(spark):
    sf_dir = "/root/testdata/sf0.1"
    docs, rated = table(spark, sf_dir, "documents"), ratings(spark, sf_dir)
    known = rated.where("doc_id % 4 <> 0")
    model = quality.fit(docs, known, GRADES)
    assert model.thresholds[0] < model.thresholds[1]
    found = docs.select("doc_id", quality.grading(model, F.col("text")).alias("g")).join(rated.where("doc_id % 4 = 0"), "doc_id").toPandas()
    p = np.array([g["p_top"] for g in found.g])
    grade = found.grade.to_numpy()
    assert ((p >= 0.5) == (grade == 2)).mean() > 0.96
    assert (p[grade == 2] >= 0.5).mean() > 0.98
    expected = np.array([g["expected_grade"] for g in found.g])
    assert expected[grade == 0].mean() < expected[grade == 1].mean() < expected[grade == 2].mean()


def test_gradient_reaches_separable_grades():
    texts = pa.array(["bad bad words"] * 20 + ["so so text"] * 20 + ["fine good prose"] * 20)
    grade = np.repeat([0, 1, 2], 20)
    model = quality.fit_ordinal(*quality.features(texts), grade, 3)
    above = model.above(model.score(texts))
    assert ((above > 0.5).sum(axis=1) == grade).all()
    # Probabilities of higher grades never exceed those of lower ones.
    assert (above[:, 0] >= above[:, 1]).all()


def test_edges(spark, docs_of):
    docs = docs_of([(1, None), (2, ""), (3, "good text here"), (3, "good text here"), (None, "good"), (4, "bad " * 50_000)])
    rated = spark.createDataFrame([(3, 2), (3, 1), (4, 0), (None, 1), (9, 2), (2, None), (1, 7)], "doc_id long, grade int")
    model = quality.fit(docs, rated, 3)
    kept = quality.selected(docs, model, 0.0)
    assert kept.columns == docs.columns and kept.count() == 6
    untrained = quality.fit(docs, rated.limit(0), 3)
    assert not untrained.weights.any()
    assert quality.selected(docs.limit(0), model).count() == 0
    row, feature, value = quality.features(pa.array([None, "", "the the cat's 42!"]))
    assert set(row) == {2} and quality.DIMENSIONS in feature and (value > 0).all()


def test_the_fit_multiplies_a_piece_at_a_time():
    rng = np.random.default_rng(5)
    n, rows = 6_000_000, 9_000
    row = np.sort(rng.integers(0, rows, n).astype(np.int32))
    feature, value = rng.integers(0, quality.DIMENSIONS, n).astype(np.int32), rng.random(n).astype(np.float32)
    grade = rng.integers(0, 3, rows)
    tracemalloc.start()
    try:
        model = quality.fit_ordinal(row, feature, value, grade, 3, steps=1)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    # Less than one wide number for each entry, beside vectors of one number for each feature.
    assert peak < 8 * n
    mixed = rng.permutation(n)
    assert (quality.fit_ordinal(row[mixed], feature[mixed], value[mixed], grade, 3, steps=1).weights - model.weights < 1e-9).all()


def test_portions_of_a_batch():
    step = quality.STEP_CHARS
    texts = pa.array(["a" * (step // 2), None, "b" * (step // 2), "c" * (3 * step), "", "d"])
    cuts = list(quality.portions(texts))
    assert [a for a, _ in cuts[1:]] == [b for _, b in cuts[:-1]] and cuts[0][0] == 0 and cuts[-1][1] == len(texts)
    assert all(sum(len(t.as_py() or "") for t in texts[a:b]) <= step or b == a + 1 for a, b in cuts)
    assert list(quality.portions(texts[:0])) == []
