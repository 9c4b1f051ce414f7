import re

import pytest
from pyspark.sql import functions as F

from vitrina.functions.encoders import HashingEncoder
from vitrina.functions.spanish import stem
from vitrina.operators import fusion, lexical
from vitrina.plans.search import hybrid_search

STEMS = {
    "productos": "product", "chocolate": "chocolat", "azúcar": "azuc", "energéticas": "energet", "bebidas": "beb",
    "galletas": "gallet", "integrales": "integral", "colección": "coleccion", "bogotá": "bogot",
    "chicharrones": "chicharron", "torneado": "torn", "cheques": "chequ", "chequeo": "cheque", "haciéndola": "hac",
    "paguemos": "pag", "claramente": "clar", "negativamente": "negat", "posiblemente": "posibl",
    "habilidad": "habil", "actividades": "activ", "solución": "solucion", "distribución": "distribu",
    "biología": "biolog", "existencia": "existent", "contribuyendo": "contribu", "diciéndoselo": "dic",
    "torpemente": "torpement", "que": "que", "a": "a", "": "",
}


@pytest.mark.parametrize("word", STEMS)
def test_stem(word):
    assert stem(word) == STEMS[word]


def items(spark, texts):
    return spark.createDataFrame(
        [(i, None, t) for i, t in enumerate(texts)], "id long, product_name string, product_description string"
    )


def queries(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")


def test_recorded_cover_density(spark):
    """Stems at positions 8, 12 and 21: one cover with eleven other words."""
    row = spark.createDataFrame([(
        11983, "Mini Chök Vegano",
        "Chök artesano elaborado con productos veganos, espolvoreados con azúcar glas y relleno con crema de "
        "avellana y chocolate vegano",
    )], "id long, product_name string, product_description string")
    got = lexical.lexical_search(queries(spark, "productos con chocolate sin azúcar"), row).collect()
    assert [(r.id, r["rank"]) for r in got] == [(11983, 1)]
    assert got[0].lex_score == pytest.approx(0.1 / 12)


def brute_density(words, terms):
    hits = [(p, w) for p, w in enumerate(words) if w in terms]
    spans = set()
    for i in range(len(hits)):
        for j in range(i, len(hits)):
            if {w for _, w in hits[i:j + 1]} == terms:
                spans.add((i, j))
                break
    minimal = [s for s in spans if not any(o != s and o[0] >= s[0] and o[1] <= s[1] for o in spans)]
    return sum(0.1 / (1 + hits[j][0] - hits[i][0] - (j - i)) for i, j in minimal)


def test_cover_density_against_enumeration(spark):
    import random

    rng = random.Random(4)
    texts = [" ".join(rng.choice("xa xb xc xd xe".split()) for _ in range(rng.randint(3, 30))) for _ in range(60)]
    asked = ["xa xb", "xc", "xa xb xc xd", "xe xe xa"]
    got = lexical.cover_density_rank(queries(spark, *asked), items(spark, texts), stem=False).collect()
    scores = {(r.query_id, r.id): r.lex_score for r in got}
    expected = {}
    for q, text in enumerate(asked):
        terms = set(text.split())
        for i, t in enumerate(texts):
            if terms <= set(t.split()):
                expected[q, i] = brute_density(t.split(), terms)
    assert scores.keys() == expected.keys()
    for key, value in expected.items():
        assert scores[key] == pytest.approx(value)


def test_stop_words_keep_positions_and_match_nothing_alone(spark):
    rows = lexical.analyze_text(items(spark, ["", "Pan con leche", "¡de la y!"]), lexical.search_text())
    assert sorted((r.id, r.pos, r.term) for r in rows.collect()) == [(1, 1, "pan"), (1, 3, "lech")]
    found = lexical.lexical_search(queries(spark, "con de la", "pan"), items(spark, ["pan con de la"]))
    assert [r.query_id for r in found.collect()] == [1]


def test_postings_answer_like_the_texts(spark):
    texts = ["pan de leche", "leche y pan integral pan", "agua", "pan pan pan leche leche"]
    asked = queries(spark, "leche pan", "agua")
    postings = lexical.build_postings(items(spark, texts), lexical.search_text())
    direct = lexical.lexical_search(asked, items(spark, texts)).select("query_id", "id", "rank").collect()
    assert sorted(direct) == sorted(lexical.lexical_search(asked, postings=postings).select("query_id", "id", "rank").collect())


def test_postings_are_gathered_once_for_all_queries(spark):
    """A document's postings are one row, not one for each query that asks for a term of them."""
    texts = ["pan de leche", "leche y pan integral pan", "agua", "pan pan pan leche leche"]
    asked = queries(spark, *["leche pan"] * 40, "agua", "pan")
    postings = lexical.build_postings(items(spark, texts), lexical.search_text())
    found = lexical.match_all_terms(asked, postings=postings)
    assert "query_id" not in found._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow", 1)[1].split("\n", 1)[1]
    order = ["query_id", "id"]
    assert found.orderBy(order).collect() == lexical.match_all_terms(asked, items(spark, texts)).orderBy(order).collect()
    # Two rows of one id count for one document.
    halves = spark.createDataFrame([(7, None, "pan"), (7, None, "leche"), (8, None, "pan")], items(spark, texts).schema)
    both = lexical.match_all_terms(queries(spark, "leche pan"), postings=lexical.build_postings(halves, lexical.search_text()))
    assert [r.id for r in both.collect()] == [7]


def test_large_batches_are_worked_through_in_pieces(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(lexical, "PIECE_BYTES", 100)
    monkeypatch.setattr(lexical, "PIECE_ROWS", 7)
    texts = [None if i % 9 == 0 else "x" * (i * 13 % 250) for i in range(60)]
    batch = pa.record_batch({"id": list(range(60)), "text": pa.array(texts, pa.string())})
    pieces = list(lexical._pieces(iter([batch, batch.slice(0, 0)])))
    assert pa.Table.from_batches(pieces).to_pydict() == pa.Table.from_batches([batch]).to_pydict()
    assert all(p.num_rows <= 7 for p in pieces)
    # The last text of a piece may reach beyond its end.
    assert all(sum(len(t or "") for t in p.column(1).to_pylist()[:-1]) <= 100 for p in pieces)


def test_recorded_fusion_ties(spark):
    """Lexical 1 precedes vector 1 at the same score; the last vector row falls off."""
    lex = spark.createDataFrame([(0, 11983, 0.00833333, 1)], "query_id long, id long, lex_score double, rank int")
    vec = spark.createDataFrame(
        [(0, 100 + i, 1.0 - i / 100, i + 1) for i in range(20)], "query_id long, id long, score double, rank int"
    )
    rows = fusion.rrf_fusion(lex, vec.repartition(3), 20).orderBy("rank").collect()
    assert [r.id for r in rows] == [11983] + [100 + i for i in range(19)]
    assert rows[0].hybrid_score == rows[1].hybrid_score == 0.01639344262295082
    assert [r.hybrid_score for r in rows[1:]] == [pytest.approx(1 / (60 + n)) for n in range(1, 20)]


def test_fusion_shared_fields_and_blend(spark):
    lex = spark.createDataFrame([(0, 1, 0.4, 1, "old"), (0, 2, 0.2, 2, "two")], "query_id long, id long, lex_score double, rank int, name string")
    vec = spark.createDataFrame([(0, 1, 0.9, 1, "new"), (1, 5, 0.9, 1, "five")], "query_id long, id long, score double, rank int, name string")
    rows = {(r.query_id, r.id): r for r in fusion.rrf_fusion(lex, vec, shared=["name"]).collect()}
    assert rows[0, 1].name == "new" and rows[0, 2].name == "two"
    assert rows[0, 1].hybrid_score == pytest.approx(2 / 61)
    blend = {(r.query_id, r.id): r.hybrid_score for r in fusion.blend_fusion(lex, vec).collect()}
    assert blend == {(0, 1): 1.0, (0, 2): 0.0, (1, 5): 0.5}


def test_hybrid_search_answer_and_trace(spark):
    catalogue = spark.createDataFrame([
        (1, "Galletas de avena", "Galletas integrales sin azúcar", [1.0, 0.0]),
        (2, "Leche", "Leche entera", [0.0, 1.0]), (3, None, "Galleta", None),
    ], "id long, product_name string, product_description string, v array<float>")
    asked = queries(spark, "galletas integrales sin azúcar", "  ", "zumo")
    result = hybrid_search(asked, catalogue, "v", HashingEncoder(2), k=2)
    named = result.fused.join(catalogue.select("id", "product_name"), "id")
    answers = {r.query_id: r.answer for r in fusion.answer_summary(asked, named).collect()}
    assert answers[0].startswith("Resultados top: Galletas de avena")
    assert answers[1] == "Debe proporcionar texto de consulta."
    traces = {r.query_id: r for r in fusion.trace(
        asked, result.lexical, result.vector, result.fused, {"k": 2, "ef_search": 40}
    ).collect()}
    assert traces[1].error == "empty_text" and traces[1].final is None
    assert traces[0].final[0].id == 1 and traces[0].params.k == 2
    assert len(traces[2].vector_top) == 2 and traces[2].lexical_top is None


def test_answer_without_results(spark):
    asked = queries(spark, "nada")
    none = spark.createDataFrame([], "query_id long, rank int, product_name string")
    assert fusion.answer_summary(asked, none).first().answer == "Resultados top: sin resultados"


def test_rank_limit_is_applied_before_the_shuffle(spark):
    scored = spark.range(100).select((F.col("id") % 3).alias("query_id"), "id", F.rand(1).alias("s"))
    plan = lexical._best(scored, "s", 5)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"WindowGroupLimit", plan)


def test_blank_queries_have_one_rule(spark):
    from vitrina.operators import fusion

    queries = spark.createDataFrame([(1, "\t"), (2, " "), (3, None), (4, "x")], "query_id long, text string")
    none = spark.createDataFrame([], "query_id long, id long, rank int, lex_score double, score double, lex_rank int, vec_rank int, hybrid_score double, product_name string")
    answers = {r.query_id: r.answer for r in fusion.answer_summary(queries, none).collect()}
    errors = {r.query_id: r.error for r in fusion.trace(queries, none, none, none, {"k": 1}).collect()}
    assert all((answers[i] == fusion.BLANK_QUERY) == (errors[i] == "empty_text") for i in (1, 2, 3, 4))
    assert errors[1] == "empty_text" and errors[4] is None


def test_blocks_of_queries_agree(spark, monkeypatch):
    from vitrina.operators import lexical

    items = spark.createDataFrame([(i, f"pan blanco {i % 3} leche", f"texto {i % 5} con agua") for i in range(40)], "id long, product_name string, product_description string")
    queries = spark.createDataFrame([(1, "pan leche"), (2, "agua"), (3, "pan vino"), (4, "de la"), (5, "blanco texto")], "query_id long, text string")
    run = lambda: [sorted(map(str, f(queries, items).collect())) for f in (lexical.lexical_search, lexical.bm25_search)]
    whole = run()
    monkeypatch.setattr(lexical, "BLOCK_CHARS", 8)
    assert run() == whole and whole[0]
    with pytest.raises(ValueError):
        lexical.bm25_search(queries, postings=lexical.build_postings(items, lexical.search_text()))


def test_encoder_sees_pending_texts_only(spark, tmp_path):
    from dataclasses import dataclass

    import numpy as np

    from vitrina.operators import backfill

    @dataclass(frozen=True)
    class Counting:
        folder: str
        dim: int = 2

        def open(self):
            import os
            import uuid

            def encode(texts):
                with open(os.path.join(self.folder, uuid.uuid4().hex), "w") as out:
                    out.write(str(len(texts)))
                return np.ones((len(texts), 2))

            return encode

    rows = [(i, f"name {i}", None if i % 20 == 0 else [1.0, 0.0]) for i in range(100)]
    products = spark.createDataFrame(rows, "id long, product_name string, v array<float>").withColumns(
        {c: F.lit(None).cast("string") for c in ("store_name", "collection_section", "product_description")}
    )
    filled = backfill.embed_backfill(products, "v", Counting(str(tmp_path))).collect()
    assert all(r.v is not None for r in filled)
    assert sum(int(p.read_text()) for p in tmp_path.iterdir()) == 5
