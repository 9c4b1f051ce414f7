import itertools
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from vitrina.functions import text as tx


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}").repartition(2)
    return [r.y for r in df.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]


def test_normalize_text_edges(spark):
    expected = {
        None: "", "": "", "Leche 350 ml · Entera": "leche ml entera", "ﬁno ½ kilo": "fino kilo",
        "café con leche": "café con leche", "ver https://a.b/c?d=1 ya": "ver ya", "www.tienda.es/x y": "y",
        "a_b/c-d": "a b c d", "a\tb\x1cc\x85d": "a b c d", "ＡＢＣ  ¡Olé!": "abc olé", "x² y³": "x y",
    }
    assert column(spark, list(expected), tx.normalize_text) == list(expected.values())


def test_stop_words_are_the_published_list(spark):
    from checks.oracle import STOP_WORDS
    from vitrina.functions.spanish import spanish_stop_words

    assert spanish_stop_words() == set(STOP_WORDS)


def test_stop_words_have_no_stem(spark):
    from vitrina.functions.spanish import lexemes

    rows = spark.createDataFrame([("Él no tuviéramos las mesas",)], "t string").select(lexemes(F.col("t")).alias("l"))
    assert rows.first().l == [None, None, None, None, "mes"]


def test_nfkc_shortcut_covers_stable_characters_only():
    stable = re.compile(tx.NFKC_STABLE)
    for code in range(0x3000):
        c = chr(code)
        if stable.match(c):
            assert unicodedata.normalize("NFKC", c) == c and not unicodedata.combining(c)


def test_strip_and_content(spark):
    values = ["  a b ", " x ", "　", "", None, "\x1c\x85y z\n"]
    assert column(spark, values, tx.strip) == ["a b", "x", "", "", None, "y z"]
    assert column(spark, values, tx.has_content) == [True, True, False, False, False, True]
    assert column(spark, values, tx.clean_string) == ["a b", "x", None, None, None, "y z"]


def test_compose_text_all_combinations(spark):
    rows = list(itertools.product(["N", ""], ["S", None], ["C", ""], ["D", None]))
    df = spark.createDataFrame(rows, "product_name string, store_name string, collection_section string, product_description string")
    got = [r.t for r in df.select(tx.compose_text().alias("t")).collect()]
    expected = [
        ((n or "") + (" · S" if s else "") + (" · C" if c else "") + (". D" if d else "")).strip(" ") for n, s, c, d in rows
    ]
    assert got == expected
    assert "· S · C. D" in got


def test_normalize_label(spark):
    values = [None, "None", "Bebidas 500 ml", "Pack 6 g", "¡¡!!", "Pan  de (molde) 1 kg integral"]
    assert column(spark, values, tx.normalize_label)[:2] == ["none", "none"]
    names = column(spark, values, lambda c: tx.normalize_label(c, product_name=True))
    assert names == ["none", "none", "bebidas", "", "", "pan de molde"]


def test_object_url_keeps_leading_blank(spark):
    from vitrina.operators.ingest import prepare_load

    df = spark.createDataFrame([(" a/b.png ",), ("",), ("  ",), (None,)], "s3_path string")
    rows = prepare_load(df, "shelf").select("s3_path", "s3_url").collect()
    assert [tuple(r) for r in rows] == [("a/b.png", "s3://shelf/ a/b.png"), (None, None), (None, None), (None, None)]


def test_object_location(spark):
    df = spark.createDataFrame(
        [("s3://other/k/x.png", None), ("k/y.png", None), (None, "k/z.png")], "s3_url string, s3_path string"
    )
    got = [tuple(r.o) for r in df.select(tx.object_location("shelf").alias("o")).collect()]
    assert got == [("other", "k/x.png"), ("shelf", "k/y.png"), ("shelf", "k/z.png")]


def test_text_template(spark):
    df = spark.createDataFrame([("Pan", "De molde"), ("Pan", None)], "product_name string, product_description string")
    got = [r.t for r in df.select(tx.text_template(prefix="a product photo of ").alias("t")).collect()]
    assert got == ["a product photo of Pan. De molde", "a product photo of Pan"]


@pytest.mark.parametrize("text", ["", "a", "ab  cd"])
def test_normalize_is_idempotent(spark, text):
    once = column(spark, [text], tx.normalize_text)
    assert column(spark, once, tx.normalize_text) == once
