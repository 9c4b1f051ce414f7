import math

import pytest
from pyspark.sql import functions as F

from vitrina.functions import vectors as vx
from vitrina.operators.backfill import embed_backfill, encode_images, merge_embeddings, pending_count, reset_column
from vitrina.functions.encoders import HashingEncoder
from vitrina.schema import pick_column, products_schema, require_columns, vector_checks


def test_parse_vector(spark):
    texts = ["[1, 2.5]", " [0.1] ", "[]", "", None, "[1, x]", "1, 2", "[1, null]", '{"a": 1}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.v for r in df.select("i", vx.parse_vector("t").alias("v")).orderBy("i").collect()]
    assert got[0] == [1.0, 2.5] and got[1] == [pytest.approx(0.1)]
    assert got[2:] == [None] * 7


def test_literal_round_trip(spark):
    df = spark.createDataFrame([([0.12345678, -1.0],)], "v array<float>")
    row = df.select(vx.vector_literal("v").alias("t"), vx.round_vector("v").alias("r")).first()
    assert row.t == "[0.123457,-1.000000]"
    assert row.r == [pytest.approx(0.123457), -1.0]


def test_normalize_zero_vector_stays_zero(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "v array<float>")
    zero, unit = [r.u for r in df.select(vx.l2_normalize("v").alias("u")).collect()]
    assert zero == [0.0, 0.0] and unit == [pytest.approx(0.6), pytest.approx(0.8)]


def test_distances(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    row = df.select(vx.cosine("a", "b").alias("c"), vx.euclidean("a", "b").alias("e")).first()
    assert row.c == pytest.approx(1 / math.sqrt(2)) and row.e == 1.0


def test_vector_checks_and_columns(spark):
    df = spark.createDataFrame([([1.0], [1.0, 2.0], None), ([2.0], None, None)], "a array<float>, b array<float>, c array<float>")
    row = vector_checks(df, "a", "b").first()
    assert row.pairs == 0 and row.warning == "dimension_mismatch: text_dim=1 image_dim=2"
    assert vector_checks(df, "a", "a").first().pairs == 2
    assert pick_column(df, ["x", "c", "b", "a"]) == "b"
    with pytest.raises(ValueError):
        require_columns(df, ["a", "z"])
    assert products_schema()["text_emb_e5"].metadata == {"dimension": 384}


def products(spark):
    return spark.createDataFrame(
        [(1, "Pan", [1.0, 0.0, 0.0, 0.0]), (2, "Leche entera", None), (3, None, None)],
        "id long, product_name string, v array<float>",
    ).withColumn("updated_at", F.lit("2020-01-01").cast("timestamp"))


def test_backfill_fills_only_missing(spark):
    text = F.coalesce("product_name", F.lit(""))
    rows = {r.id: r for r in embed_backfill(products(spark), "v", HashingEncoder(4), text=text).collect()}
    assert rows[1].v == [1.0, 0.0, 0.0, 0.0] and rows[1].updated_at.year == 2020
    assert sum(x * x for x in rows[2].v) == pytest.approx(1, abs=1e-5) and rows[2].updated_at.year > 2020
    assert rows[3].v == [0.0] * 4
    again = embed_backfill(products(spark), "v", HashingEncoder(4), reset=True, text=text)
    assert again.where("id = 1 and updated_at > '2021-01-01'").count() == 1


def test_merge_and_reset(spark):
    new = spark.createDataFrame([(2, [0.0, 1.0, 0.0, 0.0])], "id long, v array<float>")
    merged = {r.id: r for r in merge_embeddings(products(spark), new, "v").collect()}
    assert merged[2].v == [0.0, 1.0, 0.0, 0.0] and merged[2].updated_at.year > 2020
    assert merged[1].updated_at.year == 2020 and merged[3].v is None
    assert pending_count(products(spark), ["v"]).first().pending_v == 2
    assert reset_column(products(spark), "v").where("v is not null").count() == 0


def test_shared_image_is_encoded_once(spark):
    rows = spark.createDataFrame(
        [(1, None, "a.png", None), (2, None, "a.png", None), (3, None, "", None)],
        "id long, s3_url string, s3_path string, v array<float>",
    )
    objects = spark.createDataFrame([("shelf/a.png", bytearray(b"x y")), ("shelf/b.png", bytearray(b"z"))], "path string, content binary")
    out = encode_images(rows, "v", HashingEncoder(4), objects, "shelf").collect()
    assert sorted(r.id for r in out) == [1, 2] and out[0].v == out[1].v
