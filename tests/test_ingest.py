from pyspark.sql import functions as F

from vitrina.operators.ingest import catalog_filter, near_duplicates
from vitrina.plans.ingest import ingest_csv, load_products
from vitrina.schema import LOAD_COLUMNS, LOAD_SCHEMA
from vitrina.sources.readers import csv_source, image_source, parquet_source
from vitrina.sources.writers import parquet_sink
from vitrina.functions.encoders import HashingEncoder
from vitrina.streaming.ingest import arriving_files, ingest_available, load_available

HEADER = ",".join(LOAD_COLUMNS)
ROWS = [
    'ES,MAD,Tienda,Pan,Bebidas,"Pan, ""bueno""\nde molde",a.png,',
    "ES,MAD,AS_1,Pan,X,texto,b.png,",
    "ES,MAD,as_1,Pan,X,texto,c.png,",
    "ES,MAD, AS_1,Pan,X,texto,d.png,",
    "ES,MAD,,Pan,X,texto,e.png,",
    "ES,MAD,T,Pan,X,NA,f.png,",
    "ES,MAD,T,Pan,X,None,g.png,",
    "ES,MAD,T,Pan,X,  ,h.png,",
    "ES,MAD,T,Pan,X,texto,,",
    "ES,MAD,T,Pan,X,texto,  ,",
    "PT,LIS,T,Pan,X,texto,i.png,",
    ",LIS,T,Pan,X,texto,j.png,",
    "MX,CDMX,T,Pan,X,texto,k.png,",
]


def write_csv(tmp_path):
    path = tmp_path / "catalog.csv"
    path.write_text("\n".join([HEADER, *ROWS]) + "\n", encoding="utf-8")
    return str(path)


def test_csv_filter_edges(spark, tmp_path):
    rows = csv_source(spark, write_csv(tmp_path))
    assert rows.count() == len(ROWS)
    first = rows.where("s3_path = 'a.png'").first()
    assert first.product_description == 'Pan, "bueno"\nde molde' and first.s3_url is None
    kept = catalog_filter(rows)
    assert sorted(r.s3_path for r in kept.collect()) == ["a.png", "c.png", "d.png", "e.png", "k.png"]
    assert [r.s3_path for r in catalog_filter(rows, "MX").collect()] == ["k.png"]
    assert catalog_filter(rows, ["PT"]).count() == 0


def test_ingest_and_load(spark, tmp_path):
    source, target = write_csv(tmp_path), str(tmp_path / "filtered")
    ingest_csv(spark, source, target, max_records=3)
    assert [r.s3_path for r in spark.read.parquet(target).orderBy("s3_path").collect()] == ["a.png", "c.png", "d.png"]
    table = str(tmp_path / "products")
    load_products(spark, target, table, "one", "shelf")
    load_products(spark, target, table, "one", "shelf")
    products = spark.read.parquet(table)
    assert sorted(r.id for r in products.collect()) == [1, 2, 3]
    before = {r.s3_path: r.id for r in products.collect()}
    load_products(spark, target, table, "two", "shelf")
    assert sorted(r.id for r in spark.read.parquet(table).collect()) == [1, 2, 3, 4, 5, 6]
    load_products(spark, target, table, "one", "shelf")
    rows = spark.read.parquet(table).collect()
    assert sorted(r.id for r in rows) == [1, 2, 3, 4, 5, 6]
    assert {r.s3_path: r.id for r in rows if r.load_batch == "one"} == before
    row = spark.read.parquet(table).where("s3_path = 'd.png'").first()
    assert row.store_name == "AS_1" and row.s3_url == "s3://shelf/d.png" and row.created_at is not None


def test_files_are_numbered_by_name(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    for name, rows in (("a", 2), ("b", 400), ("c", 3)):
        lines = [f"ES,MAD,T,Pan,X,texto {i},{name}{i:04d}.png," for i in range(rows)]
        (folder / f"{name}.csv").write_text("\n".join([HEADER, *lines]) + "\n", encoding="utf-8")
    numbered = csv_source(spark, str(folder), line_order="line").orderBy("line").collect()
    assert [r.s3_path for r in numbered] == sorted(r.s3_path for r in numbered) and len(numbered) == 405
    out = tmp_path / "parts"
    for name in ("b", "a"):
        spark.createDataFrame([("ES", f"{name}{i}.png") for i in range(3)], "country_code string, s3_path string").coalesce(1).write.parquet(str(out / f"{name}.parquet"))
    load_products(spark, str(out / "*.parquet"), str(tmp_path / "table"), "x", "shelf")
    ids = {r.s3_path: r.id for r in spark.read.parquet(str(tmp_path / "table")).collect()}
    assert [ids[f"{n}{i}.png"] for n in "ab" for i in range(3)] == [1, 2, 3, 4, 5, 6]


def test_empty_result_keeps_columns(spark, tmp_path):
    path = parquet_sink(csv_source(spark, write_csv(tmp_path)).where("false"), str(tmp_path / "none"))
    assert parquet_source(spark, path).columns == LOAD_COLUMNS


def test_files_with_different_columns(spark, tmp_path):
    spark.range(2).select(F.lit("x").alias("country_code")).write.parquet(str(tmp_path / "d" / "a.parquet"))
    spark.range(3).select(F.lit("y").alias("city_code")).write.parquet(str(tmp_path / "d" / "b.parquet"))
    from vitrina.schema import conform_schema

    rows = conform_schema(parquet_source(spark, str(tmp_path / "d" / "*.parquet")))
    assert rows.columns == LOAD_COLUMNS and rows.count() == 5


def test_stream_takes_new_files_once(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def add(path):
        rows = [("ES", "MAD", "T", "Pan", "X", " texto ", path, None), ("PT", "LIS", "T", "Pan", "X", "texto", path, None)]
        spark.createDataFrame(rows, LOAD_SCHEMA).write.mode("append").parquet(source)

    for path in ("a.png", "b.png"):
        add(path)
        ingest_available(arriving_files(spark, source, LOAD_SCHEMA), out, state, "shelf").awaitTermination()
    rows = spark.read.parquet(out).orderBy("s3_path").collect()
    assert [(r.s3_path, r.product_description, r.s3_url) for r in rows] == [
        ("a.png", "texto", "s3://shelf/a.png"), ("b.png", "texto", "s3://shelf/b.png")
    ]


def test_duplicates_ignore_case_and_digits(spark):
    df = spark.createDataFrame([(1, "Pan 1"), (2, "PAN-2"), (3, "Leche")], "id long, t string")
    assert [(r.copies, r.kept_id) for r in near_duplicates(df, "t").collect()] == [(2, 1)]


def test_image_source(spark, tmp_path):
    (tmp_path / "img").mkdir()
    (tmp_path / "img" / "a.png").write_bytes(b"123")
    row = image_source(spark, str(tmp_path / "img"), "*.png").first()
    assert row.length == 3 and row.path.endswith("img/a.png") and not row.path.startswith("/")


def test_stream_loads_products_and_replays_a_batch(spark, tmp_path):
    """A batch that runs again finds its rows, once each, under their old ids."""
    arrivals, table, state = tmp_path / "in", str(tmp_path / "products"), tmp_path / "state"

    def arrive(name, paths):
        rows = [("ES", "MAD", "T", f"n {p}", "S", f"text of {p}", p, None) for p in paths]
        spark.createDataFrame(rows, LOAD_SCHEMA).coalesce(1).write.parquet(str(arrivals / name))

    def run():
        rows = arriving_files(spark, f"{arrivals}/*", LOAD_SCHEMA)
        load_available(rows, table, str(state), "shelf", "text_emb_e5", HashingEncoder(8)).awaitTermination()
        return {r.s3_path: r for r in spark.read.parquet(table).collect()}

    arrive("one", ["b.png", "a.png", "", "c.png"])
    first = run()
    assert [first[p].id for p in ("b.png", "a.png", "c.png")] == [1, 2, 3] and len(first) == 3
    assert all(len(r.text_emb_e5) == 8 and any(r.text_emb_e5) for r in first.values())
    arrive("two", ["d.png", "e.png"])
    second = run()
    assert {p: r.id for p, r in second.items()} == {"b.png": 1, "a.png": 2, "c.png": 3, "d.png": 4, "e.png": 5}
    # The batch is planned but not marked as done, as after a failure between the two.
    for mark in (state / "commits").glob("*1*"):
        mark.unlink()
    arrive("three", ["f.png"])
    third = run()
    assert spark.read.parquet(table).count() == 6
    assert {p: r.id for p, r in third.items() if p != "f.png"} == {p: r.id for p, r in second.items()}
    assert third["f.png"].id == 6 and third["e.png"].created_at > second["e.png"].created_at
    assert third["a.png"].created_at == second["a.png"].created_at
    assert run() == third


def test_stream_queries_take_a_table_of_several_files(spark, tmp_path):
    """The documents are a folder of files, as every larger table is."""
    import __spark_entry__ as contract

    rows = [(i, f"text {i}", "es" if i < 5 else "de", "src2", 6) for i in range(8)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    documents.repartition(3, "doc_id").write.parquet(str(tmp_path / "folder" / "documents.parquet"))
    (tmp_path / "file").mkdir()
    documents.toPandas().to_parquet(tmp_path / "file" / "documents.parquet")
    for kind in ("folder", "file"):
        loaded = contract.queries()["stream_load"](spark, str(tmp_path / kind)).collect()
        assert sorted(r.id for r in loaded) == [1, 2, 3, 4, 5] and {r.dimension for r in loaded} == {64}
        ingested = contract.queries()["stream_ingest"](spark, str(tmp_path / kind)).collect()
        assert [(r.country_code, r.n_rows, r.n_chars) for r in ingested] == [("es", 5, 30)]
