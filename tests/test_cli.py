from vitrina.cli import main
from vitrina.schema import LOAD_COLUMNS


def test_from_file_to_report(spark, tmp_path):
    lines = [",".join(LOAD_COLUMNS)] + [
        f"ES,MAD,T{i % 2},Galletas {i},S{i % 3},Galletas de avena numero {'abcdefghijkl'[i]},p{i}.png," for i in range(12)
    ]
    source = tmp_path / "catalog.csv"
    source.write_text("\n".join(lines), encoding="utf-8")
    filtered = main(["ingest", "--source", str(source), "--output-dir", str(tmp_path)], spark)
    products = main(["load", "--parquet-file", filtered, "--products", str(tmp_path / "p"), "--bucket", "shelf"], spark)
    filled = main(["backfill", "--products", products, "--output", str(tmp_path / "f"), "--column", "text_emb_e5"], spark)
    table = spark.read.parquet(filled)
    assert table.count() == 12 and table.where("size(text_emb_e5) = 64").count() == 12

    spark.createDataFrame([(1, "galletas de avena"), (2, " ")], "query_id long, text string").write.parquet(str(tmp_path / "q"))
    out = main([
        "search", "--products", filled, "--queries", str(tmp_path / "q"), "--output", str(tmp_path / "o"),
        "--column", "text_emb_e5", "--k", "5",
    ], spark)
    rows = {r.query_id: r for r in spark.read.json(out).collect()}
    assert len(rows[1].final) == 5 and rows[1].answer.startswith("Resultados top: Galletas")
    assert rows[2].error == "empty_text" and rows[2].answer.startswith("Debe")

    report = main(["metrics", "search", "--products", filled, "--out-dir", str(tmp_path / "m"), "--limit", "10"], spark)
    assert spark.read.json(report).where("metric = 'recall_1'").count() == 1
