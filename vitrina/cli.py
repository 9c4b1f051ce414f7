"""Command line for spark-submit: ingest, load, backfill, search, metrics.

    spark-submit --py-files vitrina.zip run.py ingest --source s3a://... --output-file s3a://...
"""

from __future__ import annotations

import argparse
import importlib
from datetime import datetime, timezone

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from vitrina.functions.encoders import Encoder, HashingEncoder
from vitrina.operators.ann import build_cells, read_cells
from vitrina.operators.backfill import embed_backfill, encode_images, merge_embeddings, reset_column
from vitrina.operators.codes import build_codes, read_codes
from vitrina.operators.fusion import TOP_K, answer_summary, trace
from vitrina.operators.lexical import LEXICAL_LIMIT
from vitrina.operators.near import SIMILARITY, WORDS, similar_groups
from vitrina.plans import evaluation
from vitrina.plans.ingest import ingest_csv, load_products
from vitrina.plans.search import attach_fields, hybrid_search
from vitrina.sources.readers import decoded_images, image_source, parquet_source
from vitrina.sources.writers import metrics_sink, trace_sink


def find_encoder(name: str | None) -> Encoder:
    """``module:object`` of an encoder; the hashing encoder when none is named."""
    if not name:
        return HashingEncoder()
    module, _, attribute = name.partition(":")
    found = getattr(importlib.import_module(module), attribute)
    return found() if isinstance(found, type) else found


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="vitrina")
    commands = top.add_subparsers(dest="command", required=True)

    p = commands.add_parser("ingest", help="catalogue CSV to filtered Parquet")
    p.add_argument("--source", required=True)
    p.add_argument("--max-records", type=int)
    p.add_argument("--output-dir", default="data")
    p.add_argument("--output-file")
    p.add_argument("--country-codes", nargs="*")

    p = commands.add_parser("load", help="Parquet to the products table")
    p.add_argument("--data-dir", default="data")
    p.add_argument("--parquet-file")
    p.add_argument("--products", required=True)
    p.add_argument("--bucket", required=True)
    p.add_argument("--batch-id", default=datetime.now(timezone.utc).strftime("%Y%m%d-%H%M%S"))
    p.add_argument("--append", action="store_true", help="kept for older calls: loads always continue the ids of the table")

    p = commands.add_parser("backfill", help="fill a text vector column")
    p.add_argument("--products", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--column", required=True)
    p.add_argument("--encoder", help="module:object")
    p.add_argument("--reset", action="store_true")
    p.add_argument("--mode", choices=["text", "image"], default="text")
    p.add_argument("--images", help="folder of the objects that image paths name; decoded for an encoder with a side")
    p.add_argument("--bucket", help="bucket of paths that name none")

    p = commands.add_parser("index", help="codes or cells for approximate vector search")
    p.add_argument("--kind", choices=["codes", "cells"], default="codes")
    p.add_argument("--products", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--column", required=True)
    p.add_argument("--cells", type=int)

    p = commands.add_parser("duplicates", help="groups of products with similar texts")
    p.add_argument("--products", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--column", default="product_description")
    p.add_argument("--similarity", type=float, default=SIMILARITY)
    p.add_argument("--words", type=int, default=WORDS)

    p = commands.add_parser("search", help="answer a table of queries")
    p.add_argument("--products", required=True)
    p.add_argument("--queries", required=True, help="Parquet with query_id and text")
    p.add_argument("--output", required=True)
    p.add_argument("--column", default="text_emb_je3")
    p.add_argument("--encoder", help="module:object")
    p.add_argument("--k", type=int, default=TOP_K)
    p.add_argument("--index", help="a stored index of the column")
    p.add_argument("--index-kind", choices=["codes", "cells"], default="codes")
    p.add_argument("--n-probe", type=int, help="cells to search; by default nine tenths of the neighbours are found")
    p.add_argument("--lexical-limit", type=int, default=LEXICAL_LIMIT)
    p.add_argument("--fusion", choices=["rrf", "blend"], default="rrf")

    p = commands.add_parser("metrics", help="evaluation reports")
    p.add_argument("family", choices=["search", "relevance", "alignment", "combined"])
    p.add_argument("--products", required=True)
    p.add_argument("--out-dir", default="metrics")
    p.add_argument("--limit", type=int, help="first rows by id; all rows when left out")
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--proxy-column", choices=["collection_section", "store_name", "product_name"], default="collection_section")
    p.add_argument("--text-col")
    p.add_argument("--image-col")
    p.add_argument("--text-col-queries")
    p.add_argument("--text-col-targets")
    p.add_argument("--text-only", action="store_true")
    p.add_argument("--metrics", nargs="*", choices=evaluation.METRIC_FAMILIES, default=evaluation.METRIC_FAMILIES)
    return top


def report(spark: SparkSession, args: argparse.Namespace):
    products = parquet_source(spark, args.products)
    if args.family == "search":
        return evaluation.search_quality_report(products, limit=args.limit), None
    if args.family == "relevance":
        return evaluation.relevance_report(products, proxy=args.proxy_column, limit=args.limit, seed=args.seed), args.proxy_column
    if args.family == "alignment":
        return evaluation.alignment_report(products, args.limit, args.text_col, args.image_col), None
    text = args.text_col or evaluation.pick_column(products, evaluation.COMBINED_TEXT)
    image = None if args.text_only else args.image_col or evaluation.pick_column(products, evaluation.COMBINED_IMAGE)
    return evaluation.combined_report(
        products, text, image, args.text_col_queries, args.text_col_targets, limit=args.limit, metrics=tuple(args.metrics)
    ), None


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> str:
    """Run one command; returns the path written."""
    args = parser().parse_args(argv)
    if spark is None:
        from vitrina.session import build_session

        spark = build_session(f"vitrina-{args.command}")
    if args.command == "ingest":
        target = args.output_file or f"{args.output_dir}/filtered_dataset.parquet"
        return ingest_csv(spark, args.source, target, args.max_records, args.country_codes)
    if args.command == "load":
        return load_products(spark, args.parquet_file or args.data_dir, args.products, args.batch_id, args.bucket)
    if args.command == "backfill":
        products = parquet_source(spark, args.products)
        if args.column not in products.columns:
            products = products.withColumn(args.column, F.lit(None).cast("array<float>"))
        encoder = find_encoder(args.encoder)
        if args.mode == "image":
            pending = reset_column(products, args.column) if args.reset else products
            side = getattr(encoder, "side", None)
            objects = decoded_images(spark, args.images, side, undecoded=False) if side else image_source(spark, args.images)
            filled = merge_embeddings(pending, encode_images(pending, args.column, encoder, objects, args.bucket), args.column)
        else:
            filled = embed_backfill(products, args.column, encoder, args.reset)
        filled.write.mode("errorifexists").parquet(args.output)
        return args.output
    if args.command == "index":
        rows = parquet_source(spark, args.products).select("id", F.col(args.column).alias("v"))
        if args.kind == "cells":
            build_cells(rows, args.cells).write(args.output)
        else:
            build_codes(rows, args.output)
        return args.output
    if args.command == "duplicates":
        products = parquet_source(spark, args.products)
        similar_groups(products, args.column, similarity=args.similarity, words=args.words).write.parquet(args.output)
        return args.output
    if args.command == "search":
        products, queries = parquet_source(spark, args.products), parquet_source(spark, args.queries)
        reader = read_cells if args.index_kind == "cells" else read_codes
        index = reader(spark, args.index) if args.index else None
        result = hybrid_search(
            queries, products, args.column, find_encoder(args.encoder), args.k, args.lexical_limit,
            method=args.fusion, stored=True, index=index, n_probe=args.n_probe,
        )
        fields = {"name": "product_name", "text": "product_description", "image_url": "s3_url"}
        named = attach_fields(result.fused, products, fields, queries, args.k)
        traces = trace(queries, result.lexical, result.vector, named, {"k": args.k})
        answers = answer_summary(queries, named, "name")
        return trace_sink(traces.join(answers, "query_id"), args.output)
    table, proxy = report(spark, args)
    return metrics_sink(table, args.out_dir, f"{args.family}_metrics", args.limit, proxy)


if __name__ == "__main__":
    main()
