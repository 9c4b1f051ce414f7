"""The two catalogue jobs: file to filtered Parquet, and Parquet to products."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrina.operators.ingest import SPANISH_SPEAKING, catalog_filter, prepare_load
from vitrina.operators.ordering import dense_index, first_n, number_in_file_order
from vitrina.session import materialize
from vitrina.sources.readers import csv_source, parquet_source, path_exists
from vitrina.sources.writers import append_products, parquet_sink


def ingest_csv(
    spark: SparkSession, source: str, target: str, max_records: int | None = None,
    country_codes: str | list[str] | None = None, whitelist: list[str] = SPANISH_SPEAKING,
) -> str:
    """Read a catalogue CSV, keep the wanted rows, write Parquet."""
    rows = csv_source(spark, source, line_order="__line" if max_records else None)
    kept = catalog_filter(rows, country_codes, whitelist)
    if max_records:
        # The line numbers must not change between finding the cut-off and applying it.
        kept = first_n(materialize(kept, "ingest"), "__line", max_records).drop("__line")
    return parquet_sink(kept, target)


def _first_id(existing: DataFrame | None, batch_id: str, rows: int) -> int:
    """First id of a load of ``rows`` rows: no id of another batch is ever used again.

    A batch that is loaded once more keeps its ids as long as they reach to the next
    batch's; otherwise it continues after the largest id of the others.
    """
    if existing is None:
        return 1
    own = F.col("load_batch") == batch_id if "load_batch" in existing.columns else F.lit(False)
    begin = existing.agg(F.min(F.when(own, F.col("id")))).first()[0]
    others = existing.where(~own).agg(
        F.coalesce(F.max("id"), F.lit(0)), F.min(F.when(F.col("id") >= (0 if begin is None else begin), F.col("id")))
    ).first()
    if begin is not None and (others[1] is None or begin + rows <= others[1]):
        return begin
    return others[0] + 1


def load_rows(
    raw: DataFrame, target: str, batch_id: str, bucket: str, existing: DataFrame | None = None,
    fill: Callable[[DataFrame], DataFrame] | None = None,
) -> str:
    """Prepare the rows of files, give them ids after those of the other batches and append.

    Rows are numbered by file name and place in the file. ``fill`` may add columns, such as
    vectors, to the numbered rows. ``existing`` is the products table, by default what
    ``target`` holds already, if anything.
    """
    spark = raw.sparkSession
    placed = raw.withColumns({"__file": F.col("_metadata.file_path"), "__at": F.col("_metadata.row_index")})
    ordered = number_in_file_order(placed, "__file", "__at", "__line")
    numbered = materialize(prepare_load(ordered, bucket, keep=["__line"]), "load")
    if existing is None and path_exists(spark, target):
        existing = parquet_source(spark, target)
    start = _first_id(existing, batch_id, numbered.count())
    with_ids = dense_index(numbered, "__line", "id", start).drop("__line")
    if fill:
        with_ids = fill(with_ids)
    now = F.current_timestamp()
    return append_products(with_ids.withColumns({"created_at": now, "updated_at": now}), target, batch_id)


def load_products(
    spark: SparkSession, source: str, target: str, batch_id: str, bucket: str, existing: DataFrame | None = None
) -> str:
    """Load one Parquet file or folder as a batch of its own."""
    return load_rows(parquet_source(spark, source), target, batch_id, bucket, existing)
