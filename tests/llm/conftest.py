import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of (doc_id, text[, lang, source]) rows, with extra columns of clashing names."""

    def build(rows, schema="doc_id long, text string"):
        frame = spark.createDataFrame(rows, schema)
        clashing = ["id", "key", "size", "start", "length", "n", "node", "label", "range", "at", "target", "h", "own", "of"]
        return frame.select("*", *[F.lit(7).alias(c) for c in clashing]).repartition(3)

    return build
