"""Hybrid search: lexical and vector lists for a table of queries, fused."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrina.functions.encoders import Encoder, encode
from vitrina.functions.text import has_content, normalize_text, strip
from vitrina.functions.vectors import round_vector
from vitrina.operators import fusion
from vitrina.operators.ann import CellIndex, ann_knn
from vitrina.operators.codes import CodeIndex
from vitrina.operators.lexical import LEXICAL_LIMIT, lexical_search
from vitrina.operators.similarity import BOUND_ROWS, vector_search
from vitrina.session import materialize


@dataclass
class SearchResult:
    """The two ranked lists and the fused one."""

    lexical: DataFrame
    vector: DataFrame
    fused: DataFrame


def encode_queries(queries: DataFrame, encoder: Encoder, normalized: bool = False) -> DataFrame:
    """(query_id, v): vectors of the stripped query texts, at stored precision.

    Queries are encoded as they are unless ``normalized``; catalogue texts are
    always normalised.
    """
    text = strip("text")
    text = normalize_text(text) if normalized else text
    kept = queries.where(has_content("text"))
    return kept.select("query_id", encode(text, encoder).alias("v")).select("query_id", round_vector("v").alias("v"))


def attach_fields(
    ranked: DataFrame, items: DataFrame, fields: dict[str, Column | str], queries: DataFrame, k: int = fusion.TOP_K
) -> DataFrame:
    """Add display fields of the items to ranked rows.

    The ranked rows are at most queries x k; they are broadcast only when that product
    was checked, so that the catalogue need not be shuffled.
    """
    few = queries.limit(BOUND_ROWS + 1).count() * k <= BOUND_ROWS * fusion.TOP_K
    shown = items.select("id", *[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in fields.items()])
    return shown.join(F.broadcast(ranked) if few else ranked, "id")


def hybrid_search(
    queries: DataFrame, items: DataFrame, vector_col: str, encoder: Encoder | None = None,
    k: int = fusion.TOP_K, lex_limit: int = LEXICAL_LIMIT, text: Column | None = None,
    postings: DataFrame | None = None, method: str = "rrf", stem: bool = True, normalized: bool = False,
    stored: bool = False, index: CellIndex | CodeIndex | None = None, n_probe: int | None = None,
) -> SearchResult:
    """Answer every row of ``queries`` (query_id, text and, without encoder, v).

    With a ``CodeIndex`` of the vector column codes are looked up and their survivors scored
    exactly. With a ``CellIndex`` only the ``n_probe`` cells nearest to a query
    are searched, by default as many as find nine tenths of the neighbours of stored vectors
    (measured in one pass over them); probing all of them gives the exact list. ``stored`` writes the two ranked lists (queries x limit rows) before fusing, for
    callers that read more than the fused list.
    """
    asked = queries.where(has_content("text"))
    vectors = encode_queries(asked, encoder, normalized) if encoder is not None else asked.select("query_id", "v")
    if index is None:
        vector = vector_search(vectors, items.select("id", F.col(vector_col).alias("v")), k)
    elif isinstance(index, CodeIndex):
        vector = index.search(vectors, k)
    else:
        vector = ann_knn(vectors, index, k, n_probe)
    lexical = lexical_search(
        asked.select("query_id", strip("text").alias("text")), items, text, postings, lex_limit, stem
    )
    if stored:
        lexical, vector = materialize(lexical, "lexical"), materialize(vector, "vector")
    fuse = {"rrf": fusion.rrf_fusion, "blend": fusion.blend_fusion}[method]
    return SearchResult(lexical, vector, fuse(lexical, vector, k))


def search_by_vector_column(
    queries: DataFrame, items: DataFrame, column: str, k: int = fusion.TOP_K
) -> DataFrame:
    """Nearest items in one vector space; query vectors may come from another modality."""
    return vector_search(queries, items.select("id", F.col(column).alias("v")), k)
