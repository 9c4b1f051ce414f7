"""Row-wise vector expressions on ``array<float>`` columns.

Arithmetic is in double: stored vectors are single precision.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Added to a norm before dividing, so that a zero vector stays zero.
EPSILON = 1e-8


def _c(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def parse_vector(column: Column | str) -> Column:
    """Vector from its ``[...]`` text form; blank, empty or malformed gives null."""
    text = F.trim(_c(column))
    parsed = F.from_json(F.when(text.rlike(r"(?s)^\[.*\]$"), text), "array<float>")
    return F.when((F.size(parsed) > 0) & ~F.exists(parsed, lambda x: x.isNull()), parsed)


def vector_literal(column: Column | str) -> Column:
    """Text form with six decimals."""
    return F.concat(
        F.lit("["),
        F.array_join(F.transform(_c(column), lambda x: F.format_string("%.6f", x.cast("double"))), ","),
        F.lit("]"),
    )


def round_vector(column: Column | str, decimals: int = 6) -> Column:
    """The precision a vector keeps when stored through its text form."""
    return F.transform(_c(column), lambda x: F.round(x.cast("double"), decimals).cast("float"))


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(column: Column | str) -> Column:
    return F.sqrt(F.aggregate(
        _c(column), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")
    ))


def euclidean(a: Column | str, b: Column | str) -> Column:
    squares = F.zip_with(
        _c(a), _c(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))
    )
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x))


def unit_weight(column: Column | str) -> Column:
    """Factor that turns a vector into its unit vector."""
    return F.lit(1.0) / (norm(column) + F.lit(EPSILON))


def cosine(a: Column | str, b: Column | str) -> Column:
    return dot(a, b) * unit_weight(a) * unit_weight(b)


def l2_normalize(column: Column | str) -> Column:
    """``v / (|v| + 1e-8)`` as doubles.

    The one-element array binds the norm once; written inside the inner lambda it
    would be evaluated for every element.
    """
    vector = _c(column)
    return F.element_at(
        F.transform(
            F.array(unit_weight(vector)),
            lambda w: F.transform(vector, lambda x: x.cast("double") * w),
        ),
        1,
    )
