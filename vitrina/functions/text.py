"""Text cleaning, composition and label normalisation as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Unicode white space as a Java regex class body. Java's own \s is ASCII only.
WHITESPACE = (
    r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
)

# The same characters as a string.
WHITESPACE_CHARS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())

# Text made of these characters only is its own NFKC form, so it never has to
# visit Python: controls, ASCII and the Latin letters without compatibility forms.
NFKC_STABLE = (
    r"^[\x00-\x9f\xa1-\xa7\xa9\xab-\xae\xb0\xb1\xb6\xb7\xbb\xbf-\u0131"
    r"\u0134-\u013e\u0141-\u0148\u014a-\u017e]*$"
)

# Unit tokens dropped from product names.
UNIT_TOKENS = ["ml", "g", "kg", "l", "pack", "pcs"]

# Characters that count as a digit: decimal digits and the digit-valued forms
# (superscripts, subscripts, circled and parenthesised digits).
_DIGITS = (
    r"^[\p{Nd}²³¹⁰⁴-⁹₀-₉①-⑨"
    r"⑴-⑼⒈-⒐⓪⓵-⓽⓿❶-❾➀-➈➊-➒]+$"
)


def _c(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def strip(column: Column | str) -> Column:
    """Remove Unicode white space at both ends; the text between is not looked at."""
    return F.btrim(_c(column), F.lit(WHITESPACE_CHARS))


def has_content(column: Column | str) -> Column:
    """True for a value with at least one visible character, false for null."""
    return F.coalesce(_c(column).rlike(f"[^{WHITESPACE}]"), F.lit(False))


def clean_string(column: Column | str) -> Column:
    return F.nullif(strip(column), F.lit(""))


def label_or_none(column: Column | str) -> Column:
    """Label text of a value: a null is the class ``None``, equal to itself."""
    return F.coalesce(_c(column).cast("string"), F.lit("None"))


def compose_text(
    name: Column | str = "product_name",
    store: Column | str = "store_name",
    section: Column | str = "collection_section",
    description: Column | str = "product_description",
) -> Column:
    """``name · store · section. description``, each part only when not empty."""

    def part(prefix: str, column: Column | str) -> Column:
        value = F.coalesce(_c(column), F.lit(""))
        return F.when(value != "", F.concat(F.lit(prefix), value)).otherwise(F.lit(""))

    return F.trim(F.concat(
        F.coalesce(_c(name), F.lit("")), part(" · ", store), part(" · ", section), part(". ", description)
    ))


def text_template(
    name: Column | str = "product_name",
    description: Column | str = "product_description",
    prefix: str = "",
) -> Column:
    """``prefix`` + ``name. description`` for encoders that want a prompt."""
    body = F.concat_ws(". ", F.nullif(F.trim(_c(name)), F.lit("")), F.nullif(F.trim(_c(description)), F.lit("")))
    return F.concat(F.lit(prefix), body)


# Arrow's own normaliser leaves accents apart under NFKC, so this goes string by string.
@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


# Keeps the optimizer from copying the call into filters that it derives.
_nfkc = _nfkc.asNondeterministic()


def nfkc_stable(value: Column) -> Column:
    """True for a value that surely is its own NFKC form; ASCII is seen by its length."""
    return (F.octet_length(value) == F.length(value)) | value.rlike(NFKC_STABLE)


def nfkc(column: Column | str) -> Column:
    """NFKC form; only values that could change are sent to Python."""
    value = _c(column)
    return F.coalesce(_nfkc(F.when(~nfkc_stable(value), value)), value)


def normalize_text(column: Column | str) -> Column:
    """Lower case, NFKC, no URLs, letters and single spaces only; null gives ''.

    ``_ / -`` become spaces; digits, marks and other punctuation vanish.
    """
    ws, blank = WHITESPACE, f"{WHITESPACE}_/\\-"
    value = nfkc(F.lower(F.coalesce(_c(column), F.lit(""))))
    # Most texts hold no URL, most breaks are one blank: neither is written anew.
    value = F.when(_may_link(value), F.regexp_replace(value, f"https?://[^{ws}]+|www\\.[^{ws}]+", " ")).otherwise(value)
    value = F.regexp_replace(value, f"[^\\p{{L}}{blank}]+", "")
    return F.trim(F.regexp_replace(value, f"[{blank}]{{2,}}|[{blank}&&[^ ]]", " "))


def _may_link(value: Column) -> Column:
    return value.contains("://") | value.contains("www.")


def half_normalized(column: Column | str) -> list[Column]:
    """(half, plain): ``normalize_text``, but plain values in lower case only; ``normalized_rest`` does the others' steps in Python.

    Plain values have no URL and no characters but those of ``NFKC_STABLE``, of which Python
    and the JVM take the same ones for letters.
    """
    value = F.lower(F.coalesce(_c(column), F.lit("")))
    plain = nfkc_stable(value) & ~_may_link(value)
    return [F.when(plain, value).otherwise(normalize_text(column)).alias("half"), plain.alias("plain")]


# Characters below U+0180 of plain values: letters stay, breaks become blanks, others vanish.
_PLAIN = {i: chr(i) if chr(i).isalpha() else " " if chr(i) in WHITESPACE_CHARS + "_/-" else None for i in range(0x180)}


def normalized_rest(half: pa.Array, plain: pa.Array) -> pa.Array:
    """The normalised values of ``half_normalized``."""
    return pa.array([
        " ".join(text.translate(_PLAIN).split()) if rest else text
        for text, rest in zip(half.to_pylist(), plain.to_pylist(), strict=True)
    ], pa.string())


def normalize_label(column: Column | str, product_name: bool = False) -> Column:
    """Label used for comparing rows.

    Lower case without punctuation, white space collapsed. For product names also
    all-digit and unit tokens go, and the first three tokens stay.
    """
    ws = WHITESPACE
    value = F.lower(label_or_none(column))
    value = F.regexp_replace(value, f"[^\\p{{L}}\\p{{N}}_{ws}]+", "")
    value = F.trim(F.regexp_replace(value, f"[{ws}]+", " "))
    if not product_name:
        return value
    tokens = F.filter(
        F.split(value, " "), lambda t: (t != "") & ~t.rlike(_DIGITS) & ~t.isin(UNIT_TOKENS)
    )
    return F.array_join(F.slice(tokens, 1, 3), " ")


def object_url(bucket: str, path: Column | str) -> Column:
    """``s3://bucket/path`` with the path as it is, null for a blank path."""
    return F.when(has_content(path), F.concat(F.lit(f"s3://{bucket}/"), _c(path)))


def object_location(bucket: str, url: Column | str = "s3_url", path: Column | str = "s3_path") -> Column:
    """Struct of bucket and key for the stored URL, or for the path if there is none.

    A value without the ``s3://`` scheme is a key in the default bucket.
    """
    full = F.coalesce(_c(url), F.concat(F.lit(f"s3://{bucket}/"), F.coalesce(_c(path), F.lit(""))))
    has_scheme = full.startswith("s3://")
    return F.struct(
        F.when(has_scheme, F.regexp_extract(full, r"^s3://([^/]*)", 1)).otherwise(F.lit(bucket)).alias("bucket"),
        F.when(has_scheme, F.regexp_extract(full, r"(?s)^s3://[^/]*/(.*)$", 1)).otherwise(full).alias("key"),
    )
