"""Reading text cells the way a CSV reader types them: missing tokens, numbers, booleans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Cell texts that count as missing.
MISSING_TOKENS = [
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
]

# Accepted spellings of numbers, infinities and booleans.
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
INFINITY_PATTERN = r"^\s*[+-]?(?i:inf|infinity)\s*$"
INTEGER_PATTERN = r"^\s*[+-]?\d+\s*$"
BOOLEAN_TEXTS = ["True", "TRUE", "true", "False", "FALSE", "false"]
TRUE_TEXTS = ["True", "TRUE", "true"]

# Fixed value: the category that stands for a missing value.
MISSING_CATEGORY = "MISSING"


def null_if_nan(number: Column) -> Column:
    """A floating number without NaN, which typed tables use for missing values."""
    return F.when(~F.isnan(number), number)


def present(df: DataFrame, name: str) -> Column:
    """A typed column in which NaN, too, is NULL."""
    floating = isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType))
    return null_if_nan(F.col(f"`{name}`")) if floating else F.col(f"`{name}`")


def is_missing(df: DataFrame, name: str) -> Column:
    return present(df, name).isNull()


def null_if_missing(raw: Column) -> Column:
    return F.when(~raw.isin(MISSING_TOKENS), raw)


def is_number(raw: Column) -> Column:
    return raw.rlike(NUMBER_PATTERN) | raw.rlike(INFINITY_PATTERN)


def is_integer(raw: Column) -> Column:
    return raw.rlike(INTEGER_PATTERN) & F.trim(raw).try_cast("bigint").isNotNull()


def is_boolean(raw: Column) -> Column:
    return raw.isin(BOOLEAN_TEXTS)


def to_number(raw: Column) -> Column:
    """The numeric value of a cell, NULL when it is not a number."""
    finite = F.when(raw.rlike(NUMBER_PATTERN), F.trim(raw).try_cast("double"))
    infinite = F.when(
        raw.rlike(INFINITY_PATTERN),
        F.when(F.trim(raw).startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf"))),
    )
    return F.coalesce(finite, infinite)


def label_text(raw: Column) -> Column:
    """Labels are text; an integral label never carries a trailing ``.0``."""
    return F.regexp_replace(raw, r"^([+-]?\d+)\.0+$", "$1")


def number_text(number: Column) -> Column:
    """Text of a double: ``25.0``, plain digits up to 1e16, ``1e+16`` beyond."""
    java = number.cast("string")
    parts = F.regexp_extract
    pattern = r"^(-?)(\d)\.(\d+)E(-?)(\d+)$"
    sign, lead, fraction = (parts(java, pattern, i) for i in (1, 2, 3))
    negative, exponent = parts(java, pattern, 4) == "-", parts(java, pattern, 5).try_cast("int")
    fraction = F.when(fraction == "0", "").otherwise(fraction)
    whole = F.rpad(F.concat(lead, fraction), exponent + 1, "0")
    tail = F.substring(F.concat(lead, fraction), exponent + 2, F.lit(40))
    plain = F.concat(sign, whole, F.lit("."), F.when(tail == "", "0").otherwise(tail))
    small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), exponent - 1), lead, fraction)
    scientific = F.concat(
        sign,
        lead,
        F.when(fraction == "", "").otherwise(F.concat(F.lit("."), fraction)),
        F.lit("e"),
        F.when(negative, "-").otherwise("+"),
        F.regexp_replace(parts(java, pattern, 5), r"^(\d)$", "0$1"),
    )
    size = F.abs(number)
    return (
        F.when(~java.contains("E"), java)
        .when((size >= 1e7) & (size < 1e16), plain)
        .when((size < 1e-3) & (size >= 1e-4), small)
        .otherwise(scientific)
    )
