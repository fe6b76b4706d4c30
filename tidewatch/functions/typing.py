"""Column typing of text cells: int64, float64, bool or object, from per-column counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.functions.text import is_boolean, is_integer, is_number, number_text, to_number

# The four column type names, as they enter the schema fingerprint.
INT64, FLOAT64, BOOL, OBJECT = "int64", "float64", "bool", "object"
NUMERIC_TYPES = [INT64, FLOAT64, BOOL]


def type_counts(raw: Column, weight: Column) -> list[Column]:
    """Aggregates that decide a column's type; ``weight`` is the number of rows per value."""

    def rows(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, weight)), F.lit(0))

    return [
        F.sum(weight).alias("cells"),
        rows(raw.isNull()).alias("missing"),
        rows(is_integer(raw)).alias("integers"),
        rows(is_number(raw)).alias("numbers"),
        rows(is_boolean(raw)).alias("booleans"),
    ]


def type_name(all_missing: str = FLOAT64) -> Column:
    """Type from the ``type_counts`` columns.

    ``all_missing`` is the type of a column without values: ``float64`` when it is read from
    a file, ``object`` when it comes back from stored feature payloads.
    """
    present = F.col("cells") - F.col("missing")
    complete = F.col("missing") == 0
    return (
        F.when(present == 0, all_missing)
        .when(F.col("booleans") == present, F.when(complete, BOOL).otherwise(OBJECT))
        .when(F.col("integers") == present, F.when(complete, INT64).otherwise(FLOAT64))
        .when(F.col("numbers") == present, FLOAT64)
        .otherwise(OBJECT)
    )


def typed_text(raw: Column, dtype: Column) -> Column:
    """Text of a cell once its column has a type: ``1`` / ``1.0`` / ``True`` / as written."""
    return (
        F.when(dtype == INT64, F.trim(raw).try_cast("bigint").cast("string"))
        .when(dtype == FLOAT64, number_text(to_number(raw)))
        .when(dtype == BOOL, F.initcap(raw))
        .otherwise(raw)
    )


def typed_number(raw: Column, dtype: Column) -> Column:
    return F.when(dtype == BOOL, (F.lower(raw) == "true").cast("double")).otherwise(to_number(raw))
