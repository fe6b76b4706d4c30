"""Checks on uploaded rows; every broken rule becomes a row, nothing is raised half-way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.text import to_number

# Messages of the row-level rules, in the order they are checked.
NO_PREDICTION = "The 'predicted_label' column cannot contain missing values."
NOT_NUMERIC = "Confidence values must be numeric."
NOT_IN_RANGE = "Confidence values must be between 0 and 1."
BAD_TIMESTAMP = "One or more timestamp values are invalid."


def parsed_timestamp(raw: Column) -> Column:
    """ISO date or date-time text as a UTC timestamp, NULL when it is neither."""
    iso = raw.rlike(r"^\s*\d{4}-\d{1,2}-\d{1,2}([ T].*)?\s*$")
    return F.when(iso, F.try_to_timestamp(F.trim(raw)))


def prediction_checks(df: DataFrame, keys: list[str], *extra: Column) -> DataFrame:
    """Rule-breaking rows per key and the first broken rule, NULL if none.

    ``df`` holds the text columns predicted_label, confidence and timestamp. ``extra``
    aggregates are taken in the same pass.
    """
    confidence = to_number(F.col("confidence"))
    counted = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(F.col("predicted_label").isNull()).alias("missing_predictions"),
        F.count_if(F.col("confidence").isNotNull() & confidence.isNull()).alias("non_numeric_confidences"),
        F.count_if(~confidence.between(0, 1)).alias("out_of_range_confidences"),
        F.count_if(F.col("timestamp").isNotNull() & parsed_timestamp(F.col("timestamp")).isNull()).alias(
            "invalid_timestamps"
        ),
        *extra,
    )
    return counted.withColumn(
        "error",
        F.when(F.col("missing_predictions") > 0, NO_PREDICTION)
        .when(F.col("non_numeric_confidences") > 0, NOT_NUMERIC)
        .when(F.col("out_of_range_confidences") > 0, NOT_IN_RANGE)
        .when(F.col("invalid_timestamps") > 0, BAD_TIMESTAMP),
    )
