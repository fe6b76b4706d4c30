"""Table profiles: types, missing cells, numeric and categorical summaries, class counts.

Text tables are profiled in long form (``keys, position, feature, raw``) so that any number
of files with different columns share one job; typed tables can be summarised wide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.text import MISSING_CATEGORY, is_missing, present, to_number
from tidewatch.functions.typing import BOOL, FLOAT64, INT64, OBJECT, type_counts, type_name, typed_text
from tidewatch.operators.cumulative import join_on_groups
from tidewatch.session import as_small_side


def _deviation(value: Column) -> Column:
    """Sample standard deviation, 0 for a single value or none."""
    return F.coalesce(F.stddev_samp(value), F.lit(0.0))


def text_cells(df: DataFrame, columns: list[str], keys: list[str] = ()) -> DataFrame:
    """Unpivot text columns to ``(keys, position, feature, raw)``."""
    pairs = [v for i, c in enumerate(columns) for v in (F.lit(i), F.lit(c), F.col(c).cast("string"))]
    return df.select(*keys, F.stack(F.lit(len(columns)), *pairs).alias("position", "feature", "raw"))


def map_cells(rows: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """The same long form from a map of cells."""
    return rows.select(*keys, F.posexplode(column).alias("position", "feature", "raw"))


def column_types(cells: DataFrame, keys: list[str] = (), all_missing: str = FLOAT64) -> DataFrame:
    """Type and missing count per column, one aggregation."""
    return (
        cells.groupBy(*keys, "position", "feature")
        .agg(*type_counts(F.col("raw"), F.lit(1).cast("long")))
        .select(*keys, "position", "feature", "cells", "missing", type_name(all_missing).alias("dtype"))
    )


def top_values(counted: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct values and the most frequent one (smallest on ties) from ``(keys, value, n)``."""
    best = F.min(F.struct((-F.col("n")).alias("rank"), F.col("value")))
    return (
        counted.where("value IS NOT NULL")
        .groupBy(*keys)
        .agg(F.sum("n").alias("count"), F.count(F.lit(1)).alias("unique"), best.alias("best"))
        .select(
            *keys,
            "count",
            "unique",
            F.col("best.value").alias("most_frequent"),
            (-F.col("best.rank")).alias("most_frequent_count"),
        )
    )


def profile_cells(cells: DataFrame, keys: list[str] = ()) -> DataFrame:
    """One row per (keys, column) with its type and the summary that suits the type."""
    keys = list(keys)
    per_column = [*keys, "feature"]
    number = to_number(F.col("raw"))
    summary = (
        cells.groupBy(*keys, "position", "feature")
        .agg(
            *type_counts(F.col("raw"), F.lit(1).cast("long")),
            F.count(number).alias("num_count"),
            F.avg(number).alias("mean"),
            F.min(number).alias("minimum"),
            F.max(number).alias("maximum"),
            _deviation(number).alias("standard_deviation"),
        )
        .withColumn("dtype", type_name(FLOAT64))
    )
    # Values are only counted for the columns that are not numeric; one summary row per column.
    summary = as_small_side(summary)
    numeric = F.col("dtype").isin(INT64, FLOAT64)
    words = summary.where(~numeric).select(*per_column)
    values = (
        join_on_groups(cells, as_small_side(words), per_column)
        .groupBy(*per_column, F.col("raw").alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    top = top_values(values, per_column).withColumnRenamed("count", "text_count")
    joined = join_on_groups(summary, top, per_column, "left")

    def if_numeric(name: str) -> Column:
        return F.when(numeric, F.col(name)).alias(name)

    return joined.select(
        *keys,
        "position",
        F.col("feature").alias("column"),
        "dtype",
        "cells",
        "missing",
        F.when(numeric, F.col("num_count")).otherwise(F.coalesce("text_count", F.lit(0))).alias("count"),
        if_numeric("mean"),
        if_numeric("minimum"),
        if_numeric("maximum"),
        if_numeric("standard_deviation"),
        F.when(~numeric, F.coalesce("unique", F.lit(0))).alias("unique"),
        F.when(~numeric, typed_text(F.col("most_frequent"), F.col("dtype"))).alias("most_frequent"),
        F.when(~numeric, F.coalesce("most_frequent_count", F.lit(0))).alias("most_frequent_count"),
    )


def profile_maps(profile: DataFrame, keys: list[str]) -> DataFrame:
    """Profile rows folded to one row per key, maps by column name (as many as columns)."""
    entry = F.col("column")
    numeric = F.col("dtype").isin(INT64, FLOAT64)

    def as_map(value: Column, condition: Column | None = None) -> Column:
        pair = F.struct(entry.alias("key"), value.alias("value"))
        return F.map_from_entries(F.sort_array(F.collect_list(pair if condition is None else F.when(condition, pair))))

    return profile.groupBy(*keys).agg(
        as_map(F.col("missing")).alias("missing_values"),
        as_map(F.col("dtype")).alias("column_types"),
        as_map(
            F.struct("count", "mean", "minimum", "maximum", "standard_deviation"), numeric
        ).alias("numeric_summary"),
        as_map(F.struct("count", "unique", "most_frequent", "most_frequent_count"), ~numeric).alias(
            "categorical_summary"
        ),
    )


def schema_fingerprint(types: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Hash of ``name:type`` joined by ``|`` in column order, per table."""
    name = "column" if "column" in types.columns else "feature"
    in_order = F.sort_array(F.collect_list(F.struct("position", F.concat_ws(":", name, "dtype").alias("text"))))
    text = F.array_join(F.transform(in_order, lambda c: c["text"]), "|")
    return types.groupBy(*keys).agg(F.sha2(text, 256).alias("schema_hash"))


def class_counts(df: DataFrame, target: str, keys: list[str] = ()) -> DataFrame:
    """Rows per class of the target, missing ones as their own class."""
    label = F.coalesce(F.col(target).cast("string"), F.lit(MISSING_CATEGORY))
    return df.groupBy(*keys, label.alias("class")).agg(F.count(F.lit(1)).alias("n"))


# --- typed tables -----------------------------------------------------------------------


def _declared_type(data_type: T.DataType, missing: Column) -> Column:
    if isinstance(data_type, T.IntegralType):
        return F.when(missing > 0, FLOAT64).otherwise(INT64)
    if isinstance(data_type, T.NumericType):
        return F.lit(FLOAT64)
    if isinstance(data_type, T.BooleanType):
        return F.when(missing > 0, OBJECT).otherwise(BOOL)
    return F.lit(OBJECT)


def declared_types(df: DataFrame) -> DataFrame:
    """Types and missing counts of a typed table, in one pass without unpivoting its rows."""
    counted = df.agg(*[F.count_if(is_missing(df, c)).alias(c) for c in df.columns])
    cells = [
        v
        for i, field in enumerate(df.schema)
        for v in (F.lit(i), F.lit(field.name), F.col(field.name), _declared_type(field.dataType, F.col(field.name)))
    ]
    return counted.select(F.stack(F.lit(len(df.columns)), *cells).alias("position", "column", "missing", "dtype"))


def columns_by_kind(df: DataFrame) -> tuple[list[str], list[str]]:
    """Numeric (booleans excluded) and other columns of a typed table."""
    numeric = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    return numeric, [c for c in df.columns if c not in numeric]


def numeric_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Count, mean, range and deviation of typed numeric columns: one aggregate, no shuffle of rows.

    NaN is missing, like NULL.
    """
    columns = columns if columns is not None else columns_by_kind(df)[0]
    measures = {
        "count": F.count,
        "mean": F.avg,
        "minimum": lambda c: F.min(c).cast("double"),
        "maximum": lambda c: F.max(c).cast("double"),
        "standard_deviation": _deviation,
    }
    whole = df.agg(*[f(present(df, c)).alias(f"{c}.{m}") for c in columns for m, f in measures.items()])
    cells = [v for c in columns for v in (F.lit(c), *[F.col(f"`{c}.{m}`") for m in measures])]
    return whole.select(F.stack(F.lit(len(columns)), *cells).alias("column", *measures))


def categorical_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Count, distinct values and most frequent value of the other columns."""
    columns = columns if columns is not None else columns_by_kind(df)[1]
    values = text_cells(df, columns).groupBy("feature", F.col("raw").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return top_values(values, ["feature"]).withColumnRenamed("feature", "column")
