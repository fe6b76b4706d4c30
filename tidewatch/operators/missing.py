"""Missing-value counts and rates. NaN is missing, like NULL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.text import is_missing


def missing_by_column(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Missing cells per column in one pass without unpivoting the rows."""
    columns = columns or df.columns
    counted = df.agg(*[F.count_if(is_missing(df, c)).alias(c) for c in columns])
    pairs = [cell for c in columns for cell in (F.lit(c), F.col(c))]
    return counted.select(F.stack(F.lit(len(columns)), *pairs).alias("column", "missing"))


def missing_cells(df: DataFrame, features: list[str], keys: list[str] = ()) -> DataFrame:
    """Missing cells over the given features, per key."""
    missing = F.lit(0)
    for f in features:
        missing = missing + is_missing(df, f).cast("int")
    return df.groupBy(*keys).agg(F.sum(missing).alias("missing_cells"), F.count(F.lit(1)).alias("rows"))


def missing_rate(df: DataFrame, features: list[str], keys: list[str] = ()) -> DataFrame:
    """Share of missing cells over all rows and all features, per key; 0 without cells."""
    cells = F.col("rows") * len(features)
    rate = F.when(cells > 0, F.col("missing_cells") / cells).otherwise(0.0)
    return missing_cells(df, features, keys).select(*keys, rate.alias("missing_rate"))
