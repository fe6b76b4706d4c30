"""Long observations and the frequency table all drift measures are derived from.

An observation is one feature value of one row: ``(keys, feature, num, txt, gap)``. Numeric
features fill ``num`` and leave ``txt`` NULL; categorical ones fill ``txt``, with ``MISSING``
for a missing value, which ``gap`` marks. The frequency table counts each distinct value on
the reference and the current side. Partial aggregation collapses repeated values before the
shuffle, so a value held by a third of the rows costs one row per map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.text import MISSING_CATEGORY, number_text

NUMERIC, CATEGORICAL = "numeric", "categorical"


def is_numeric_type(data_type: T.DataType) -> bool:
    """Numbers and booleans are compared as numbers."""
    return isinstance(data_type, (T.NumericType, T.BooleanType))


def shared_features(reference: DataFrame, current: DataFrame, keys: list[str] = ()) -> list[str]:
    return sorted((set(reference.columns) & set(current.columns)) - set(keys))


def feature_kinds(reference: DataFrame, current: DataFrame, features: list[str]) -> dict[str, str]:
    """A feature is numeric only when it is numeric on both sides."""
    return {
        f: NUMERIC
        if is_numeric_type(reference.schema[f].dataType) and is_numeric_type(current.schema[f].dataType)
        else CATEGORICAL
        for f in features
    }


def _category_text(name: str, data_type: T.DataType) -> Column:
    value = F.col(name)
    if isinstance(data_type, T.BooleanType):
        return F.initcap(value.cast("string"))
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(value), number_text(value.cast("double")))
    return value.cast("string")


def observations(df: DataFrame, kinds: dict[str, str], keys: list[str] = ()) -> DataFrame:
    """Unpivot the features of a typed table; one scan, no shuffle."""
    cells: list[Column] = []
    for name, kind in kinds.items():
        data_type = df.schema[name].dataType
        if kind == NUMERIC:
            number = F.col(name).cast("double")
            number = F.when(~F.isnan(number), number)
            text, gap = F.lit(None).cast("string"), number.isNull()
        else:
            number = F.lit(None).cast("double")
            known = _category_text(name, data_type)
            text, gap = F.coalesce(known, F.lit(MISSING_CATEGORY)), known.isNull()
        cells += [F.lit(name), number, text, gap.cast("long")]
    return df.select(*keys, F.stack(F.lit(len(kinds)), *cells).alias("feature", "num", "txt", "gap"))


def count_values(sides: DataFrame, groups: list[str]) -> DataFrame:
    """Count distinct values per group on both sides of ``sides`` (``ref_n``, ``cur_n`` per row).

    ``gap_n`` counts missing current cells. Missing numbers keep their group alive with a
    zero count on either side.
    """
    counted = sides.groupBy(*groups, "feature", "num", "txt").agg(
        F.sum("ref_n").alias("ref_n"), F.sum("cur_n").alias("cur_n"), F.sum("gap_n").alias("gap_n")
    )
    present = F.col("num").isNotNull() | F.col("txt").isNotNull()
    return counted.withColumns({c: F.when(present, F.col(c)).otherwise(0) for c in ("ref_n", "cur_n")})


def frequency_table(reference: DataFrame, current: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Value counts of the shared features of two typed tables."""
    keys = list(keys)
    kinds = feature_kinds(reference, current, shared_features(reference, current, keys))
    if not kinds:
        counts = [T.StructField(c, T.LongType()) for c in ("ref_n", "cur_n", "gap_n")]
        values = [T.StructField("feature", T.StringType()), T.StructField("num", T.DoubleType())]
        empty = [reference.schema[k] for k in keys] + values + [T.StructField("txt", T.StringType()), *counts]
        return reference.sparkSession.createDataFrame([], T.StructType(empty))

    def side(df: DataFrame, ref_n: int) -> DataFrame:
        long = observations(df, kinds, keys)
        gap = F.lit(0) if ref_n else F.col("gap")
        return long.select(
            *keys,
            "feature",
            "num",
            "txt",
            F.lit(ref_n).cast("long").alias("ref_n"),
            F.lit(1 - ref_n).cast("long").alias("cur_n"),
            gap.cast("long").alias("gap_n"),
        )

    return count_values(side(reference, 1).unionByName(side(current, 0)), keys)
