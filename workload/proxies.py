"""The test tables read as prediction logs, baselines and registries; Spark and SQL side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from workload import table

SPLIT = "1998-07-01"
ORDER_SPLIT = "1998-01-01"
EVENT_SPLIT = "2024-01-16"

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag"]
NUMBERS = FEATURES[:4]


def before(column: str, day: str) -> Column:
    return F.col(column) < F.lit(day).cast("timestamp_ntz")


def batch_of() -> Column:
    """Batches 0 to 7 of lineitem; batch 0 holds two fifths of the rows."""
    return F.when(F.col("l_orderkey") % 10 < 3, 0).otherwise(F.col("l_suppkey") % 8).cast("bigint")


BATCH_SQL = "CASE WHEN l_orderkey % 10 < 3 THEN 0 ELSE l_suppkey % 8 END"


def binary_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as a log: the true label is the line status, about a fifth is mispredicted."""
    shipped = F.col("l_linestatus") == "F"
    wrong = (F.col("l_orderkey") + F.col("l_linenumber")) % 10 >= 8
    label = F.when(shipped, "1").otherwise("0")
    other = F.when(shipped, "0").otherwise("1")
    return table(spark, sf_dir, "lineitem").select(
        "*",
        (F.col("l_suppkey") % 8).alias("batch_id"),
        (F.col("l_suppkey") % 4).alias("model_id"),
        label.alias("true_label"),
        F.when(wrong, other).otherwise(label).alias("predicted_label"),
        (F.col("l_discount") * 5 + 0.5).alias("confidence"),
    )


BINARY_LOG = """
binary_log AS (
  SELECT *, l_suppkey % 8 AS batch_id, l_suppkey % 4 AS model_id,
    CASE WHEN l_linestatus = 'F' THEN '1' ELSE '0' END AS true_label,
    CASE WHEN (l_linestatus = 'F') = ((l_orderkey + l_linenumber) % 10 < 8) THEN '1' ELSE '0' END AS predicted_label,
    l_discount * 5 + 0.5::DOUBLE AS confidence
  FROM lineitem)
"""


def multiclass_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with the return flag as label; every seventh row is predicted as the next flag."""
    flag = F.col("l_returnflag")
    following = F.when(flag == "A", "N").when(flag == "N", "R").otherwise("A")
    wrong = (F.col("l_partkey") + F.col("l_linenumber")) % 7 == 0
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 8).alias("batch_id"),
        flag.alias("true_label"),
        F.when(wrong, following).otherwise(flag).alias("predicted_label"),
        (F.col("l_discount") * 5 + 0.5).alias("confidence"),
    )


MULTICLASS_LOG = """
multiclass_log AS (
  SELECT l_suppkey % 8 AS batch_id, l_returnflag AS true_label,
    CASE WHEN (l_partkey + l_linenumber) % 7 = 0
      THEN CASE l_returnflag WHEN 'A' THEN 'N' WHEN 'N' THEN 'R' ELSE 'A' END
      ELSE l_returnflag END AS predicted_label,
    l_discount * 5 + 0.5::DOUBLE AS confidence
  FROM lineitem)
"""


def split_lineitem(spark: SparkSession, sf_dir: str, columns: list[str], keys: dict[str, Column] | None = None):
    """lineitem before and from the split day, reduced to keys and columns."""
    items = table(spark, sf_dir, "lineitem")
    wanted = [column.alias(name) for name, column in (keys or {}).items()]
    early = before("l_shipdate", SPLIT)
    return items.where(early).select(*wanted, *columns), items.where(~early).select(*wanted, *columns)


def feature_map(columns: list[str]) -> Column:
    """Columns as a map from name to text, the form stored rows have."""
    return F.create_map(*[v for c in columns for v in (F.lit(c), F.col(c).cast("string"))])
