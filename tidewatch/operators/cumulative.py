"""Exact running totals over a sorted group without putting a group into one task.

Rows are range-partitioned on (group, order), so a group that holds a third of the data is
spread over many partitions. Running sums are taken inside each partition's piece of a group
(a *chunk*); a table with one row per chunk then supplies what precedes it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.session import as_small_side, cut_lineage

CHUNK = "chunk_no"


def join_on_groups(left: DataFrame, right: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """Null-safe equi-join that keeps ``left``'s columns and adds the rest of ``right``.

    The right keys are renamed first, so both sides may stem from one table. Without keys,
    ``right`` is a global aggregate, that is exactly one row, and is attached to every row.
    """
    if not names:
        return left.join(F.broadcast(right))
    keys = {n: f"right_{n}" for n in names}
    extra = [c for c in right.columns if c not in names]
    renamed = right.select(*[F.col(n).alias(k) for n, k in keys.items()], *extra)
    condition = reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(k)) for n, k in keys.items()])
    return left.join(renamed, condition, how).select(*left.columns, *extra)


def chunked(df: DataFrame, groups: list[str], order: list[str], measures: list[str]) -> DataFrame:
    """Add ``chunk_no`` and ``run_<m>`` (inclusive running sum inside the chunk)."""
    ranged = df.repartitionByRange(*groups, *order).withColumn(CHUNK, F.spark_partition_id())
    upto = (
        Window.partitionBy(CHUNK, *groups)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return ranged.select("*", *[F.sum(m).over(upto).alias(f"run_{m}") for m in measures])


def running_totals(
    df: DataFrame, groups: list[str], order: list[str], measures: list[str], few_groups: bool = False
) -> DataFrame:
    """Add ``cum_<m>`` (inclusive running sum) and ``all_<m>`` (group sum) per measure.

    ``df`` must have one row per (group, order) and non-negative measures. The chunked rows
    are written once: chunk numbers depend on sampled range bounds, so both readers (the
    chunk sums and the rows) have to see the same ones. ``few_groups`` says that the schema
    bounds the number of groups.
    """
    rows = cut_lineage(chunked(df, groups, order, measures))
    sums = rows.groupBy(CHUNK, *groups).agg(*[F.max(f"run_{m}").alias(f"sum_{m}") for m in measures])
    # One row per chunk of a group: at most as many as there are shuffle partitions.
    group = Window.partitionBy(*groups)
    before = group.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        CHUNK,
        *groups,
        *[F.coalesce(F.sum(f"sum_{m}").over(before), F.lit(0)).alias(f"before_{m}") for m in measures],
        *[F.sum(f"sum_{m}").over(group).alias(f"all_{m}") for m in measures],
    )
    offsets = as_small_side(cut_lineage(offsets) if few_groups else offsets, few_groups)
    joined = join_on_groups(rows, offsets, [CHUNK, *groups])
    return joined.select(
        *df.columns,
        *[(F.col(f"before_{m}") + F.col(f"run_{m}")).alias(f"cum_{m}") for m in measures],
        *[F.col(f"all_{m}") for m in measures],
    )
