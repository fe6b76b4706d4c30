"""Tie-aware area under the ROC curve from sorted counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.text import null_if_nan
from tidewatch.operators.cumulative import CHUNK, chunked, join_on_groups
from tidewatch.operators.metrics import CONF, POSITIVE, PRED, TRUE, label_totals
from tidewatch.session import as_small_side, cut_lineage


def area_under_roc(scored: DataFrame, keys: list[str] = ()) -> DataFrame:
    """AUC per key from ``(keys, score, pos, neg)`` counts; NULL with one class only.

    With the negatives below a score known, the area is the sum of ``pos * (below + neg / 2)``
    over ``P * N``. Each chunk of a sorted group is reduced to its counts and its inner area;
    what lies below the whole chunk is added afterwards, from one row per chunk.
    """
    keys = list(keys)
    merged = scored.groupBy(*keys, "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    rows = chunked(merged, keys, ["score"], ["neg"])
    below = F.col("run_neg") - F.col("neg") / F.lit(2.0)
    pieces = rows.groupBy(CHUNK, *keys).agg(
        F.sum("pos").alias("pos"),
        F.sum("neg").alias("neg"),
        F.sum(F.col("pos") * below).alias("inner"),
    )
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.withColumn("below", F.coalesce(F.sum("neg").over(before), F.lit(0)))
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    area = F.sum(F.col("inner") + F.col("pos").cast("double") * F.col("below"))
    return placed.groupBy(*keys).agg(F.when(pairs > 0, area / pairs).alias("roc_auc"))


def score_counts(df: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Rows per (keys, true label, predicted label, score).

    Written once: labels, positive class and the ranking are all read from it.
    """
    names = df.columns
    given = F.col(POSITIVE) if POSITIVE in names else F.lit(None)
    true = F.col(TRUE) if TRUE in names else F.lit(None)
    conf = null_if_nan(F.col(CONF).cast("double")) if CONF in names else F.lit(None)
    return cut_lineage(
        df.groupBy(
            *keys,
            true.cast("string").alias(TRUE),
            F.col(PRED).cast("string").alias(PRED),
            conf.cast("double").alias("score"),
            given.cast("string").alias(POSITIVE),
        ).agg(F.count(F.lit(1)).alias("n"))
    )


def auc_from_counts(counted: DataFrame, keys: list[str] = ()) -> DataFrame:
    """AUC per key from ``score_counts``; NULL unless it is defined.

    It is defined for two labels in all (true and predicted together), complete labels and
    complete scores. The positive class is the given one, else the last of the two labels.
    """
    keys = list(keys)
    # Grouping by the positive class, one per key, keeps this pass over the counts hash-based.
    present = F.col(TRUE).isNotNull() & F.col("score").isNotNull()
    per_positive = counted.groupBy(*keys, POSITIVE).agg(F.bool_and(present).alias("complete"))
    whole = per_positive.groupBy(*keys).agg(
        F.max(POSITIVE).alias("given"), F.bool_and("complete").alias("complete")
    )
    labels = label_totals(counted, keys).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("label_count"), F.max("label").alias("last_label")
    )
    usable = F.col("complete") & (F.col("label_count") == 2)
    rule = join_on_groups(whole, labels, keys).select(
        *keys, F.when(usable, F.coalesce("given", "last_label")).alias("positive")
    )
    # One row per key, read twice below.
    rule = as_small_side(rule) if keys else cut_lineage(rule)
    hit = F.when(F.col(TRUE) == F.col("positive"), F.col("n")).otherwise(0)
    eligible = join_on_groups(counted, rule, keys).where("positive IS NOT NULL")
    area = area_under_roc(eligible.select(*keys, "score", hit.alias("pos"), (F.col("n") - hit).alias("neg")), keys)
    return join_on_groups(rule.select(*keys) if keys else rule.select(F.lit(1).alias("one")), area, keys, "left").select(
        *keys, "roc_auc"
    )


def roc_auc(df: DataFrame, keys: list[str] = ()) -> DataFrame:
    """AUC of ``confidence`` as it is logged, for the positive class, per key."""
    return auc_from_counts(score_counts(df, list(keys)), list(keys))
