"""Classification quality and confidence measures, keyed by any columns (batch, model, ...).

Rows are counted once per (keys, true label, predicted label); every measure follows from
those counts, so only the counts are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.text import null_if_nan
from tidewatch.operators.cumulative import join_on_groups
from tidewatch.session import cut_lineage

# Fixed value: a confidence below this is low.
LOW_CONFIDENCE = 0.60

# Fixed value: message of a log with confidences outside 0..1.
NOT_IN_RANGE = "Confidence values must be between 0 and 1."

TRUE, PRED, CONF, POSITIVE = "true_label", "predicted_label", "confidence", "positive_class"


def label_counts(
    df: DataFrame,
    keys: list[str] = (),
    low_confidence: float = LOW_CONFIDENCE,
) -> DataFrame:
    """Rows per (keys, true, predicted) with confidence sums."""
    names = df.columns
    conf = null_if_nan(F.col(CONF).cast("double")) if CONF in names else F.lit(None).cast("double")
    true = F.col(TRUE).cast("string") if TRUE in names else F.lit(None).cast("string")
    positive = F.col(POSITIVE).cast("string") if POSITIVE in names else F.lit(None).cast("string")
    rows = df.select(
        *keys,
        true.alias(TRUE),
        F.col(PRED).cast("string").alias(PRED),
        conf.alias(CONF),
        positive.alias(POSITIVE),
    )
    # The positive class is constant per key; grouping by it keeps all buffers fixed-width.
    return rows.groupBy(*keys, TRUE, PRED, POSITIVE).agg(
        F.count(F.lit(1)).alias("n"),
        F.count(CONF).alias("conf_n"),
        F.sum(CONF).alias("conf_sum"),
        F.min(CONF).alias("conf_min"),
        F.max(CONF).alias("conf_max"),
        F.count_if(F.col(CONF) < low_confidence).alias("low_n"),
        F.count_if((F.col(CONF) < 0) | (F.col(CONF) > 1)).alias("out_of_range_n"),
    )


def confusion_counts(counts: DataFrame, keys: list[str] = ()) -> DataFrame:
    """The occupied cells of the confusion matrix."""
    return counts.where(f"{TRUE} IS NOT NULL").select(*keys, TRUE, PRED, "n")


def label_totals(counts: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Per label: rows with it as true label, as predicted label, and as both."""
    as_true = F.struct(
        F.col(TRUE).alias("label"),
        F.col("n").alias("support"),
        F.lit(0).cast("long").alias("predicted"),
        F.when(F.col(TRUE) == F.col(PRED), F.col("n")).otherwise(0).alias("hits"),
    )
    as_pred = F.struct(
        F.col(PRED).alias("label"),
        F.lit(0).cast("long").alias("support"),
        F.col("n").alias("predicted"),
        F.lit(0).cast("long").alias("hits"),
    )
    return (
        counts.select(*keys, F.inline(F.array(as_true, as_pred)))
        .where("label IS NOT NULL")
        .groupBy(*keys, "label")
        .agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hits")])
    )


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def per_class_metrics(totals: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Precision, recall and F1 per label; a ratio with nothing below it is 0."""
    hits, support, predicted = F.col("hits"), F.col("support"), F.col("predicted")
    return totals.select(
        *keys,
        "label",
        _ratio(hits, predicted).alias("precision"),
        _ratio(hits, support).alias("recall"),
        _ratio(2 * hits, support + predicted).alias("f1"),
        "support",
        "predicted",
    )


def dense_confusion(counts: DataFrame, keys: list[str] = ()) -> DataFrame:
    """One row per true label with its counts aligned to the sorted label list.

    A display form, as wide as the number of classes; nothing else is computed from it.
    """
    counts = cut_lineage(counts)
    totals = label_totals(counts, keys)
    labels = totals.groupBy(*keys).agg(F.array_sort(F.collect_list("label")).alias("labels"))
    cells = confusion_counts(counts, keys).groupBy(*keys, F.col(TRUE).alias("label")).agg(
        F.map_from_entries(F.collect_list(F.struct(PRED, "n"))).alias("cells")
    )
    rows = join_on_groups(totals.select(*keys, "label"), cells, [*keys, "label"], "left")
    rows = join_on_groups(rows, labels, keys)
    counts_in_order = F.transform("labels", lambda name: F.coalesce(F.element_at("cells", name), F.lit(0)))
    return rows.select(*keys, "label", "labels", counts_in_order.alias("counts"))


def class_shares(totals: DataFrame, column: str, keys: list[str] = ()) -> DataFrame:
    """Share of each label among the true (``support``) or ``predicted`` labels."""
    occurring = cut_lineage(totals).where(F.col(column) > 0)
    whole = occurring.groupBy(*keys).agg(F.sum(column).alias("whole"))
    joined = join_on_groups(occurring, whole, keys)
    return joined.select(*keys, "label", F.col(column).alias("n"), (F.col(column) / F.col("whole")).alias("share"))


def metric_bundle(counts: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Every count-based measure, one row per key.

    Quality measures need every true label, confidence measures every confidence; they are
    NULL otherwise. Two labels give binary averages at the positive class, any other number
    gives support-weighted averages.
    """
    keys = list(keys)
    # Read three times below: written once, so that the rows are scanned once.
    counts = cut_lineage(counts)
    whole = counts.groupBy(*keys).agg(
        F.sum("n").alias("sample_count"),
        F.sum(F.when(F.col(TRUE).isNull(), F.col("n")).otherwise(0)).alias("unlabeled_n"),
        F.sum(F.when(F.col(TRUE) == F.col(PRED), F.col("n")).otherwise(0)).alias("correct"),
        *[F.sum(c).alias(c) for c in ("conf_n", "conf_sum", "low_n", "out_of_range_n")],
        F.min("conf_min").alias("conf_min"),
        F.max("conf_max").alias("conf_max"),
        F.max(POSITIVE).alias("given_positive"),
    )
    scores = F.struct("precision", "recall", "f1")
    label_rows = per_class_metrics(label_totals(counts, keys), keys)
    named = counts.groupBy(*keys).agg(F.max(POSITIVE).alias("given"))
    label_rows = join_on_groups(label_rows, named, keys)
    support, predicted = F.col("support"), F.col("predicted")
    by_label = label_rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("label_count"),
        F.max("label").alias("last_label"),
        F.max_by(scores, F.col("label")).alias("at_last"),
        F.max(F.when(F.col("label") == F.col("given"), scores)).alias("at_given"),
        *[F.try_divide(F.sum(F.col(c) * support), F.sum(support)).alias(f"weighted_{c}") for c in ("precision", "recall", "f1")],
        F.min(F.when(support > 0, support)).alias("true_min"),
        F.max(support).alias("true_max"),
        F.count_if(support > 0).alias("true_labels"),
        F.min(F.when(predicted > 0, predicted)).alias("pred_min"),
        F.max(predicted).alias("pred_max"),
        F.count_if(predicted > 0).alias("pred_labels"),
    )
    joined = join_on_groups(whole, by_label, keys)

    labeled = F.col("unlabeled_n") == 0
    usable = F.col("conf_n") == F.col("sample_count")
    binary = F.col("label_count") == 2
    given = F.col("given_positive")
    positive = F.coalesce(given, F.when(binary, F.col("last_label")))

    def quality(name: str) -> Column:
        at_positive = F.when(given.isNull(), F.col("at_last")[name]).otherwise(F.col("at_given")[name])
        return F.when(labeled, F.when(binary, at_positive).otherwise(F.col(f"weighted_{name}"))).alias(name)

    accuracy = F.col("correct") / F.col("sample_count")
    shares = {
        side: (F.col(f"{side}_min"), F.col(f"{side}_max"), F.col(f"{side}_labels")) for side in ("true", "pred")
    }

    def by_side(i: int) -> Column:
        return F.when(labeled, shares["true"][i]).otherwise(shares["pred"][i])

    error = F.when(
        F.col("out_of_range_n") > 0, NOT_IN_RANGE
    ).when(
        labeled & binary & given.isNotNull() & F.col("at_given").isNull(),
        F.concat(F.lit("Positive class '"), given, F.lit("' is not one of the labels.")),
    )
    return joined.select(
        *keys,
        "sample_count",
        labeled.alias("fully_labeled"),
        F.when(labeled, F.col("label_count")).alias("label_count"),
        F.when(labeled, positive).alias("positive_label"),
        F.when(labeled, accuracy).alias("accuracy"),
        quality("precision"),
        quality("recall"),
        quality("f1"),
        F.when(labeled, F.lit(1.0) - accuracy).alias("error_rate"),
        F.when(usable, F.col("conf_sum") / F.col("conf_n")).alias("average_confidence"),
        F.when(usable, F.col("low_n") / F.col("conf_n")).alias("low_confidence_rate"),
        F.when(usable, F.col("conf_min")).alias("minimum_confidence"),
        F.when(usable, F.col("conf_max")).alias("maximum_confidence"),
        (by_side(0) / F.col("sample_count")).alias("minimum_share"),
        (by_side(1) / F.col("sample_count")).alias("maximum_share"),
        by_side(2).alias("class_count"),
        error.alias("metric_error"),
    )


def classification_metrics(
    df: DataFrame, keys: list[str] = (), low_confidence: float = LOW_CONFIDENCE
) -> DataFrame:
    """Labeled or unlabeled measures per key, without the ranking measure of ``ranking``."""
    return metric_bundle(label_counts(df, list(keys), low_confidence), list(keys))
