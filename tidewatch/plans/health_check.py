"""Health checks: resolve requests, measure, score and diagnose, any number in one job."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators.baseline import (
    BATCH,
    CUR,
    REF,
    BaselineIndex,
    categorical_measures,
    category_counts,
    category_shares,
    index_of,
    numeric_measures,
    shared_features,
    stretches_of,
    value_counts,
    value_types,
)
from tidewatch.operators.cumulative import join_on_groups
from tidewatch.operators.drift import DriftThresholds, drift_summary, feature_drift, judged
from tidewatch.operators.frequency import CATEGORICAL, NUMERIC
from tidewatch.operators.health import component_scores, diagnosis, health_score
from tidewatch.operators.metrics import (
    CONF,
    LOW_CONFIDENCE,
    POSITIVE,
    PRED,
    TRUE,
    confusion_counts,
    label_totals,
    metric_bundle,
    per_class_metrics,
)
from tidewatch.operators.missing import missing_cells
from tidewatch.operators.ranking import auc_from_counts, score_counts
from tidewatch.session import as_small_side, cut_lineage, small_batches

# Columns of a prediction log that are not features.
RESERVED_COLUMNS = ["timestamp", "true_label", "predicted_label", "confidence"]

# Messages of requests that cannot be run, in the order they are checked.
NOT_FOUND = "%s with ID %s was not found."
FOREIGN_MODEL = "The selected model version does not belong to the selected project."
FOREIGN_DATASET = "The baseline dataset does not belong to the selected project."
FOREIGN_BATCH = "The prediction batch does not belong to the selected project."
OTHER_MODEL = "The prediction batch was not generated by the selected model version."
EMPTY_BATCH = "The prediction batch contains no prediction records."
EMPTY_BASELINE = "Baseline dataset %s has no stored rows."

METRICS = [
    "sample_count",
    "label_count",
    "positive_label",
    "accuracy",
    "precision",
    "recall",
    "f1",
    "error_rate",
    "roc_auc",
    "average_confidence",
    "low_confidence_rate",
    "minimum_confidence",
    "maximum_confidence",
    "minimum_share",
    "maximum_share",
    "class_count",
]
DRIFT = ["feature_count", "drifted_feature_count", "drift_rate", "drifted_features"]
COMPONENTS = [
    "performance_score",
    "drift_score",
    "data_quality_score",
    "confidence_score",
    "class_balance_score",
]
# What a failed check does not have.
VERDICT = [
    *COMPONENTS,
    "health_score",
    "status",
    "risk_level",
    "retraining_recommended",
    "summary",
    "findings",
    "recommendations",
]


def _metrics(counted: DataFrame, keys: list[str], low_confidence: float = LOW_CONFIDENCE) -> DataFrame:
    """Metric bundle and AUC per key from one written count table."""
    score, n = F.col("score"), F.col("n")
    counts = counted.groupBy(*keys, TRUE, PRED, POSITIVE).agg(
        F.sum(n).alias("n"),
        F.sum(F.when(score.isNotNull(), n).otherwise(0)).alias("conf_n"),
        F.sum(score * n).alias("conf_sum"),
        F.min(score).alias("conf_min"),
        F.max(score).alias("conf_max"),
        F.sum(F.when(score < low_confidence, n).otherwise(0)).alias("low_n"),
        F.sum(F.when((score < 0) | (score > 1), n).otherwise(0)).alias("out_of_range_n"),
    )
    # One row per key: written, so that the final plan stays small.
    return as_small_side(join_on_groups(metric_bundle(counts, keys), auc_from_counts(counted, keys), keys, "left"))


def _scored(joined: DataFrame) -> DataFrame:
    return diagnosis(health_score(component_scores(joined)))


def check_tables(
    reference: DataFrame,
    predictions: DataFrame,
    keys: list[str] = (),
    target: str | None = None,
    limits: DriftThresholds = DriftThresholds(),
    low_confidence: float = LOW_CONFIDENCE,
) -> DataFrame:
    """Health check of a typed prediction table against a typed reference table, per key.

    Both tables carry the key columns; every other column of ``predictions`` that is not
    reserved is a feature. ``target`` is dropped from the reference if it is there. A check
    that cannot be scored says why in ``error_message``.
    """
    keys = list(keys)
    features = [c for c in predictions.columns if c not in (*RESERVED_COLUMNS, POSITIVE, *keys)]
    if target:
        reference = reference.drop(target)
    drift = feature_drift(reference, predictions.select(*keys, *features), keys, limits)
    metrics = _metrics(score_counts(predictions, keys), keys, low_confidence)
    joined = join_on_groups(metrics, cut_lineage(drift_summary(drift, keys)), keys, "left")
    # The drift pass has counted the gaps of the shared features; only others are read again.
    others = [f for f in features if f not in reference.columns]
    if others:
        gaps = missing_cells(predictions, others, keys)
        joined = join_on_groups(joined, gaps, keys, "left")
    else:
        joined = joined.withColumn("missing_cells", F.lit(0).cast("long"))
    cells = F.col("sample_count") * len(features)
    missing = F.coalesce("missing_n", F.lit(0)) + F.coalesce("missing_cells", F.lit(0))
    scored = _scored(
        joined.withColumn("missing_rate", F.when(cells > 0, missing / cells).otherwise(0.0)).withColumn(
            "drift_rate", F.coalesce("drift_rate", F.lit(0.0))
        )
    )
    errors = ["drift_error", "metric_error", "score_error"]
    checked = scored.withColumn("error_message", F.coalesce(*errors)).drop(*errors, "missing_n", "missing_cells")
    usable = F.col("error_message").isNull()
    return checked.withColumns({c: F.when(usable, F.col(c)) for c in VERDICT})


def resolve_requests(
    requests: DataFrame,
    projects: DataFrame,
    model_versions: DataFrame,
    datasets: DataFrame,
    prediction_batches: DataFrame,
) -> DataFrame:
    """Look up the four entities of each request and name the first rule it breaks.

    ``requests`` has check_id, project_id, model_version_id, baseline_dataset_id and
    prediction_batch_id. The registries are joined by their unique id, so no row multiplies.
    """
    found = (
        requests.join(
            projects.select(
                F.col("id").alias("project_id"), F.lit(True).alias("has_project"), "target_column", POSITIVE
            ),
            "project_id",
            "left",
        )
        .join(
            model_versions.select(F.col("id").alias("model_version_id"), F.col("project_id").alias("model_project")),
            "model_version_id",
            "left",
        )
        .join(
            datasets.select(F.col("id").alias("baseline_dataset_id"), F.col("project_id").alias("dataset_project")),
            "baseline_dataset_id",
            "left",
        )
        .join(
            prediction_batches.select(
                F.col("id").alias("prediction_batch_id"),
                F.col("project_id").alias("batch_project"),
                F.col("model_version_id").alias("batch_model"),
            ),
            "prediction_batch_id",
            "left",
        )
    )

    def absent(kind: str, column: str) -> Column:
        return F.format_string(NOT_FOUND, F.lit(kind), F.col(column).cast("string"))

    problem = (
        F.when(F.col("has_project").isNull(), absent("Project", "project_id"))
        .when(F.col("model_project").isNull(), absent("Model version", "model_version_id"))
        .when(F.col("dataset_project").isNull(), absent("Dataset", "baseline_dataset_id"))
        .when(F.col("batch_project").isNull(), absent("Prediction batch", "prediction_batch_id"))
        .when(F.col("model_project") != F.col("project_id"), FOREIGN_MODEL)
        .when(F.col("dataset_project") != F.col("project_id"), FOREIGN_DATASET)
        .when(F.col("batch_project") != F.col("project_id"), FOREIGN_BATCH)
        .when(F.col("batch_model") != F.col("model_version_id"), OTHER_MODEL)
    )
    return found.select(
        "check_id",
        "project_id",
        "model_version_id",
        "baseline_dataset_id",
        "prediction_batch_id",
        "target_column",
        POSITIVE,
        problem.alias("request_error"),
    )


def of_owners(rows: DataFrame, columns: list[str], owners: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows of the wanted owners, listed in ``owners`` by columns of the same names.

    The ranges of the ids are filters in their own right, which file statistics serve; being
    selective, they also let the optimizer prune partition folders down to the listed ids.
    """
    ends = owners.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("low", F.min), ("high", F.max))]).first()
    for c in columns:
        wanted = F.col(c).between(ends[f"low_{c}"], ends[f"high_{c}"])
        rows, owners = rows.where(wanted), owners.where(wanted)
    return rows.join(owners, columns, how)


@dataclass
class CheckRun:
    """What a run of checks found: a row per request, and the details behind the finished ones.

    ``features`` has a row per check and feature, ``categories`` one per category of a
    categorical feature, ``classes`` one per label of the checked batch, ``confusion`` one per
    occupied cell.
    """

    results: DataFrame
    features: DataFrame
    categories: DataFrame
    classes: DataFrame
    confusion: DataFrame


def run_health_checks(*tables: DataFrame, **named) -> DataFrame:
    """The ``results`` of ``run_checks``: one row per request."""
    return run_checks(*tables, **named).results


def run_checks(
    requests: DataFrame,
    projects: DataFrame,
    model_versions: DataFrame,
    datasets: DataFrame,
    prediction_batches: DataFrame,
    baseline_rows: DataFrame | BaselineIndex,
    predictions: DataFrame,
    limits: DriftThresholds = DriftThresholds(),
    low_confidence: float = LOW_CONFIDENCE,
) -> CheckRun:
    """Run every requested check; one row per request, failed ones with ``error_message``.

    ``baseline_rows`` has dataset_id and features, ``predictions`` batch_id, true_label,
    predicted_label, confidence and features; features are maps from name to text. In place of its
    rows the index of the baselines may be given. Checks of the same batch and baseline are
    measured once.
    """
    resolved = cut_lineage(resolve_requests(requests, projects, model_versions, datasets, prediction_batches))
    valid = resolved.where("request_error IS NULL")
    of_pair = ["dataset_id", "batch_id"]
    checks = valid.select(
        "check_id", F.col("baseline_dataset_id").alias("dataset_id"), F.col("prediction_batch_id").alias("batch_id"), "target_column"
    )
    labels = _beside(resolved.sparkSession, lambda: _labels(valid, predictions, low_confidence))
    wanted = as_small_side(checks.select("dataset_id").distinct())
    tested = as_small_side(checks.select("batch_id").distinct())
    values = value_counts(of_owners(predictions.select("batch_id", "features"), ["batch_id"], tested), "batch_id", CUR)
    indexed = isinstance(baseline_rows, BaselineIndex)
    if not indexed:
        rows = of_owners(baseline_rows.select("dataset_id", "features"), ["dataset_id"], wanted)
        values = values.unionByName(value_counts(rows, "dataset_id", REF))
    values = cut_lineage(values)
    types = as_small_side(value_types(values))
    stretches = stretches_of(values, types)
    index = baseline_rows if indexed else index_of(values, types, stretches)
    known = as_small_side(index.features.join(wanted, "dataset_id", "left_semi")) if indexed else index.features
    shared = as_small_side(shared_features(checks.drop("check_id").distinct(), known, types))
    numeric, worded = (shared.where(F.col("kind") == k) for k in (NUMERIC, CATEGORICAL))
    word_kinds = as_small_side(
        worded.select(F.lit(CUR).alias("side"), F.col("batch_id").alias("owner"), "feature", F.col("cur_dtype").alias("dtype")).distinct()
    )
    words = cut_lineage(category_counts(values, word_kinds))
    # Baselines' categories are read for features that are compared as categories.
    of_words = index.categories.join(as_small_side(worded.select("dataset_id", "feature").distinct()), ["dataset_id", "feature"], "left_semi")
    measured = numeric_measures(stretches, numeric, index.slices)
    measured = measured.unionByName(categorical_measures(words, worded, of_words))
    with small_batches(resolved.sparkSession, *BATCH):
        pairs = as_small_side(judged(measured, [*of_pair, "feature"], limits))
    drift = checks.drop("target_column").join(pairs, of_pair).drop(*of_pair)
    summary = as_small_side(drift_summary(drift, ["check_id"]).drop("missing_n"))
    missing = types.where(F.col("side") == CUR).groupBy(F.col("owner").alias("prediction_batch_id")).agg((F.sum("missing") / F.sum("cells")).alias("missing_rate"))
    baselines = known.select(F.col("dataset_id").alias("baseline_dataset_id")).distinct()

    counted, metrics = labels()
    joined = (
        valid.join(baselines.withColumn("has_baseline", F.lit(True)), "baseline_dataset_id", "left")
        .join(metrics, "prediction_batch_id", "left")
        .join(missing, "prediction_batch_id", "left")
        .join(summary, "check_id", "left")
        .withColumn("missing_rate", F.coalesce("missing_rate", F.lit(0.0)))
        .withColumn("feature_count", F.coalesce("feature_count", F.lit(0).cast("long")))
        .withColumn("drifted_feature_count", F.coalesce("drifted_feature_count", F.lit(0).cast("long")))
        .withColumn("drift_rate", F.coalesce("drift_rate", F.lit(0.0)))
        .withColumn("drifted_features", F.coalesce("drifted_features", F.array().cast("array<string>")))
    )
    data_error = (
        F.when(
            F.col("has_baseline").isNull(),
            F.format_string(EMPTY_BASELINE, F.col("baseline_dataset_id").cast("string")),
        )
        .when(F.col("sample_count").isNull(), EMPTY_BATCH)
        .otherwise(F.coalesce("drift_error", "metric_error"))
    )
    scored = _scored(joined)
    failed = F.coalesce(data_error, F.col("score_error"))
    results = [*METRICS, *DRIFT, "missing_rate", *VERDICT]
    done = scored.withColumn("error_message", failed).select(
        "check_id", *[F.when(F.col("error_message").isNull(), F.col(c)).alias(c) for c in results], "error_message"
    )
    results = cut_lineage(
        resolved.join(done, "check_id", "left")
        .withColumn("error_message", F.coalesce("request_error", "error_message"))
        .drop("request_error", "target_column", POSITIVE)
    )
    finished = results.where("error_message IS NULL").select("check_id", F.col("prediction_batch_id").alias("batch_id"))
    of_check = finished.select("check_id")
    per_batch = _class_details(counted, metrics.select(F.col("prediction_batch_id").alias("batch_id"), "fully_labeled"))
    return CheckRun(
        results,
        drift.drop("missing_n", "error").join(of_check, "check_id", "left_semi"),
        checks.join(of_check, "check_id", "left_semi")
        .drop("target_column")
        .join(category_shares(words, worded, of_words), of_pair)
        .drop(*of_pair),
        finished.join(per_batch, "batch_id").drop("batch_id"),
        finished.join(confusion_counts(_label_counts(counted), ["batch_id"]), "batch_id").drop("batch_id"),
    )


def _labels(valid: DataFrame, predictions: DataFrame, low_confidence: float) -> tuple[DataFrame, DataFrame]:
    """Score counts and metrics of the checked batches."""
    batches = as_small_side(valid.groupBy(F.col("prediction_batch_id").alias("batch_id")).agg(F.max(POSITIVE).alias(POSITIVE)))
    rows = of_owners(predictions.select("batch_id", TRUE, PRED, CONF), ["batch_id"], batches, "inner")
    counted = score_counts(rows, ["batch_id"])
    return counted, _metrics(counted, ["batch_id"], low_confidence).withColumnRenamed("batch_id", "prediction_batch_id")


def _beside(spark: SparkSession, work: Callable[[], tuple]) -> Callable[[], tuple]:
    """Start jobs that do not depend on the following ones; the result waits for them."""
    pool = ThreadPoolExecutor(1)
    started = pool.submit(inheritable_thread_target(spark)(work))
    pool.shutdown(wait=False)
    return started.result


def _label_counts(counted: DataFrame) -> DataFrame:
    return counted.groupBy("batch_id", TRUE, PRED).agg(F.sum("n").alias("n"))


def _class_details(counted: DataFrame, labeled: DataFrame) -> DataFrame:
    """Support, shares and quality per batch and label; quality needs every true label."""
    totals = label_totals(_label_counts(counted), ["batch_id"])
    whole = totals.groupBy("batch_id").agg(F.sum("support").alias("true_n"), F.sum("predicted").alias("predicted_n"))
    rows = per_class_metrics(totals, ["batch_id"]).join(whole, "batch_id").join(labeled, "batch_id")
    known = F.col("fully_labeled")
    return rows.select(
        "batch_id",
        "label",
        "support",
        "predicted",
        F.when(known, F.col("support") / F.col("true_n")).alias("true_share"),
        (F.col("predicted") / F.col("predicted_n")).alias("predicted_share"),
        *[F.when(known, F.col(c)).alias(c) for c in ("precision", "recall", "f1")],
    )


def health_check_table(results: DataFrame, created_at: Column) -> DataFrame:
    """Successful results as rows of the ``health_checks`` registry."""
    ok = results.where("error_message IS NULL")
    return ok.select(
        F.col("check_id").alias("id"),
        "project_id",
        "model_version_id",
        "baseline_dataset_id",
        "prediction_batch_id",
        "status",
        "health_score",
        F.struct(*METRICS).alias("metrics"),
        F.struct(*DRIFT).alias("drift"),
        F.struct(*COMPONENTS).alias("component_scores"),
        "missing_rate",
        created_at.alias("created_at"),
    )


def detail_table(details: DataFrame, created_at: Column) -> DataFrame:
    """Rows of a detail table of ``CheckRun`` as they are stored."""
    return details.withColumnRenamed("check_id", "health_check_id").withColumn("created_at", created_at)


def diagnosis_report_table(results: DataFrame, created_at: Column) -> DataFrame:
    """Successful results as rows of the ``diagnosis_reports`` registry."""
    ok = results.where("error_message IS NULL")
    return ok.select(
        F.col("check_id").alias("id"),
        F.col("check_id").alias("health_check_id"),
        "summary",
        "risk_level",
        "retraining_recommended",
        "findings",
        "recommendations",
        created_at.alias("created_at"),
    )


def job_results(results: DataFrame) -> DataFrame:
    """Outcome of a bulk run: a status and a short result, or the error, per request."""
    ok = F.col("error_message").isNull()
    return results.select(
        "check_id",
        F.when(ok, "completed").otherwise("failed").alias("job_status"),
        F.when(ok, F.col("check_id")).alias("health_check_id"),
        F.when(ok, F.col("check_id")).alias("diagnosis_report_id"),
        "health_score",
        "status",
        "risk_level",
        "retraining_recommended",
        "error_message",
    )
