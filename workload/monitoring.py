"""Missing values, component scores, health score, diagnosis and whole health checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import scores
from tidewatch.operators import health, missing
from tidewatch.operators.baseline import baseline_index
from tidewatch.plans import health_check as plans
from tidewatch.plans.bulk import run_stored
from tidewatch.plans.ingest import store_index
from tidewatch.session import shared_folder
from tidewatch.sources.tables import Store
from workload import query, r9, table
from workload.drift import ITEM_REF, SHIFTED, columns, drift_ctes, observed, summary_sql
from workload.metrics import auc_sql, class_ctes
from workload.proxies import BATCH_SQL, BINARY_LOG, FEATURES, SPLIT, batch_of, before, binary_log, feature_map

# --- SQL building blocks ------------------------------------------------------------------


def check_ctes(features: dict[str, tuple[str, str]], keys: str = "", source: str = "binary_log") -> str:
    """CTEs from ``source`` (a log with reference and current rows) to ``report``."""
    key_list = keys.rstrip(", ")
    group = f"GROUP BY {key_list}" if keys else ""

    def join(name: str) -> str:
        return f"JOIN {name} USING ({key_list})" if keys else f"CROSS JOIN {name}"

    nulls = " + ".join(f"(({e}) IS NULL)::INT" for e, _ in features.values())
    auc = auc_sql("dummy AS (SELECT 1)", "current_log", keys).split("dummy AS (SELECT 1),", 1)[1]
    auc_parts = auc.rsplit("SELECT " + keys + " round(", 1)
    return f"""
    current_log AS (SELECT *, {nulls} AS empty_cells FROM {source} WHERE NOT ({ITEM_REF})),
    {observed(source, ITEM_REF, features, keys)}, {drift_ctes(keys)},
    summary AS ({summary_sql(keys)}),
    {class_ctes("current_log", keys)},
    {auc_parts[0].rstrip()},
    auc AS (SELECT {keys} round({auc_parts[1]}),
    classes AS (
      SELECT {keys} arg_max(precision, label) AS precision, arg_max(recall, label) AS recall,
        arg_max(f1, label) AS f1, min(support) AS low, max(support) AS high FROM per_class {group}),
    whole AS (
      SELECT {keys} count(*) AS sample_count,
        avg(CASE WHEN true_label = predicted_label THEN 1::DOUBLE ELSE 0 END) AS accuracy,
        avg(confidence) AS average_confidence,
        avg(CASE WHEN confidence < 0.6::DOUBLE THEN 1::DOUBLE ELSE 0 END) AS low_confidence_rate,
        sum(empty_cells)::DOUBLE / (count(*) * {len(features)}) AS missing_rate
      FROM current_log {group}),
    components AS (
      SELECT *, round(f1 * 100, 2) AS performance_score,
        round(greatest(0, 100 * (1 - drift_rate)), 2) AS drift_score,
        round(100 * (1 - missing_rate), 2) AS data_quality_score,
        round(average_confidence * 100, 2) AS confidence_score,
        round(low / high * 100, 2) AS class_balance_score,
        low / sample_count AS minimum_share
      FROM whole {join("classes")} {join("summary")} {join("auc")}),
    scored AS (
      SELECT *, round(performance_score * 0.35::DOUBLE + drift_score * 0.25::DOUBLE + data_quality_score * 0.2::DOUBLE
          + confidence_score * 0.1::DOUBLE + class_balance_score * 0.1::DOUBLE, 2) AS health_score
      FROM components),
    rated AS (
      SELECT *, CASE WHEN health_score >= 90 THEN 'excellent' WHEN health_score >= 75 THEN 'good'
          WHEN health_score >= 60 THEN 'warning' WHEN health_score >= 40 THEN 'risky' ELSE 'critical' END AS status,
        f1 < 0.7 AS low_f1, drifted_feature_count > 0 AS drifted,
        list_filter([
          CASE WHEN f1 < 0.7 THEN 'LOW_F1' END,
          CASE WHEN drifted_feature_count > 0 THEN 'FEATURE_DRIFT' END,
          CASE WHEN average_confidence < 0.7 THEN 'LOW_CONFIDENCE' END,
          CASE WHEN low_confidence_rate > 0.2 THEN 'HIGH_LOW_CONFIDENCE_RATE' END,
          CASE WHEN missing_rate > 0.05 THEN 'MISSING_VALUES' END,
          CASE WHEN minimum_share < 0.2 THEN 'CLASS_IMBALANCE' END], lambda x: x IS NOT NULL) AS found
      FROM scored),
    judged AS (
      SELECT *, CASE WHEN len(found) = 0 THEN ['HEALTHY_MODEL'] ELSE found END AS codes,
        CASE WHEN health_score < 40 THEN 'critical' WHEN health_score < 60 THEN 'high'
          WHEN low_f1 OR drifted THEN 'high' WHEN health_score < 75 THEN 'medium' ELSE 'low' END AS risk_level
      FROM rated),
    report AS (
      SELECT *, risk_level IN ('high', 'critical') OR low_f1 OR drifted AS retraining_recommended,
        format('Model health score is {{:.2f}}/100 with status ''{{}}''. The diagnosis engine produced {{}} finding(s).',
          health_score, status, len(codes)) AS summary_text,
        array_to_string(codes, ', ') AS finding_codes
      FROM judged)
    """


REPORT_SQL = """sample_count, round(accuracy, 9) AS accuracy, round(precision, 9) AS precision,
  round(recall, 9) AS recall, round(f1, 9) AS f1, round(roc_auc, 9) AS roc_auc,
  round(average_confidence, 9) AS average_confidence, round(low_confidence_rate, 9) AS low_confidence_rate,
  round(missing_rate, 9) AS missing_rate, feature_count, drifted_feature_count, drifted_features,
  performance_score, drift_score, data_quality_score, confidence_score, class_balance_score,
  health_score, status, risk_level, retraining_recommended, finding_codes, summary_text"""
COMPONENT_SQL = "performance_score, drift_score, data_quality_score, confidence_score, class_balance_score"

BATCHED_LOG = BINARY_LOG + f", batched AS (SELECT *, {BATCH_SQL} AS batch FROM binary_log)"
PLAIN_CHECK = f"WITH {BINARY_LOG}, {check_ctes(columns(FEATURES))}"
SHIFTED_CHECK = f"WITH {BATCHED_LOG}, {check_ctes(SHIFTED, 'batch, ', 'batched')}"


def _sides(spark, sf_dir, columns, keys=()):
    log = binary_log(spark, sf_dir).withColumn("batch", batch_of())
    early = before("l_shipdate", SPLIT)
    labels = ["true_label", "predicted_label", "confidence"]
    return log.where(early).select(*keys, *columns), log.where(~early).select(*keys, *columns, *labels)


def _shifted_check(spark, sf_dir):
    """Checks per batch with a stretched discount, a lost category and missing cells."""
    reference, current = _sides(spark, sf_dir, list(SHIFTED), ["batch"])
    tax = F.nullif(F.col("l_tax"), F.lit(0.08))
    current = current.withColumns(
        {
            "l_tax": tax,
            "l_discount": F.col("l_discount") * 1.5,
            "l_returnflag": F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")),
        }
    )
    return plans.check_tables(reference.withColumn("l_tax", tax), current, ["batch"])


def _report(result, keys=()):
    return result.select(
        *keys,
        "sample_count",
        *[r9(c) for c in ("accuracy", "precision", "recall", "f1", "roc_auc")],
        *[r9(c) for c in ("average_confidence", "low_confidence_rate", "missing_rate")],
        "feature_count",
        "drifted_feature_count",
        F.array_join("drifted_features", ", ").alias("drifted_features"),
        *plans.COMPONENTS,
        "health_score",
        "status",
        "risk_level",
        "retraining_recommended",
        F.array_join(F.transform("findings", lambda f: f["code"]), ", ").alias("finding_codes"),
        F.col("summary").alias("summary_text"),
    )


# --- queries ------------------------------------------------------------------------------


@query("health_check", f"{PLAIN_CHECK} SELECT {REPORT_SQL} FROM report")
def health_check(spark, sf_dir):
    reference, current = _sides(spark, sf_dir, FEATURES)
    return _report(plans.check_tables(reference, current))


@query("health_check_by_batch", f"{SHIFTED_CHECK} SELECT batch, {REPORT_SQL} FROM report")
def health_check_by_batch(spark, sf_dir):
    return _report(_shifted_check(spark, sf_dir), ["batch"])


def stored_tables(spark, sf_dir, columns):
    """lineitem as stored tables: a project, model, dataset and batch for each of eight batches."""
    log = binary_log(spark, sf_dir).withColumn("part", batch_of())
    early = before("l_shipdate", SPLIT)
    features = feature_map(columns).alias("features")
    parts = log.select("part").distinct()
    return {
        "projects": parts.select(
            F.col("part").alias("id"), F.lit("unused").alias("target_column"), F.lit(None).cast("string").alias("positive_class")
        ),
        # Each project has a second model, which made no predictions.
        "model_versions": parts.select(F.explode(F.array(F.col("part") + 10, F.col("part") + 50)).alias("id"), F.col("part").alias("project_id")),
        "datasets": parts.select((F.col("part") + 20).alias("id"), F.col("part").alias("project_id")),
        "prediction_batches": parts.select(
            (F.col("part") + 30).alias("id"),
            F.col("part").alias("project_id"),
            (F.col("part") + 10).alias("model_version_id"),
        ),
        "baseline_rows": log.where(early).select((F.col("part") + 20).alias("dataset_id"), features),
        "predictions": log.where(~early).select(
            (F.col("part") + 30).alias("batch_id"), "true_label", "predicted_label", "confidence", features
        ),
    }


def _own_requests(tables):
    """A check of each batch against the baseline of its project."""
    part = F.col("id")
    return tables["projects"].select(
        part.alias("check_id"),
        part.alias("project_id"),
        (part + 10).alias("model_version_id"),
        (part + 20).alias("baseline_dataset_id"),
        (part + 30).alias("prediction_batch_id"),
    )


def _check_run(spark, sf_dir):
    tables = stored_tables(spark, sf_dir, FEATURES)
    return plans.run_checks(_own_requests(tables), **tables)


BATCH_DRIFT = f"WITH {BATCHED_LOG}, {observed('batched', ITEM_REF, columns(FEATURES), 'batch, ')}, {drift_ctes('batch, ')}"


@query(
    "check_features",
    f"""{BATCH_DRIFT} SELECT batch AS check_id, feature, round(psi, 9) AS psi, round(d, 9) AS ks_statistic,
      NULL::DOUBLE AS tvd FROM psi JOIN ks USING (batch, feature)
    UNION ALL SELECT batch, feature, NULL, NULL, round(tvd, 9) FROM tvd""",
)
def check_features(spark, sf_dir):
    """Per-feature drift of eight stored checks."""
    rows = _check_run(spark, sf_dir).features
    return rows.select("check_id", "feature", r9("psi"), r9("ks_statistic"), r9("tvd"))


@query(
    "check_categories",
    f"""{BATCH_DRIFT} SELECT batch AS check_id, feature, txt AS category, round(rs, 9) AS ref_share,
      round(cs, 9) AS cur_share, round(abs(cs - rs), 9) AS abs_difference FROM category""",
)
def check_categories(spark, sf_dir):
    """Both distributions of the categorical features of eight stored checks."""
    rows = _check_run(spark, sf_dir).categories
    return rows.select("check_id", "feature", "category", r9("ref_share"), r9("cur_share"), r9("abs_difference"))


@query(
    "check_classes",
    f"""WITH {BATCHED_LOG}, log AS (SELECT * FROM batched WHERE NOT ({ITEM_REF})),
    labels AS (SELECT batch, true_label AS label FROM log UNION SELECT batch, predicted_label FROM log),
    counted AS (
      SELECT b.batch, b.label, count(*) FILTER (l.true_label = b.label) AS support,
        count(*) FILTER (l.predicted_label = b.label) AS predicted,
        count(*) FILTER (l.true_label = b.label AND l.predicted_label = b.label) AS hits, count(*) AS n
      FROM labels b JOIN log l USING (batch) GROUP BY ALL)
    SELECT batch AS check_id, label, support, predicted, round(support / n, 9) AS true_share,
      round(predicted / n, 9) AS predicted_share, round(coalesce(hits / nullif(predicted, 0), 0), 9) AS precision,
      round(coalesce(hits / nullif(support, 0), 0), 9) AS recall,
      round(coalesce(2 * hits / nullif(support + predicted, 0), 0), 9) AS f1 FROM counted""",
)
def check_classes(spark, sf_dir):
    """Per-class measures and both class distributions of eight stored checks."""
    rows = _check_run(spark, sf_dir).classes
    shown = [r9(c) for c in ("true_share", "predicted_share", "precision", "recall", "f1")]
    return rows.select("check_id", "label", "support", "predicted", *shown)


@query(
    "check_confusion",
    f"""WITH {BATCHED_LOG} SELECT batch AS check_id, true_label, predicted_label, count(*) AS n
    FROM batched WHERE NOT ({ITEM_REF}) GROUP BY ALL""",
)
def check_confusion(spark, sf_dir):
    """Occupied confusion cells of eight stored checks."""
    return _check_run(spark, sf_dir).confusion


@query(
    "health_check_bulk",
    f"""WITH {BATCHED_LOG},
    {check_ctes(columns(FEATURES), 'batch, ', 'batched')}
    SELECT batch AS check_id, 'completed' AS job_status, health_score, status, risk_level,
      retraining_recommended::VARCHAR AS retraining_recommended, round(f1, 9) AS f1, round(roc_auc, 9) AS roc_auc, drifted_features, NULL::VARCHAR AS error_message FROM report
    UNION ALL
    SELECT DISTINCT batch + 100, 'failed', NULL, NULL, NULL, NULL, NULL, NULL, NULL, CASE batch % 4
        WHEN 0 THEN 'The selected model version does not belong to the selected project.'
        WHEN 1 THEN 'Dataset with ID 999 was not found.'
        WHEN 2 THEN 'The baseline dataset does not belong to the selected project.'
        ELSE 'The prediction batch does not belong to the selected project.' END FROM batched
    UNION ALL SELECT DISTINCT batch + 200, 'failed', NULL, NULL, NULL, NULL, NULL, NULL, NULL,
      'The prediction batch was not generated by the selected model version.' FROM batched""",
)
def health_check_bulk(spark, sf_dir):
    """Stored-form checks of eight batches, and as many requests that break one rule each."""
    tables = stored_tables(spark, sf_dir, FEATURES)
    good = _own_requests(tables)
    rule, other = F.col("project_id") % 4, (F.col("project_id") + 1) % 8
    bad = good.select(
        (F.col("check_id") + 100).alias("check_id"),
        "project_id",
        F.when(rule == 0, other + 10).otherwise(F.col("model_version_id")).alias("model_version_id"),
        F.when(rule == 1, 999).when(rule == 2, other + 20).otherwise(F.col("baseline_dataset_id")).alias("baseline_dataset_id"),
        F.when(rule == 3, other + 30).otherwise(F.col("prediction_batch_id")).alias("prediction_batch_id"),
    )
    unused = good.withColumns({"check_id": F.col("check_id") + 200, "model_version_id": F.col("project_id") + 50})
    results = plans.run_health_checks(good.unionByName(bad).unionByName(unused), **tables)
    outcome = plans.job_results(results).drop("health_check_id", "diagnosis_report_id")
    extra = results.select(
        "check_id", r9("f1"), r9("roc_auc"), F.array_join("drifted_features", ", ").alias("drifted_features")
    )
    advice = F.col("retraining_recommended").cast("string")
    return outcome.withColumn("retraining_recommended", advice).join(extra, "check_id")


# Early lines of all batches are one baseline; each of the eight batches is checked against it.
ONE_BASELINE = f"""{BATCHED_LOG}, shared AS (
  SELECT b.* EXCLUDE (batch), d.batch FROM batched b, (SELECT DISTINCT batch FROM batched) d WHERE {ITEM_REF}
  UNION ALL SELECT * EXCLUDE (batch), batch FROM batched WHERE NOT ({ITEM_REF}))"""


def _one_baseline(spark, sf_dir):
    """``stored_tables`` in one project with one model and one baseline, and a request per batch."""
    tables = stored_tables(spark, sf_dir, FEATURES)
    one = spark.range(1).select(F.lit(1).cast("bigint").alias("id"))
    owner = F.lit(1).cast("bigint").alias("project_id")
    tables["projects"] = one.select("id", F.lit("unused").alias("target_column"), F.lit(None).cast("string").alias("positive_class"))
    tables["model_versions"] = tables["datasets"] = one.select("id", owner)
    batches = tables["prediction_batches"].select("id", owner, F.lit(1).cast("bigint").alias("model_version_id"))
    tables["prediction_batches"] = batches
    tables["baseline_rows"] = tables["baseline_rows"].select(F.lit(1).cast("bigint").alias("dataset_id"), "features")
    requests = batches.select(
        (F.col("id") - 30).alias("check_id"),
        "project_id",
        "model_version_id",
        F.lit(1).cast("bigint").alias("baseline_dataset_id"),
        F.col("id").alias("prediction_batch_id"),
    )
    return requests, tables


@query(
    "health_check_shared_baseline",
    f"""WITH {ONE_BASELINE}, {check_ctes(columns(FEATURES), 'batch, ', 'shared')}
    SELECT batch AS check_id, {REPORT_SQL} FROM report""",
)
def health_check_shared_baseline(spark, sf_dir):
    """Eight batches against one baseline, whose rows are counted and sorted once."""
    requests, tables = _one_baseline(spark, sf_dir)
    return _report(plans.run_health_checks(requests, **tables), ["check_id"])


@query(
    "stored_baseline_index",
    f"""WITH {ONE_BASELINE}, {observed('shared', ITEM_REF, columns(FEATURES), 'batch, ')}, {drift_ctes('batch, ')}
    SELECT batch AS check_id, feature, round(psi, 9) AS psi, round(d, 9) AS ks_statistic, NULL::DOUBLE AS tvd
    FROM psi JOIN ks USING (batch, feature) UNION ALL SELECT batch, feature, NULL, NULL, round(tvd, 9) FROM tvd""",
)
def stored_baseline_index(spark, sf_dir):
    """The same checks from the index that a load keeps of its baseline, without the baseline's rows."""
    requests, tables = _one_baseline(spark, sf_dir)
    store, at = Store(spark, shared_folder(spark, "indexed")), F.lit("2024-02-01").cast("timestamp")
    load = F.lit(1).cast("bigint").alias("load_id")
    for name in ("projects", "model_versions"):
        store.append(name, tables[name])
    store.append("datasets", tables["datasets"].select("*", load))
    store.append("prediction_batches", tables["prediction_batches"].select("*", load))
    store_index(store, baseline_index(tables["baseline_rows"]), 1)
    rows = tables["predictions"].select("*", F.lit(1).cast("bigint").alias("project_id"), load, F.monotonically_increasing_id().alias("row_id"))
    none = F.lit(None).cast("timestamp").alias("prediction_timestamp")
    store.replace_partitions("predictions", rows.select("*", none, at.alias("created_at")))
    found = run_stored(store, requests).features
    return found.select("check_id", "feature", r9("psi"), r9("ks_statistic"), r9("tvd"))


@query("component_scores", f"{SHIFTED_CHECK} SELECT batch, {COMPONENT_SQL} FROM report")
def component_scores(spark, sf_dir):
    return _shifted_check(spark, sf_dir).select("batch", *plans.COMPONENTS)


@query("health_score", f"{SHIFTED_CHECK} SELECT batch, health_score, status FROM report")
def health_score(spark, sf_dir):
    return _shifted_check(spark, sf_dir).select("batch", "health_score", "status")


@query(
    "health_status",
    """SELECT c_custkey, CASE WHEN c_acctbal / 100 >= 90 THEN 'excellent' WHEN c_acctbal / 100 >= 75 THEN 'good'
      WHEN c_acctbal / 100 >= 60 THEN 'warning' WHEN c_acctbal / 100 >= 40 THEN 'risky' ELSE 'critical' END AS status
    FROM customer""",
)
def health_status(spark, sf_dir):
    score = F.col("c_acctbal") / 100
    return table(spark, sf_dir, "customer").select("c_custkey", scores.health_status(score).alias("status"))


@query(
    "score_range_violations",
    """SELECT c_custkey, 'performance_score must be between 0 and 100.' AS error
    FROM customer WHERE c_acctbal / 100 < 0 OR c_acctbal / 100 > 100""",
)
def score_range_violations(spark, sf_dir):
    error = scores.score_error(F.col("c_acctbal") / 100, "performance_score")
    return table(spark, sf_dir, "customer").select("c_custkey", error.alias("error")).where("error IS NOT NULL")


@query(
    "diagnosis",
    f"{SHIFTED_CHECK} SELECT batch, risk_level, retraining_recommended, finding_codes, summary_text FROM report",
)
def diagnosis(spark, sf_dir):
    report = _report(_shifted_check(spark, sf_dir), ["batch"])
    return report.select("batch", "risk_level", "retraining_recommended", "finding_codes", "summary_text")


# The diagnosis rules on many rows: every supplier is read as one check.
SUPPLIER_CHECKS = """
checks AS (
  SELECT l_suppkey AS check_id, avg(l_discount) * 14 AS f1, avg(l_tax) * 18 AS average_confidence,
    avg(CASE WHEN l_discount < 0.02 THEN 1::DOUBLE ELSE 0 END) AS low_confidence_rate,
    avg(CASE WHEN l_tax > 0.07 THEN 1::DOUBLE ELSE 0 END) / 2 AS missing_rate,
    avg(CASE WHEN l_returnflag = 'A' THEN 1::DOUBLE ELSE 0 END) / 1.65 AS minimum_share,
    round(avg(l_quantity) * 2.6, 2) AS health_score, min(l_linenumber) > 1 AS drifted
  FROM lineitem GROUP BY l_suppkey)
"""


def _supplier_checks(spark, sf_dir):
    def share(condition):
        return F.avg(F.when(condition, 1.0).otherwise(0.0))

    drifted = F.when(F.min("l_linenumber") > 1, F.array(F.lit("l_tax"), F.lit("l_discount")))
    checks = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_suppkey").alias("check_id"))
        .agg(
            (F.avg("l_discount") * 14).alias("f1"),
            (F.avg("l_tax") * 18).alias("average_confidence"),
            share(F.col("l_discount") < 0.02).alias("low_confidence_rate"),
            (share(F.col("l_tax") > 0.07) / 2).alias("missing_rate"),
            (share(F.col("l_returnflag") == "A") / 1.65).alias("minimum_share"),
            F.round(F.avg("l_quantity") * 2.6, 2).alias("health_score"),
            drifted.alias("drifted_features"),
        )
    )
    return health.diagnosis(checks.withColumn("status", scores.health_status(F.col("health_score"))))


@query(
    "diagnosis_findings",
    f"""WITH {SUPPLIER_CHECKS},
    found AS (
      SELECT check_id, unnest(list_filter([
        CASE WHEN f1 < 0.7 THEN 'LOW_F1' END,
        CASE WHEN drifted THEN 'FEATURE_DRIFT' END,
        CASE WHEN average_confidence < 0.7 THEN 'LOW_CONFIDENCE' END,
        CASE WHEN low_confidence_rate > 0.2 THEN 'HIGH_LOW_CONFIDENCE_RATE' END,
        CASE WHEN missing_rate > 0.05 THEN 'MISSING_VALUES' END,
        CASE WHEN minimum_share < 0.2 THEN 'CLASS_IMBALANCE' END,
        CASE WHEN NOT (f1 < 0.7 OR drifted OR average_confidence < 0.7 OR low_confidence_rate > 0.2
          OR missing_rate > 0.05 OR minimum_share < 0.2) THEN 'HEALTHY_MODEL' END], lambda x: x IS NOT NULL)) AS code
      FROM checks)
    SELECT check_id, code, CASE WHEN code IN ('LOW_F1', 'FEATURE_DRIFT') THEN 'high'
      WHEN code = 'HEALTHY_MODEL' THEN 'low' ELSE 'medium' END AS severity FROM found""",
)
def diagnosis_findings(spark, sf_dir):
    rows = health.finding_rows(_supplier_checks(spark, sf_dir), ["check_id"])
    return rows.select("check_id", "code", "severity")


@query(
    "risk_level",
    f"""WITH {SUPPLIER_CHECKS},
    levels AS (SELECT *, CASE WHEN health_score < 40 THEN 'critical' WHEN health_score < 60 THEN 'high'
      WHEN f1 < 0.7 OR drifted THEN 'high' WHEN health_score < 75 THEN 'medium' ELSE 'low' END AS risk_level FROM checks)
    SELECT check_id, health_score, risk_level,
      risk_level IN ('high', 'critical') OR f1 < 0.7 OR drifted AS retraining_recommended FROM levels""",
)
def risk_level(spark, sf_dir):
    return _supplier_checks(spark, sf_dir).select("check_id", "health_score", "risk_level", "retraining_recommended")


@query(
    "missing_by_column",
    """SELECT unnest(['l_quantity', 'l_tax', 'l_returnflag']) AS "column", unnest([
      count(*) FILTER (nullif(l_quantity, 7) IS NULL), count(*) FILTER (nullif(l_tax, 0.08::DOUBLE) IS NULL),
      count(*) FILTER (nullif(l_returnflag, 'N') IS NULL)]) AS missing FROM lineitem""",
)
def missing_by_column(spark, sf_dir):
    return missing.missing_by_column(_with_gaps(spark, sf_dir).drop("l_shipmonth"))


def _with_gaps(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        F.nullif(F.col("l_quantity"), F.lit(7.0)).alias("l_quantity"),
        F.nullif(F.col("l_tax"), F.lit(0.08)).alias("l_tax"),
        F.nullif(F.col("l_returnflag"), F.lit("N")).alias("l_returnflag"),
        F.date_format("l_shipdate", "yyyy-MM").alias("l_shipmonth"),
    )


@query(
    "missing_rate",
    """SELECT strftime(l_shipdate, '%Y-%m') AS l_shipmonth, round(
      sum((l_quantity = 7)::INT + (l_tax = 0.08::DOUBLE)::INT + (l_returnflag = 'N')::INT)::DOUBLE / (count(*) * 3), 9)
      AS missing_rate FROM lineitem GROUP BY ALL""",
)
def missing_rate(spark, sf_dir):
    rows = missing.missing_rate(_with_gaps(spark, sf_dir), ["l_quantity", "l_tax", "l_returnflag"], ["l_shipmonth"])
    return rows.select("l_shipmonth", r9("missing_rate"))


# --- request resolution -------------------------------------------------------------------

# Every third order names the next customer's project; orders without lines have no batch.
REQUESTS = """
requests AS (
  SELECT o_orderkey AS check_id, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey + 1 ELSE o_custkey END AS project_id,
    o_orderkey AS model_version_id, o_orderkey AS prediction_batch_id FROM orders),
judged AS (
  SELECT check_id, CASE
    WHEN c.c_custkey IS NULL THEN 'Project with ID ' || r.project_id || ' was not found.'
    WHEN b.l_orderkey IS NULL THEN 'Prediction batch with ID ' || r.prediction_batch_id || ' was not found.'
    WHEN o.o_custkey <> r.project_id THEN 'The selected model version does not belong to the selected project.'
    END AS request_error
  FROM requests r LEFT JOIN customer c ON c.c_custkey = r.project_id
  LEFT JOIN orders o ON o.o_orderkey = r.model_version_id
  LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem) b ON b.l_orderkey = r.prediction_batch_id)
"""


def _resolved(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    key, owner = F.col("o_orderkey"), F.col("o_custkey")
    requests = orders.select(
        key.alias("check_id"),
        F.when(key % 3 == 0, owner + 1).otherwise(owner).alias("project_id"),
        key.alias("model_version_id"),
        key.alias("baseline_dataset_id"),
        key.alias("prediction_batch_id"),
    )
    projects = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.lit("y").alias("target_column"), F.lit("1").alias("positive_class")
    )
    models = orders.select(key.alias("id"), owner.alias("project_id"))
    batches = (
        table(spark, sf_dir, "lineitem")
        .select(F.col("l_orderkey").alias("o_orderkey"))
        .distinct()
        .join(orders, "o_orderkey")
        .select(key.alias("id"), owner.alias("project_id"), key.alias("model_version_id"))
    )
    return plans.resolve_requests(requests, projects, models, models, batches)


@query("resolve_checks", f"WITH {REQUESTS} SELECT check_id, request_error FROM judged")
def resolve_checks(spark, sf_dir):
    return _resolved(spark, sf_dir).select("check_id", "request_error")


@query(
    "relationship_violations",
    f"WITH {REQUESTS} SELECT request_error, count(*) AS n FROM judged WHERE request_error LIKE 'The selected%' GROUP BY ALL",
)
def relationship_violations(spark, sf_dir):
    broken = _resolved(spark, sf_dir).where(F.col("request_error").startswith("The selected"))
    return broken.groupBy("request_error").agg(F.count(F.lit(1)).alias("n"))
