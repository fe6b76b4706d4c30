"""Classification quality, confidence and class distribution."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import scores
from tidewatch.operators import metrics, ranking
from tidewatch.operators.profile import class_counts
from workload import query, r9, table
from workload.proxies import BINARY_LOG, MULTICLASS_LOG, binary_log, multiclass_log

QUALITY = ["accuracy", "precision", "recall", "f1", "error_rate"]
CONFIDENCE = ["average_confidence", "low_confidence_rate", "minimum_confidence", "maximum_confidence"]


def class_ctes(log: str, keys: str = "") -> str:
    """CTEs ``label_rows`` and ``per_class`` from a log; ``keys`` ends with a comma."""
    return f"""
    label_rows AS (
      SELECT {keys} true_label AS label, 1 AS support, 0 AS predicted,
             CASE WHEN true_label = predicted_label THEN 1 ELSE 0 END AS hits FROM {log}
      UNION ALL
      SELECT {keys} predicted_label, 0, 1, 0 FROM {log}),
    label_sums AS (
      SELECT {keys} label, sum(support)::DOUBLE AS support, sum(predicted)::DOUBLE AS predicted,
             sum(hits)::DOUBLE AS hits
      FROM label_rows WHERE label IS NOT NULL GROUP BY ALL),
    per_class AS (
      SELECT {keys} label, support, predicted,
        CASE WHEN predicted > 0 THEN hits / predicted ELSE 0 END AS precision,
        CASE WHEN support > 0 THEN hits / support ELSE 0 END AS recall,
        CASE WHEN support + predicted > 0 THEN 2 * hits / (support + predicted) ELSE 0 END AS f1
      FROM label_sums)
    """


def bundle_sql(ctes: str, log: str, keys: str = "") -> str:
    """Metrics of a fully labeled log with complete confidences."""
    group = f"GROUP BY {keys.rstrip(', ')}" if keys else ""
    join = f"JOIN classes USING ({keys.rstrip(', ')})" if keys else "CROSS JOIN classes"
    return f"""
    WITH {ctes}, {class_ctes(log, keys)},
    classes AS (
      SELECT {keys} count(*) AS label_count, max(label) AS last_label,
        arg_max(precision, label) AS p1, arg_max(recall, label) AS r1, arg_max(f1, label) AS f1_1,
        sum(precision * support) / sum(support) AS pw, sum(recall * support) / sum(support) AS rw,
        sum(f1 * support) / sum(support) AS fw
      FROM per_class {group}),
    whole AS (
      SELECT {keys} count(*) AS sample_count,
        avg(CASE WHEN true_label = predicted_label THEN 1.0::DOUBLE ELSE 0 END) AS accuracy,
        avg(confidence) AS average_confidence,
        avg(CASE WHEN confidence < 0.6::DOUBLE THEN 1.0::DOUBLE ELSE 0 END) AS low_confidence_rate,
        min(confidence) AS minimum_confidence, max(confidence) AS maximum_confidence
      FROM {log} {group})
    SELECT {keys} sample_count, label_count,
      CASE WHEN label_count = 2 THEN last_label END AS positive_label,
      round(accuracy, 9) AS accuracy,
      round(CASE WHEN label_count = 2 THEN p1 ELSE pw END, 9) AS precision,
      round(CASE WHEN label_count = 2 THEN r1 ELSE rw END, 9) AS recall,
      round(CASE WHEN label_count = 2 THEN f1_1 ELSE fw END, 9) AS f1,
      round(1 - accuracy, 9) AS error_rate,
      round(average_confidence, 9) AS average_confidence,
      round(low_confidence_rate, 9) AS low_confidence_rate,
      round(minimum_confidence, 9) AS minimum_confidence,
      round(maximum_confidence, 9) AS maximum_confidence
    FROM whole {join}
    """


def _bundle(df, keys=()):
    result = metrics.classification_metrics(df, list(keys))
    shown = [r9(c) for c in [*QUALITY, *CONFIDENCE]]
    return result.select(*keys, "sample_count", "label_count", "positive_label", *shown)


@query("metrics_binary", bundle_sql(BINARY_LOG, "binary_log"))
def metrics_binary(spark, sf_dir):
    return _bundle(binary_log(spark, sf_dir))


@query("metrics_binary_by_batch", bundle_sql(BINARY_LOG, "binary_log", "batch_id, "))
def metrics_binary_by_batch(spark, sf_dir):
    return _bundle(binary_log(spark, sf_dir), ["batch_id"])


@query("metrics_multiclass", bundle_sql(MULTICLASS_LOG, "multiclass_log"))
def metrics_multiclass(spark, sf_dir):
    return _bundle(multiclass_log(spark, sf_dir))


@query("metrics_multiclass_by_batch", bundle_sql(MULTICLASS_LOG, "multiclass_log", "batch_id, "))
def metrics_multiclass_by_batch(spark, sf_dir):
    return _bundle(multiclass_log(spark, sf_dir), ["batch_id"])


DOCUMENT_LOG = """
document_log AS (
  SELECT lang, quality::VARCHAR AS true_label, CASE WHEN n_chars >= 800 THEN '1' ELSE '0' END AS predicted_label,
    1.0::DOUBLE / (1 + toxic) AS confidence
  FROM labels JOIN documents USING (doc_id))
"""


def _document_log(spark, sf_dir):
    joined = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    return joined.select(
        "lang",
        F.col("quality").cast("string").alias("true_label"),
        F.when(F.col("n_chars") >= 800, "1").otherwise("0").alias("predicted_label"),
        (F.lit(1.0) / (1 + F.col("toxic"))).alias("confidence"),
    )


@query("label_metrics", bundle_sql(DOCUMENT_LOG, "document_log"))
def label_metrics(spark, sf_dir):
    return _bundle(_document_log(spark, sf_dir))


@query(
    "confusion_counts",
    f"""WITH {MULTICLASS_LOG} SELECT batch_id, true_label, predicted_label, count(*) AS n
    FROM multiclass_log GROUP BY ALL""",
)
def confusion_counts(spark, sf_dir):
    counts = metrics.label_counts(multiclass_log(spark, sf_dir), ["batch_id"])
    return metrics.confusion_counts(counts, ["batch_id"])


@query(
    "confusion_matrix",
    f"""WITH {MULTICLASS_LOG},
    names AS (SELECT true_label AS label FROM multiclass_log UNION SELECT predicted_label FROM multiclass_log)
    SELECT a.label, string_agg(cells.n::VARCHAR, ',' ORDER BY b.label) AS counts
    FROM names a CROSS JOIN names b
    JOIN LATERAL (SELECT count(*) AS n FROM multiclass_log m
      WHERE m.true_label = a.label AND m.predicted_label = b.label) cells ON true
    GROUP BY a.label""",
)
def confusion_matrix(spark, sf_dir):
    dense = metrics.dense_confusion(metrics.label_counts(multiclass_log(spark, sf_dir)))
    return dense.select("label", F.array_join(F.col("counts").cast("array<string>"), ",").alias("counts"))


def per_class_sql(ctes: str, log: str, keys: str = "") -> str:
    return f"""WITH {ctes}, {class_ctes(log, keys)}
    SELECT {keys} label, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1,
      support::BIGINT AS support FROM per_class"""


def _per_class(df, keys=()):
    totals = metrics.label_totals(metrics.label_counts(df, list(keys)), list(keys))
    rows = metrics.per_class_metrics(totals, list(keys))
    return rows.select(*keys, "label", r9("precision"), r9("recall"), r9("f1"), "support")


@query("per_class_metrics", per_class_sql(MULTICLASS_LOG, "multiclass_log"))
def per_class_metrics(spark, sf_dir):
    return _per_class(multiclass_log(spark, sf_dir))


@query("per_class_metrics_by_batch", per_class_sql(BINARY_LOG, "binary_log", "batch_id, "))
def per_class_metrics_by_batch(spark, sf_dir):
    return _per_class(binary_log(spark, sf_dir), ["batch_id"])


def auc_sql(ctes: str, log: str, keys: str = "", positive: str = "'1'") -> str:
    part = f"PARTITION BY {keys.rstrip(', ')}" if keys else ""
    group = f"GROUP BY {keys.rstrip(', ')}" if keys else ""
    return f"""WITH {ctes},
    counted AS (
      SELECT {keys} confidence, count(*) FILTER (true_label = {positive})::DOUBLE AS pos,
        count(*) FILTER (true_label <> {positive})::DOUBLE AS neg
      FROM {log} GROUP BY ALL),
    ranked AS (
      SELECT *, sum(neg) OVER ({part} ORDER BY confidence ROWS UNBOUNDED PRECEDING) - neg AS below FROM counted)
    SELECT {keys} round(sum(pos * (below + neg / 2)) / nullif(sum(pos) * sum(neg), 0), 9) AS roc_auc
    FROM ranked {group}"""


@query("roc_auc", auc_sql(BINARY_LOG, "binary_log"))
def roc_auc(spark, sf_dir):
    return ranking.roc_auc(binary_log(spark, sf_dir)).select(r9("roc_auc"))


@query("roc_auc_by_batch", auc_sql(BINARY_LOG, "binary_log", "batch_id, "))
def roc_auc_by_batch(spark, sf_dir):
    return ranking.roc_auc(binary_log(spark, sf_dir), ["batch_id"]).select("batch_id", r9("roc_auc"))


PRICE_LOG = """
price_log AS (
  SELECT CASE WHEN l_linestatus = 'F' THEN '1' ELSE '0' END AS true_label,
    CASE WHEN l_quantity > 25 THEN '1' ELSE '0' END AS predicted_label,
    1 / (1 + l_extendedprice) AS confidence FROM lineitem)
"""


@query("roc_auc_continuous", auc_sql(PRICE_LOG, "price_log", positive="'0'"))
def roc_auc_continuous(spark, sf_dir):
    """A nearly unique score and a named positive class."""
    log = table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_linestatus") == "F", "1").otherwise("0").alias("true_label"),
        F.when(F.col("l_quantity") > 25, "1").otherwise("0").alias("predicted_label"),
        (F.lit(1) / (1 + F.col("l_extendedprice"))).alias("confidence"),
        F.lit("0").alias("positive_class"),
    )
    return ranking.roc_auc(log).select(r9("roc_auc"))


@query(
    "class_distribution",
    f"""WITH {MULTICLASS_LOG}
    SELECT batch_id, predicted_label AS label, count(*) AS n,
      round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY batch_id), 9) AS share
    FROM multiclass_log GROUP BY batch_id, predicted_label""",
)
def class_distribution(spark, sf_dir):
    totals = metrics.label_totals(metrics.label_counts(multiclass_log(spark, sf_dir), ["batch_id"]), ["batch_id"])
    return metrics.class_shares(totals, "predicted", ["batch_id"]).select("batch_id", "label", "n", r9("share"))


@query(
    "target_class_counts",
    """SELECT coalesce(nullif(label, 0)::VARCHAR, 'MISSING') AS class, count(*) AS n
    FROM embeddings GROUP BY ALL""",
)
def target_class_counts(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(F.nullif(F.col("label"), F.lit(0)).alias("label"))
    return class_counts(vectors, "label")


@query(
    "class_balance",
    """WITH counted AS (
      SELECT source, lang, count(*)::DOUBLE AS n FROM documents GROUP BY ALL)
    SELECT source, round(CASE WHEN count(*) = 1 THEN 0 ELSE min(n) / max(n) * 100 END, 9) AS class_balance
    FROM counted GROUP BY source""",
)
def class_balance(spark, sf_dir):
    log = table(spark, sf_dir, "documents").select("source", F.col("lang").alias("predicted_label"))
    bundle = metrics.classification_metrics(log, ["source"])
    balance = scores.class_balance_score(F.col("minimum_share"), F.col("maximum_share"), F.col("class_count"))
    return bundle.select("source", r9(balance, "class_balance"))


@query(
    "confidence_stats",
    f"""WITH {BINARY_LOG}
    SELECT model_id, count(*) AS sample_count, round(avg(confidence), 9) AS average_confidence,
      round(avg(CASE WHEN confidence < 0.6::DOUBLE THEN 1.0::DOUBLE ELSE 0 END), 9) AS low_confidence_rate,
      round(min(confidence), 9) AS minimum_confidence, round(max(confidence), 9) AS maximum_confidence
    FROM binary_log GROUP BY model_id""",
)
def confidence_stats(spark, sf_dir):
    bundle = metrics.classification_metrics(binary_log(spark, sf_dir), ["model_id"])
    return bundle.select("model_id", "sample_count", *[r9(c) for c in CONFIDENCE])


@query(
    "unlabeled_metrics",
    f"""WITH {BINARY_LOG},
    partial AS (
      SELECT batch_id, predicted_label,
        CASE WHEN batch_id % 2 = 0 OR l_linenumber > 1 THEN true_label END AS true_label,
        CASE WHEN batch_id % 4 = 3 AND l_tax = 0.08 THEN NULL ELSE confidence END AS confidence
      FROM binary_log),
    shares AS (
      SELECT batch_id, min(n) / sum(n) AS minimum_share, max(n) / sum(n) AS maximum_share
      FROM (SELECT batch_id, label, count(*)::DOUBLE AS n FROM (
          SELECT batch_id, CASE WHEN batch_id % 2 = 0 THEN true_label ELSE predicted_label END AS label FROM partial)
        GROUP BY ALL) GROUP BY batch_id)
    SELECT batch_id, count(*) AS sample_count, count(true_label) = count(*) AS fully_labeled,
      CASE WHEN count(true_label) = count(*)
        THEN round(avg(CASE WHEN true_label = predicted_label THEN 1.0::DOUBLE ELSE 0 END), 9) END AS accuracy,
      CASE WHEN count(confidence) = count(*) THEN round(avg(confidence), 9) END AS average_confidence,
      round(any_value(minimum_share), 9) AS minimum_share, round(any_value(maximum_share), 9) AS maximum_share
    FROM partial JOIN shares USING (batch_id) GROUP BY batch_id""",
)
def unlabeled_metrics(spark, sf_dir):
    """Odd batches lack some true labels, every fourth one some confidences."""
    log = binary_log(spark, sf_dir)
    labeled = (F.col("batch_id") % 2 == 0) | (F.col("l_linenumber") > 1)
    unscored = (F.col("batch_id") % 4 == 3) & (F.col("l_tax") == 0.08)
    partial = log.select(
        "batch_id",
        "predicted_label",
        F.when(labeled, F.col("true_label")).alias("true_label"),
        F.when(~unscored, F.col("confidence")).alias("confidence"),
    )
    bundle = metrics.classification_metrics(partial, ["batch_id"])
    shown = [r9(c) for c in ("accuracy", "average_confidence", "minimum_share", "maximum_share")]
    return bundle.select("batch_id", "sample_count", "fully_labeled", *shown)
