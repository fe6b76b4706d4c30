"""Training, splitting, weighting and logging of a classifier."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators.cumulative import join_on_groups
from tidewatch.operators.baseline import baseline_index
from tidewatch.plans import training
from tidewatch.plans.bulk import run_and_store
from tidewatch.plans.ingest import ingest_predictions, store_index
from tidewatch.plans.monitor import Monitor
from tidewatch.session import cut_lineage, shared_folder
from tidewatch.sources.files import list_files
from tidewatch.sources.tables import Store
from workload import query, r9, table
from workload.proxies import feature_map

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag"]


def _items(spark, sf_dir):
    """lineitem with a target that depends on quantity and discount."""
    risky = (F.col("l_quantity") > 30) & (F.col("l_discount") < 0.07) | (F.col("l_returnflag") == "R")
    return table(spark, sf_dir, "lineitem").select(*FEATURES, F.when(risky, 1).otherwise(0).alias("target"))


ITEMS = """
items AS (
  SELECT *, CASE WHEN (l_quantity > 30 AND l_discount < 0.07::DOUBLE) OR l_returnflag = 'R' THEN 1 ELSE 0 END AS target
  FROM lineitem)
"""

ALLOCATION = """
classes AS (SELECT label, count(*) AS n FROM source GROUP BY label),
quotas AS (SELECT label, n, ceil(sum(n) OVER () * 0.3::DOUBLE)::BIGINT AS test_total,
  n * ceil(sum(n) OVER () * 0.3::DOUBLE) / sum(n) OVER () AS quota FROM classes),
placed AS (SELECT *, row_number() OVER (ORDER BY quota - floor(quota) DESC, label) AS place,
  test_total - sum(floor(quota)) OVER () AS left_over FROM quotas)
SELECT label, n, (floor(quota) + CASE WHEN place <= left_over THEN 1 ELSE 0 END)::BIGINT AS test_n,
  (n - floor(quota) - CASE WHEN place <= left_over THEN 1 ELSE 0 END)::BIGINT AS train_n FROM placed
"""


def _split_sizes(split, target):
    return split.groupBy(F.col(target).alias("label")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("is_test").alias("test_n"),
        F.count_if(~F.col("is_test")).alias("train_n"),
    )


@query("stratified_split", f"WITH {ITEMS}, source AS (SELECT target AS label FROM items), {ALLOCATION}")
def stratified_split(spark, sf_dir):
    return _split_sizes(training.stratified_split(_items(spark, sf_dir), "target"), "target")


@query("stratified_split_many_copies", f"WITH source AS (SELECT event_type AS label FROM events), {ALLOCATION}")
def stratified_split_many_copies(spark, sf_dir):
    """Every class is one group of equal rows."""
    return _split_sizes(training.stratified_split(table(spark, sf_dir, "events").select("event_type"), "event_type"), "event_type")


@query(
    "balanced_weights",
    """SELECT l_returnflag AS label, count(*) AS n,
      round(sum(count(*)) OVER ()::DOUBLE / (count(*) OVER () * count(*)), 9) AS weight
    FROM lineitem GROUP BY l_returnflag""",
)
def balanced_weights(spark, sf_dir):
    return training.balanced_weights(table(spark, sf_dir, "lineitem"), "l_returnflag").select("label", "n", r9("weight"))


@query(
    "training_table_check",
    """SELECT 'l_linestatus' AS target, CASE WHEN count(DISTINCT l_linestatus) < 2
      THEN 'The target column must contain at least two classes.' ELSE '' END AS error FROM lineitem
    UNION ALL SELECT 'constant', 'The target column must contain at least two classes.'
    UNION ALL SELECT 'absent', 'Target column ''absent'' was not found.'""",
)
def training_table_check(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").withColumn("constant", F.lit("a"))
    parts = [
        training.training_table_errors(items, t).select(F.lit(t).alias("target"), F.coalesce("error", F.lit("")).alias("error"))
        for t in ("l_linestatus", "constant", "absent")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "train_forest",
    """SELECT ceil(count(*) * 0.3)::BIGINT AS logged, true AS accurate, true AS ranked, true AS confident, 2::BIGINT AS labels,
      count(*) - ceil(count(*) * 0.3)::BIGINT AS train_rows, 'random_forest' AS algorithm, true AS metrics_stored
    FROM lineitem""",
)
def train_forest(spark, sf_dir):
    """What holds for any good forest: sizes, floors of its measures, and its registered metadata."""
    store = Store(spark, shared_folder(spark, "models"))
    store.append("projects", spark.range(1, 2).select("id", F.lit("target").alias("target_column")))
    split = cut_lineage(training.stratified_split(_items(spark, sf_dir), "target"))
    train = split.where(~F.col("is_test")).drop("is_test")
    model = training.train_forest(train, "target")
    predictions = cut_lineage(model.predict(split.where("is_test").drop("is_test")))
    scores = cut_lineage(training.evaluate(predictions))
    version = training.model_metadata(model, scores, 1, "forest", "1", train.count())
    Monitor(store).register_model_versions(version, F.lit("2024-02-01").cast("timestamp"))
    stored = store.read("model_versions").select("algorithm", "metrics")
    log = training.prediction_log(predictions, F.lit("2024-02-01").cast("timestamp"))
    sizes = log.agg(
        F.count(F.lit(1)).alias("logged"),
        F.bool_and(F.col("confidence").between(0, 1)).alias("confident"),
        F.countDistinct("predicted_label").alias("labels"),
    )
    floors = scores.select((F.col("accuracy") > 0.8).alias("accurate"), (F.col("roc_auc") > 0.8).alias("ranked"), "accuracy")
    kept = stored.select("algorithm", F.col("metrics")["train_rows"].cast("bigint").alias("train_rows"), F.col("metrics")["accuracy"].alias("kept"))
    joined = join_on_groups(join_on_groups(sizes, floors, []), kept, [])
    return joined.select(
        "logged", "accurate", "ranked", "confident", "labels", "train_rows", "algorithm", (F.col("kept") == F.col("accuracy")).alias("metrics_stored")
    )


@query(
    "train_log_check",
    """SELECT ceil(count(*) * 0.3)::BIGINT AS logged, true AS labeled, true AS checked, 5::BIGINT AS features, true AS accurate
    FROM lineitem""",
)
def train_log_check(spark, sf_dir):
    """A model is trained, its log written as CSV, loaded like any other and checked against the training rows."""
    store, folder = Store(spark, shared_folder(spark, "trained")), shared_folder(spark, "log")
    at, one = F.lit("2024-02-01").cast("timestamp"), F.lit(1).cast("bigint")
    store.append("projects", spark.range(1, 2).select("id", F.lit("target").alias("target_column")))
    split = cut_lineage(training.stratified_split(_items(spark, sf_dir), "target"))
    train = split.where(~F.col("is_test")).drop("is_test")
    model = training.train_forest(train, "target", trees=10)
    predictions = cut_lineage(model.predict(split.where("is_test").drop("is_test")))
    version = training.model_metadata(model, training.evaluate(predictions), 1, "forest", "1", train.count())
    models = Monitor(store).register_model_versions(version, at).accepted.select(F.col("id").alias("model_version_id"))
    training.write_log(training.prediction_log(predictions, at), folder)
    files = list_files(spark, folder).where("file_error IS NULL").select("path", one.alias("project_id"))
    load = ingest_predictions(store, files.join(F.broadcast(models)), at, folder)
    rows = train.select(one.alias("dataset_id"), feature_map([*FEATURES, "target"]).alias("features"))
    store.append("datasets", spark.range(1, 2).select("id", one.alias("project_id"), one.alias("load_id")))
    store_index(store, baseline_index(rows), 1)
    requests = load.accepted.select(
        F.col("id").alias("check_id"), "project_id", "model_version_id", one.alias("baseline_dataset_id"), F.col("id").alias("prediction_batch_id")
    )
    run_and_store(store, requests, at)
    checks = store.read("health_checks")
    facts = checks.agg(
        F.bool_and(F.col("metrics.accuracy") > 0.8).alias("accurate"),
        F.max("drift.feature_count").alias("features"),
        F.count(F.lit(1)).alias("checks"),
    )
    batches = store.read("prediction_batches").agg(
        F.sum("row_count").alias("logged"), F.bool_and("is_labeled").alias("labeled"), F.count(F.lit(1)).alias("batches")
    )
    joined = join_on_groups(batches, facts, [])
    return joined.select("logged", "labeled", (F.col("checks") == F.col("batches")).alias("checked"), "features", "accurate")
