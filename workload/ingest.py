"""Reading logs, row checks, loading files, storing tables and the file stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators.validation import prediction_checks
from tidewatch.plans.bulk import run_and_store, run_stored
from tidewatch.plans.health_check import job_results
from tidewatch.plans.ingest import batch_metadata, ingest_datasets, ingest_predictions, prediction_rows
from tidewatch.session import shared_folder
from tidewatch.sources.files import list_files, plain_path, read_rows
from tidewatch.sources.tables import Store
from tidewatch.streaming.prediction_stream import stream_predictions
from workload import query, r9, table


def stamp():
    """The load time of every run."""
    return F.lit("2024-02-01 00:00:00").cast("timestamp")


# --- row checks ---------------------------------------------------------------------------


def _event_texts(spark, sf_dir):
    """Events as text cells of a log, some of them broken."""
    key, value = F.col("event_id"), F.col("value")
    iso = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    return table(spark, sf_dir, "events").select(
        "event_type",
        "event_id",
        F.when((key % 97 != 5) | (F.col("event_type") == "view"), F.col("event_type")).alias("predicted_label"),
        F.when(key % 50 == 0, F.lit(None))
        .when((key % 211 == 7) & (F.col("event_type") != "view"), "high")
        .otherwise((value / 30).cast("string"))
        .alias("confidence"),
        F.when(key % 40 == 0, F.lit(None)).when(key % 301 == 9, "not a date").otherwise(iso).alias("timestamp"),
    )


EVENT_TEXTS = """
texts AS (
  SELECT event_type, event_id,
    CASE WHEN event_id % 97 <> 5 OR event_type = 'view' THEN event_type END AS predicted_label,
    CASE WHEN event_id % 50 = 0 THEN NULL WHEN event_id % 211 = 7 AND event_type <> 'view' THEN 'high'
      ELSE (value / 30)::VARCHAR END AS confidence,
    CASE WHEN event_id % 40 = 0 THEN NULL WHEN event_id % 301 = 9 THEN 'not a date'
      ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS timestamp
  FROM events)
"""


def _checked(spark, sf_dir):
    return prediction_checks(_event_texts(spark, sf_dir), ["event_type"])


@query(
    "validate_required",
    f"""WITH {EVENT_TEXTS} SELECT event_type, count(*) AS row_count,
    count(*) FILTER (predicted_label IS NULL) AS missing_predictions FROM texts GROUP BY ALL""",
)
def validate_required(spark, sf_dir):
    return _checked(spark, sf_dir).select("event_type", "row_count", "missing_predictions")


@query(
    "validate_confidence",
    f"""WITH {EVENT_TEXTS} SELECT event_type,
    count(*) FILTER (confidence IS NOT NULL AND try_cast(confidence AS DOUBLE) IS NULL) AS non_numeric_confidences,
    count(*) FILTER (try_cast(confidence AS DOUBLE) NOT BETWEEN 0 AND 1) AS out_of_range_confidences
    FROM texts GROUP BY ALL""",
)
def validate_confidence(spark, sf_dir):
    return _checked(spark, sf_dir).select("event_type", "non_numeric_confidences", "out_of_range_confidences")


@query(
    "validate_timestamps",
    f"""WITH {EVENT_TEXTS} SELECT event_type,
    count(*) FILTER (timestamp IS NOT NULL AND try_cast(timestamp AS TIMESTAMP) IS NULL) AS invalid_timestamps,
    CASE WHEN count(*) FILTER (predicted_label IS NULL) > 0
        THEN 'The ''predicted_label'' column cannot contain missing values.'
      WHEN count(*) FILTER (confidence IS NOT NULL AND try_cast(confidence AS DOUBLE) IS NULL) > 0
        THEN 'Confidence values must be numeric.'
      WHEN count(*) FILTER (try_cast(confidence AS DOUBLE) NOT BETWEEN 0 AND 1) > 0
        THEN 'Confidence values must be between 0 and 1.'
      WHEN count(*) FILTER (timestamp IS NOT NULL AND try_cast(timestamp AS TIMESTAMP) IS NULL) > 0
        THEN 'One or more timestamp values are invalid.' END AS error
    FROM texts GROUP BY ALL""",
)
def validate_timestamps(spark, sf_dir):
    return _checked(spark, sf_dir).select("event_type", "invalid_timestamps", "error")


# --- prediction rows ----------------------------------------------------------------------


def _event_cells(spark, sf_dir):
    """Events as rows of a log file: a map from column name to text."""
    score = F.col("value") / 1000
    cells = {
        "timestamp": F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        "value": F.when(F.col("event_id") % 11 != 0, F.col("value").cast("string")),
        "k": F.get_json_object("props", "$.k"),
        "true_label": F.when(F.col("user_id") % 3 != 0, F.concat((F.col("event_id") % 2).cast("string"), F.lit(".0"))),
        "predicted_label": (F.col("event_id") % 2).cast("string"),
        "confidence": score.cast("string"),
    }
    pairs = [v for name, value in cells.items() for v in (F.lit(name), value)]
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.create_map(*pairs).alias("cells"))


@query(
    "build_predictions",
    """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp,
      CASE WHEN user_id % 3 <> 0 THEN (event_id % 2)::VARCHAR END AS true_label,
      (event_id % 2)::VARCHAR AS predicted_label, round(value / 1000, 9) AS confidence,
      'k,value' AS feature_names, props->>'$.k' AS k,
      round(CASE WHEN event_id % 11 <> 0 THEN value END, 9) AS value FROM events""",
)
def build_predictions(spark, sf_dir):
    rows = prediction_rows(_event_cells(spark, sf_dir))
    return rows.select(
        "event_id",
        F.date_format("prediction_timestamp", "yyyy-MM-dd HH:mm:ss").alias("stamp"),
        "true_label",
        "predicted_label",
        r9("confidence"),
        F.array_join(F.array_sort(F.map_keys("features")), ",").alias("feature_names"),
        F.col("features")["k"].alias("k"),
        r9(F.col("features")["value"], "value"),
    )


@query(
    "batch_metadata",
    "SELECT user_id, count(*) AS row_count, user_id % 3 <> 0 AS is_labeled FROM events GROUP BY user_id",
)
def batch_meta(spark, sf_dir):
    return batch_metadata(prediction_rows(_event_cells(spark, sf_dir)), ["user_id"])


# --- files --------------------------------------------------------------------------------


def _write_csv(rows, folder, by=None, rows_per_file=1_000_000):
    """Write logs as CSV files of a bounded size.

    Rows of a folder are brought together first: the number of files follows the size of the log,
    not the number of tasks that write.
    """
    rows = rows.hint("rebalance", by) if by else rows
    writer = rows.write.option("header", True).option("escape", '"').option("maxRecordsPerFile", rows_per_file)
    (writer.partitionBy(by) if by else writer).csv(folder)


def _listed_paths(spark, folder):
    """Paths of the CSV files under a folder, as a table."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv")
    return files.load(folder).select(plain_path(F.col("path")).alias("path"))


@query(
    "csv_roundtrip",
    """SELECT doc_id, sha256(text) AS text_hash, lang, source, n_chars FROM documents""",
)
def csv_roundtrip(spark, sf_dir):
    """Whole documents, line breaks and quotes included, written as CSV and read back.

    Files are read in ranges of 64 KiB, each by a task of its own.
    """
    folder, size = shared_folder(spark, "documents"), 1 << 16
    _write_csv(table(spark, sf_dir, "documents"), folder, rows_per_file=1_000_000)
    cell = F.col("cells")
    rows = read_rows(spark, list_files(spark, folder, size=size), folder, size=size)
    return rows.select(
        cell["doc_id"].cast("bigint").alias("doc_id"),
        F.sha2(cell["text"], 256).alias("text_hash"),
        cell["lang"].alias("lang"),
        cell["source"].alias("source"),
        cell["n_chars"].cast("bigint").alias("n_chars"),
    )


def project_of(event_type):
    """A project of its own for each event type."""
    return F.crc32(event_type.cast("binary"))


def _registry_store(spark, sf_dir):
    """A store with one project and one model per event type."""
    store = Store(spark, shared_folder(spark, "store"))
    types = table(spark, sf_dir, "events").select("event_type").distinct()
    projects = types.select(project_of(F.col("event_type")).alias("id"))
    store.append(
        "projects", projects.withColumns({"target_column": F.lit("outcome"), "positive_class": F.lit("1")})
    )
    store.append("model_versions", projects.select((F.col("id") + 100).alias("id"), F.col("id").alias("project_id")))
    return store


def _event_logs(spark, sf_dir):
    """Events as logs: half the labels are wrong for large values."""
    events = table(spark, sf_dir, "events")
    label = (F.col("event_id") % 2).cast("string")
    wrong = F.col("value") > 30
    return events.select(
        "event_type",
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
        F.col("value").alias("amount"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        label.alias("true_label"),
        F.when(wrong, F.lit("1")).otherwise(label).alias("predicted_label"),
        (F.lit(1) / (1 + F.col("value") / 100)).alias("confidence"),
    )


def _event_baselines(spark, sf_dir):
    """Events as training tables with the target ``outcome``."""
    return table(spark, sf_dir, "events").select(
        "event_type",
        F.col("value").alias("amount"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        (F.col("event_id") % 2).cast("string").alias("outcome"),
    )


def _routed(paths):
    """Project and model of a file from its folder name."""
    kind = F.regexp_extract("path", "event_type=([^/]+)", 1)
    project = project_of(kind)
    return paths.select("path", project.alias("project_id"), (project + 100).alias("model_version_id"))


@query(
    "ingest_predictions",
    """SELECT event_type, count(*) AS row_count, true AS is_labeled, 'processed' AS status, true AS refused_again
    FROM events GROUP BY event_type""",
)
def load_predictions(spark, sf_dir):
    """Logs per event type are loaded, then offered again and refused."""
    store, folder = _registry_store(spark, sf_dir), shared_folder(spark, "logs")
    _write_csv(_event_logs(spark, sf_dir), folder, "event_type")
    uploads = _routed(_listed_paths(spark, folder))
    ingest_predictions(store, uploads, stamp(), folder)
    again = ingest_predictions(store, uploads, stamp(), folder)
    kind = F.regexp_extract("path", "event_type=([^/]+)", 1).alias("event_type")
    stored = store.read("predictions").join(
        store.read("prediction_batches").select(F.col("id").alias("batch_id"), "content_hash", "is_labeled", "status"),
        "batch_id",
    )
    named = stored.join(
        list_files(spark, folder).select("path", "content_hash"), "content_hash"
    ).groupBy(kind).agg(
        F.count(F.lit(1)).alias("row_count"), F.bool_and("is_labeled").alias("is_labeled"), F.max("status").alias("status")
    )
    refused = again.rejected.groupBy(kind).agg(F.bool_and(F.col("error").contains("already")).alias("refused_again"))
    return named.join(refused, "event_type")


@query(
    "ingest_datasets",
    """SELECT event_type, count(*) AS row_count, 3::BIGINT AS column_count,
      sha256('amount:float64|k:int64|outcome:int64') AS schema_hash,
      count(*) FILTER (event_id % 2 = 1) AS class_1, round(sum(value), 4) AS amount_total
    FROM events GROUP BY event_type""",
)
def load_datasets(spark, sf_dir):
    """Training tables per event type, with profiles; the file name is the version."""
    store, folder = _registry_store(spark, sf_dir), shared_folder(spark, "baselines")
    _write_csv(_event_baselines(spark, sf_dir), folder, "event_type")
    kind = F.regexp_extract("path", "event_type=([^/]+)", 1)
    uploads = _listed_paths(spark, folder).select(
        "path",
        project_of(kind).alias("project_id"),
        F.lit("training").alias("dataset_type"),
        F.concat_ws("-", kind, F.element_at(F.split("path", "/"), -1)).alias("version"),
    )
    ingest_datasets(store, uploads, stamp(), folder)
    amount = F.col("numeric_summary")["amount"]
    classes = store.read("dataset_classes").where("class = '1'").select("dataset_id", F.col("n").alias("class_1"))
    return (
        store.read("datasets")
        .join(store.read("dataset_profiles").withColumnRenamed("dataset_id", "id").drop("created_at"), "id")
        .join(classes.withColumnRenamed("dataset_id", "id"), "id")
        .groupBy(F.regexp_extract("version", "^[^-]+", 0).alias("event_type"))
        .agg(
            F.sum("row_count").alias("row_count"),
            F.max("column_count").alias("column_count"),
            F.max("schema_hash").alias("schema_hash"),
            F.sum("class_1").alias("class_1"),
            F.round(F.sum(amount["count"] * amount["mean"]), 4).alias("amount_total"),
        )
    )


@query(
    "parquet_sink",
    """SELECT o_custkey % 4 AS project_id, count(*) AS rows, round(avg(o_totalprice), 6) AS mean_price
    FROM orders GROUP BY ALL""",
)
def parquet_sink(spark, sf_dir):
    """Rows are stored by project and load; writing them twice leaves one copy."""
    store = Store(spark, shared_folder(spark, "sink"))
    rows = table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 4).alias("project_id"),
        (F.col("o_custkey") % 8).alias("load_id"),
        (F.col("o_custkey") % 16).alias("batch_id"),
        F.col("o_orderkey").alias("row_id"),
        F.col("o_orderstatus").alias("predicted_label"),
        F.create_map(F.lit("price"), F.col("o_totalprice").cast("string")).alias("features"),
        F.lit(None).cast("timestamp").alias("prediction_timestamp"),
        F.lit(None).cast("string").alias("true_label"),
        F.lit(None).cast("double").alias("confidence"),
        stamp().alias("created_at"),
    )
    store.replace_partitions("predictions", rows)
    store.replace_partitions("predictions", rows)
    price = F.col("features")["price"].cast("double")
    return store.read("predictions").groupBy("project_id").agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.avg(price), 6).alias("mean_price")
    )


# --- stream -------------------------------------------------------------------------------


def _store_with_baselines(spark, sf_dir):
    """A store whose projects have their events as baseline rows."""
    store = _registry_store(spark, sf_dir)
    project = project_of(F.col("event_type"))
    features = F.create_map(
        F.lit("amount"), F.col("amount").cast("string"), F.lit("k"), F.col("k").cast("string"), F.lit("outcome"), F.col("outcome")
    )
    rows = _event_baselines(spark, sf_dir).select(
        project.alias("project_id"),
        F.lit(1).cast("long").alias("load_id"),
        (project + 200).alias("dataset_id"),
        F.monotonically_increasing_id().alias("row_id"),
        features.alias("features"),
    )
    store.replace_partitions("dataset_rows", rows)
    store.append("datasets", rows.select(F.col("dataset_id").alias("id"), "project_id", "load_id").distinct())
    return store


def _requests(batches):
    """One check per batch against the baseline of its project."""
    return batches.select(
        F.col("id").alias("check_id"),
        "project_id",
        "model_version_id",
        (F.col("project_id") + 200).alias("baseline_dataset_id"),
        F.col("id").alias("prediction_batch_id"),
    )


@query(
    "stream_equals_batch",
    "SELECT event_type, true AS equal, 2::BIGINT AS feature_rows FROM events GROUP BY event_type",
)
def stream_equals_batch(spark, sf_dir):
    """Logs arrive as a file stream; every check must equal the batch run over the same files."""
    folder = shared_folder(spark, "stream")
    _write_csv(_event_logs(spark, sf_dir), folder, "event_type")
    streamed = _store_with_baselines(spark, sf_dir)
    stream = stream_predictions(
        streamed, f"{folder}/*", shared_folder(spark, "progress"), _routed, _requests, stamp, files_per_batch=3
    )
    stream.awaitTermination()
    batch = _store_with_baselines(spark, sf_dir)
    load = ingest_predictions(batch, _routed(_listed_paths(spark, folder)), stamp(), folder)
    outcome = job_results(run_stored(batch, _requests(load.accepted)).results)
    shown = ["health_score", "status", "risk_level", "retraining_recommended"]
    from_stream = streamed.read("health_checks").join(
        streamed.read("diagnosis_reports").select("health_check_id", "risk_level", "retraining_recommended"),
        F.col("id") == F.col("health_check_id"),
    )
    left = from_stream.select("id", F.struct(*shown).alias("streamed"))
    right = outcome.select(F.col("check_id").alias("id"), F.struct(*shown).alias("batched"))
    both = left.join(right, "id", "full").select("id", F.col("streamed").eqNullSafe(F.col("batched")).alias("equal"))
    owners = streamed.read("prediction_batches").select("id", "project_id")
    details = streamed.read("check_features").groupBy(F.col("health_check_id").alias("id")).agg(F.count(F.lit(1)).alias("feature_rows"))
    names = table(spark, sf_dir, "events").select("event_type", project_of(F.col("event_type")).alias("project_id")).distinct()
    return both.join(owners, "id", "left").join(details, "id", "left").join(names, "project_id", "left").groupBy("event_type").agg(
        F.bool_and("equal").alias("equal"), F.max("feature_rows").alias("feature_rows")
    )


@query(
    "bulk_check_jobs",
    """SELECT event_type, status, error_message
    FROM (SELECT DISTINCT event_type FROM events),
      (VALUES ('completed', NULL), ('failed', 'Prediction batch with ID -1 was not found.')) AS s(status, error_message)""",
)
def bulk_check_jobs(spark, sf_dir):
    """Loaded logs are checked in one run; job events end in completed or failed."""
    from tidewatch.operators.jobs import job_states

    store, folder = _store_with_baselines(spark, sf_dir), shared_folder(spark, "logs")
    _write_csv(_event_logs(spark, sf_dir), folder, "event_type")
    load = ingest_predictions(store, _routed(_listed_paths(spark, folder)), stamp(), folder)
    requests = _requests(load.accepted)
    broken = requests.select((F.col("check_id") + 1).alias("check_id"), *requests.columns[1:4], F.lit(-1).cast("long").alias("prediction_batch_id"))
    run_and_store(store, requests.unionByName(broken), stamp())
    jobs = store.read("job_events").groupBy("job_id").agg(F.max("project_id").alias("project_id"))
    names = table(spark, sf_dir, "events").select("event_type", project_of(F.col("event_type")).alias("project_id")).distinct()
    states = job_states(store.read("job_events")).join(jobs, "job_id").join(names, "project_id")
    return states.select("event_type", "status", "error_message").distinct()
