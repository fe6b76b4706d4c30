"""Loading datasets and prediction logs: validate, fingerprint, refuse copies, store.

A load takes any number of files. Refused files become rows with the first rule they break;
the others are stored. Ids are hashes of identities, so repeating a load that was lost half-way
writes the same ids into the same folders. Rows count as stored once their batch is listed
with the load that holds them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.text import label_text, to_number
from tidewatch.operators.baseline import BaselineIndex, baseline_index
from tidewatch.operators.profile import class_counts, map_cells, profile_cells, profile_maps, schema_fingerprint
from tidewatch.operators.validation import parsed_timestamp, prediction_checks
from tidewatch.plans.health_check import RESERVED_COLUMNS
from tidewatch.session import as_small_side, cut_lineage
from tidewatch.sources.files import (
    EMPTY_FILE,
    NO_ROWS,
    ONLY_CSV,
    UNREADABLE,
    file_ranges,
    list_files,
    plain_path,
    read_rows,
)
from tidewatch.sources.tables import DATASET_TYPES, Store

# Messages of the load rules.
NO_PREDICTION_COLUMN = "Required column 'predicted_label' is missing."
KNOWN_LOG = "This prediction file has already been uploaded for the selected model version."
NO_PROJECT = "Project with ID %s was not found."
NO_MODEL = "Model version with ID %s was not found."
FOREIGN_MODEL = "Model version %s does not belong to project %s."
KNOWN_DATASET = "Dataset type '%s' version '%s' already exists in project %s."
NO_TARGET = "Target column '%s' was not found in the CSV."
UNKNOWN_TYPE = "Unknown dataset type."
PROCESSED = "processed"


@dataclass
class Load:
    """What a load stored and what it refused."""

    accepted: DataFrame
    rejected: DataFrame
    #: Ids of stored batches that refused uploads repeat.
    known: DataFrame | None = None


def _manifest(spark: SparkSession, uploads: DataFrame, files: str | list[str], max_bytes: int | None) -> DataFrame:
    """Uploads with the facts of their files, met by path."""
    uploads = uploads.withColumn("path", plain_path(F.col("path")))
    listed = uploads.join(list_files(spark, files, max_bytes), "path", "left")
    # A file without content is not listed.
    name = F.coalesce("file_name", F.element_at(F.split("path", "/"), -1))
    unlisted = F.when(F.col("bytes").isNull(), F.when(F.lower(name).endswith(".csv"), EMPTY_FILE).otherwise(ONLY_CSV))
    return listed.withColumns({"file_name": name, "file_error": F.coalesce("file_error", unlisted)})


def _load_id(accepted: DataFrame) -> int:
    """The identity of a load: a hash of the set it stores, the same when it is repeated."""
    return accepted.agg(F.coalesce(F.bit_xor(F.xxhash64("id")), F.lit(0).cast("long"))).first()[0]


def store_index(store: Store, index: BaselineIndex, load_id: int) -> None:
    """Keep the index of a load's datasets beside their rows; a repeat overwrites it."""
    load = F.lit(load_id).alias("load_id")
    store.replace_buckets("baseline_slices", index.slices, load_id)
    store.replace_partitions("baseline_categories", index.categories.select("*", load))
    store.replace_partitions("baseline_features", index.features.select("*", load))


def _store_raw(
    store: Store, accepted: DataFrame, stored: DataFrame, load_id: int, at: Column, files: str | list[str], max_bytes: int | None
) -> None:
    """Keep the bytes of accepted files under their stored name, in numbered ranges of bounded size."""
    wanted = as_small_side(accepted.select("path", "id", "content_hash").join(stored.select("id", "file_path"), "id"))
    project = F.split_part("file_path", F.lit("/"), F.lit(2)).cast("bigint").alias("project_id")
    ranges = file_ranges(store.spark, files, max_bytes).join(wanted, "path")
    load = F.lit(load_id).alias("load_id")
    kept = ranges.select(project, load, "file_path", "content_hash", "number", "content", at.alias("stored_at"))
    store.replace_partitions("raw_files", kept)


def prediction_rows(rows: DataFrame, features: Column | None = None) -> DataFrame:
    """Typed prediction rows from maps of text cells: reserved columns out, the rest features."""
    cell = F.col("cells")
    others = F.map_filter(cell, lambda name, _: ~name.isin(RESERVED_COLUMNS))
    kept = [c for c in rows.columns if c not in ("cells", "malformed")]
    return rows.select(
        *kept,
        parsed_timestamp(cell["timestamp"]).alias("prediction_timestamp"),
        label_text(cell["true_label"]).alias("true_label"),
        label_text(cell["predicted_label"]).alias("predicted_label"),
        to_number(cell["confidence"]).alias("confidence"),
        (others if features is None else features).alias("features"),
    )


def batch_metadata(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Row count and label flag per batch: labeled as soon as one true label is present."""
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("row_count"), F.bool_or(F.col("true_label").isNotNull()).alias("is_labeled")
    )


def ingest_predictions(
    store: Store, uploads: DataFrame, uploaded_at: Column, files: str | list[str], max_bytes: int | None = None
) -> Load:
    """Load prediction logs: ``uploads`` has path, project_id and model_version_id.

    ``files`` is the folder or glob that holds the uploads, or a list of paths that the caller
    bounds; rows of other files in it are parsed and dropped.
    """
    spark = store.spark
    projects = store.read("projects").select(F.col("id").alias("project_id"), F.lit(True).alias("has_project"))
    models = store.read("model_versions").select(
        F.col("id").alias("model_version_id"), F.col("project_id").alias("model_project")
    )
    manifest = cut_lineage(_manifest(spark, uploads, files, max_bytes))
    rows = read_rows(spark, manifest, files, max_bytes)
    cell = F.col("cells")
    shape = prediction_checks(
        rows.select(
            "path",
            "malformed",
            "cells",
            cell["predicted_label"].alias("predicted_label"),
            cell["confidence"].alias("confidence"),
            cell["timestamp"].alias("timestamp"),
        ),
        ["path"],
        F.bool_or("malformed").alias("malformed"),
        F.bool_and(F.map_contains_key("cells", "predicted_label")).alias("has_prediction"),
        F.bool_or(cell["true_label"].isNotNull()).alias("is_labeled"),
    ).withColumnRenamed("error", "row_error")
    identity = ["project_id", "model_version_id", "content_hash"]
    known = store.read("prediction_batches").select(*identity).distinct().withColumn("is_known", F.lit(True))
    state = (
        manifest.join(projects, "project_id", "left")
        .join(models, "model_version_id", "left")
        .join(shape, "path", "left")
        .join(known, identity, "left")
    )
    missing_project = F.format_string(NO_PROJECT, F.col("project_id").cast("string"))
    missing_model = F.format_string(NO_MODEL, F.col("model_version_id").cast("string"))
    mismatch = F.format_string(
        FOREIGN_MODEL,
        F.col("model_version_id").cast("string"),
        F.col("project_id").cast("string"),
    )
    own_error = (
        F.when(F.col("has_project").isNull(), missing_project)
        .when(F.col("model_project").isNull(), missing_model)
        .when(F.col("model_project") != F.col("project_id"), mismatch)
        .when(F.col("file_error").isNotNull(), F.col("file_error"))
        .when(F.col("malformed"), UNREADABLE)
        .when(F.col("row_count").isNull(), NO_ROWS)
        .when(~F.col("has_prediction"), NO_PREDICTION_COLUMN)
        .when(F.col("row_error").isNotNull(), F.col("row_error"))
        .when(F.col("is_known").isNotNull(), KNOWN_LOG)
    )
    judged = cut_lineage(state.withColumn("own_error", own_error))
    firsts = judged.where("own_error IS NULL").groupBy(*identity).agg(F.min("path").alias("first_path"))
    decided = cut_lineage(
        judged.join(firsts, identity, "left").withColumn(
            "error", F.when(F.col("own_error").isNotNull(), F.col("own_error")).when(F.col("path") != F.col("first_path"), KNOWN_LOG)
        )
    )
    accepted = decided.where("error IS NULL").withColumn("id", F.xxhash64(*identity))
    load_id = _load_id(accepted)
    stored_name = F.format_string(
        "model_%s_%s.csv", F.col("model_version_id").cast("string"), F.substring("content_hash", 1, 12)
    )
    batches = accepted.select(
        "id",
        "project_id",
        "model_version_id",
        "file_name",
        F.concat_ws("/", F.lit("prediction_logs"), F.col("project_id").cast("string"), stored_name).alias("file_path"),
        "content_hash",
        "row_count",
        "is_labeled",
        F.lit(PROCESSED).alias("status"),
        F.lit(None).cast("string").alias("error_message"),
        F.lit(load_id).alias("load_id"),
        uploaded_at.alias("uploaded_at"),
    )
    batches = cut_lineage(batches)
    typed = prediction_rows(
        rows.join(as_small_side(accepted.select("path", "project_id", F.col("id").alias("batch_id"))), "path")
    ).withColumns({"load_id": F.lit(load_id), "created_at": uploaded_at})
    # Rows first: a batch is listed only once all of its rows are stored.
    store.replace_partitions("predictions", typed)
    _store_raw(store, accepted, batches, load_id, uploaded_at, files, max_bytes)
    store.append("prediction_batches", batches)
    rejected = decided.where("error IS NOT NULL")
    repeated = rejected.where(F.col("error") == KNOWN_LOG).select(F.xxhash64(*identity).alias("id")).distinct()
    return Load(batches, rejected.select("path", "project_id", "model_version_id", "error"), repeated)


def ingest_datasets(
    store: Store, uploads: DataFrame, created_at: Column, files: str | list[str], max_bytes: int | None = None
) -> Load:
    """Load dataset files: ``uploads`` has path, project_id, dataset_type and version.

    ``files`` is as in ``ingest_predictions``.
    """
    spark = store.spark
    projects = store.read("projects").select(F.col("id").alias("project_id"), "target_column", F.lit(True).alias("has_project"))
    manifest = cut_lineage(_manifest(spark, uploads, files, max_bytes))
    rows = read_rows(spark, manifest, files, max_bytes)
    shape = rows.groupBy("path").agg(
        F.bool_or("malformed").alias("malformed"),
        F.max(F.map_keys("cells")).alias("columns"),
        F.count(F.lit(1)).alias("row_count"),
    )
    identity = ["project_id", "dataset_type", "version"]
    known = store.read("datasets").select(*identity).distinct().withColumn("is_known", F.lit(True))
    state = (
        manifest.join(projects, "project_id", "left").join(shape, "path", "left").join(known, identity, "left")
    )
    project_text = F.col("project_id").cast("string")
    exists = F.format_string(
        KNOWN_DATASET, "dataset_type", "version", project_text
    )
    own_error = (
        F.when(F.col("has_project").isNull(), F.format_string(NO_PROJECT, project_text))
        .when(~F.col("dataset_type").isin(DATASET_TYPES), UNKNOWN_TYPE)
        .when(F.col("is_known").isNotNull(), exists)
        .when(F.col("file_error").isNotNull(), F.col("file_error"))
        .when(F.col("malformed"), UNREADABLE)
        .when(F.col("row_count").isNull(), NO_ROWS)
        .when(
            ~F.array_contains("columns", F.col("target_column")),
            F.format_string(NO_TARGET, "target_column"),
        )
    )
    judged = cut_lineage(state.withColumn("own_error", own_error).withColumn("exists_error", exists))
    firsts = judged.where("own_error IS NULL").groupBy(*identity).agg(F.min("path").alias("first_path"))
    decided = cut_lineage(
        judged.join(firsts, identity, "left").withColumn(
            "error",
            F.when(F.col("own_error").isNotNull(), F.col("own_error")).when(
                F.col("path") != F.col("first_path"), F.col("exists_error")
            ),
        )
    )
    accepted = decided.where("error IS NULL").withColumn("id", F.xxhash64(*identity))
    load_id = _load_id(accepted)
    owners = accepted.select("path", "project_id", "target_column", F.col("id").alias("dataset_id"))
    owned = rows.join(as_small_side(owners), "path")
    profile = cut_lineage(profile_cells(map_cells(owned, "cells", ["dataset_id"]), ["dataset_id"]))
    hashes = schema_fingerprint(profile, ["dataset_id"]).withColumnRenamed("dataset_id", "id")
    stored_name = F.format_string("%s_%s_%s.csv", "dataset_type", "version", F.substring("content_hash", 1, 12))
    datasets = accepted.join(hashes, "id", "left").select(
        "id",
        *identity,
        "file_name",
        F.concat_ws("/", F.lit("datasets"), project_text, stored_name).alias("file_path"),
        "content_hash",
        "schema_hash",
        "row_count",
        F.size("columns").cast("long").alias("column_count"),
        F.lit(load_id).alias("load_id"),
        created_at.alias("created_at"),
    )
    datasets = cut_lineage(datasets)
    profiles = profile_maps(profile, ["dataset_id"]).withColumn("created_at", created_at)
    classes = class_counts(owned.withColumn("target", F.col("cells")[F.col("target_column")]), "target", ["dataset_id"])
    store.replace_partitions(
        "dataset_rows",
        owned.select("project_id", F.lit(load_id).alias("load_id"), "dataset_id", "row_id", F.col("cells").alias("features")),
    )
    store_index(store, baseline_index(owned.select("dataset_id", F.col("cells").alias("features"))), load_id)
    store.append("dataset_profiles", profiles)
    store.append("dataset_classes", classes)
    _store_raw(store, accepted, datasets, load_id, created_at, files, max_bytes)
    store.append("datasets", datasets)
    return Load(datasets, decided.where("error IS NOT NULL").select("path", *identity, "error"))
