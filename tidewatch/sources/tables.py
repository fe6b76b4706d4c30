"""Schemas of the registry tables, and reading and writing them as partitioned parquet."""

from __future__ import annotations

import uuid
import zlib
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.session import as_small_side, cut_lineage

# Table schemas.
SCHEMAS = {
    "projects": (
        "id BIGINT, name STRING, description STRING, problem_type STRING, target_column STRING, "
        "positive_class STRING, metric_priority STRING, owner STRING, created_at TIMESTAMP, updated_at TIMESTAMP"
    ),
    "model_versions": (
        "id BIGINT, project_id BIGINT, name STRING, version STRING, algorithm STRING, framework STRING, "
        "metrics MAP<STRING, DOUBLE>, artifact_uri STRING, status STRING, training_date TIMESTAMP, "
        "created_at TIMESTAMP, updated_at TIMESTAMP"
    ),
    "datasets": (
        "id BIGINT, project_id BIGINT, dataset_type STRING, version STRING, file_name STRING, file_path STRING, "
        "content_hash STRING, schema_hash STRING, row_count BIGINT, column_count BIGINT, load_id BIGINT, "
        "created_at TIMESTAMP"
    ),
    "dataset_profiles": (
        "dataset_id BIGINT, missing_values MAP<STRING, BIGINT>, column_types MAP<STRING, STRING>, "
        "numeric_summary MAP<STRING, STRUCT<count: BIGINT, mean: DOUBLE, minimum: DOUBLE, maximum: DOUBLE, "
        "standard_deviation: DOUBLE>>, categorical_summary MAP<STRING, STRUCT<count: BIGINT, unique: BIGINT, "
        "most_frequent: STRING, most_frequent_count: BIGINT>>, created_at TIMESTAMP"
    ),
    "dataset_classes": "dataset_id BIGINT, class STRING, n BIGINT",
    "dataset_rows": (
        "project_id BIGINT, load_id BIGINT, dataset_id BIGINT, row_id BIGINT, features MAP<STRING, STRING>"
    ),
    "baseline_features": (
        "load_id BIGINT, dataset_id BIGINT, feature STRING, dtype STRING, cells BIGINT, missing BIGINT, "
        "numbers BIGINT, edges ARRAY<DOUBLE>, bins ARRAY<BIGINT>"
    ),
    "baseline_slices": (
        "load_id BIGINT, dataset_id BIGINT, feature STRING, slice BIGINT, low DOUBLE, high DOUBLE, before BIGINT, "
        "nums ARRAY<DOUBLE>, counts ARRAY<BIGINT>"
    ),
    "baseline_categories": "load_id BIGINT, dataset_id BIGINT, feature STRING, category STRING, n BIGINT",
    "prediction_batches": (
        "id BIGINT, project_id BIGINT, model_version_id BIGINT, file_name STRING, file_path STRING, "
        "content_hash STRING, row_count BIGINT, is_labeled BOOLEAN, status STRING, error_message STRING, "
        "load_id BIGINT, uploaded_at TIMESTAMP"
    ),
    "predictions": (
        "project_id BIGINT, load_id BIGINT, batch_id BIGINT, row_id BIGINT, prediction_timestamp TIMESTAMP, true_label STRING, "
        "predicted_label STRING, confidence DOUBLE, features MAP<STRING, STRING>, created_at TIMESTAMP"
    ),
    "health_checks": (
        "id BIGINT, project_id BIGINT, model_version_id BIGINT, baseline_dataset_id BIGINT, "
        "prediction_batch_id BIGINT, status STRING, health_score DOUBLE, metrics STRUCT<sample_count: BIGINT, "
        "label_count: BIGINT, positive_label: STRING, accuracy: DOUBLE, precision: DOUBLE, recall: DOUBLE, "
        "f1: DOUBLE, error_rate: DOUBLE, roc_auc: DOUBLE, average_confidence: DOUBLE, low_confidence_rate: DOUBLE, "
        "minimum_confidence: DOUBLE, maximum_confidence: DOUBLE, minimum_share: DOUBLE, maximum_share: DOUBLE, "
        "class_count: BIGINT>, drift STRUCT<feature_count: BIGINT, drifted_feature_count: BIGINT, "
        "drift_rate: DOUBLE, drifted_features: ARRAY<STRING>>, component_scores STRUCT<performance_score: DOUBLE, "
        "drift_score: DOUBLE, data_quality_score: DOUBLE, confidence_score: DOUBLE, class_balance_score: DOUBLE>, "
        "missing_rate DOUBLE, created_at TIMESTAMP, run_id BIGINT"
    ),
    "diagnosis_reports": (
        "id BIGINT, health_check_id BIGINT, summary STRING, risk_level STRING, retraining_recommended BOOLEAN, "
        "findings ARRAY<STRUCT<code: STRING, severity: STRING, message: STRING>>, recommendations ARRAY<STRING>, "
        "created_at TIMESTAMP, run_id BIGINT"
    ),
    "check_features": (
        "health_check_id BIGINT, feature STRING, feature_type STRING, psi DOUBLE, ks_statistic DOUBLE, "
        "ks_p_value DOUBLE, tvd DOUBLE, severity STRING, created_at TIMESTAMP, run_id BIGINT"
    ),
    "check_categories": (
        "health_check_id BIGINT, feature STRING, category STRING, ref_share DOUBLE, cur_share DOUBLE, "
        "abs_difference DOUBLE, created_at TIMESTAMP, run_id BIGINT"
    ),
    "check_classes": (
        "health_check_id BIGINT, label STRING, support BIGINT, predicted BIGINT, true_share DOUBLE, "
        "predicted_share DOUBLE, precision DOUBLE, recall DOUBLE, f1 DOUBLE, created_at TIMESTAMP, run_id BIGINT"
    ),
    "check_confusion": (
        "health_check_id BIGINT, true_label STRING, predicted_label STRING, n BIGINT, created_at TIMESTAMP, run_id BIGINT"
    ),
    "raw_files": (
        "project_id BIGINT, load_id BIGINT, file_path STRING, content_hash STRING, number BIGINT, content BINARY, "
        "stored_at TIMESTAMP"
    ),
    "job_leases": "job_id BIGINT, owner BIGINT, asked_at TIMESTAMP, until TIMESTAMP",
    "deletions": "table_name STRING, id BIGINT, deleted_at TIMESTAMP",
    "job_events": (
        "job_id BIGINT, project_id BIGINT, job_type STRING, status STRING, event_at TIMESTAMP, payload STRING, "
        "result STRING, error_message STRING, run_id BIGINT"
    ),
}

RUN_TABLES = ["health_checks", "diagnosis_reports", "check_features", "check_categories", "check_classes", "check_confusion"]

# Partition columns. A load writes one folder per project, whatever the number of its files,
# so the number of folders grows with the loads and not with the batches.
PARTITIONS = {
    "dataset_rows": ["project_id", "load_id"],
    "predictions": ["project_id", "load_id"],
    "raw_files": ["project_id", "load_id"],
    # What a run of checks stores lies in a folder of that run.
    **{t: ["run_id"] for t in RUN_TABLES},
    "baseline_features": ["load_id"],
    "baseline_categories": ["load_id"],
}

# Order inside a folder: the rows of a batch lie together, so file statistics find them.
CLUSTERING = {
    "dataset_rows": ["dataset_id", "row_id"],
    "predictions": ["batch_id", "row_id"],
    "baseline_features": ["dataset_id", "feature"],
    "baseline_categories": ["dataset_id", "feature", "category"],
    "raw_files": ["file_path", "number"],
    **{t: ["id" if t in ("health_checks", "diagnosis_reports") else "health_check_id"] for t in RUN_TABLES},
}

# Tables of one folder per load whose rows are dealt into buckets, so that a join on the columns
# reads them without moving them.
BUCKETS = {"baseline_slices": ["dataset_id", "feature", "slice"]}
BUCKET_COUNT = 64

# Name of the folders that single writes of unpartitioned tables have.
WRITE = "write_no"

# For each table, the columns that point to another table's id. Rows go when
# the row they point to goes.
REFERENCES = {
    "model_versions": {"projects": "project_id"},
    "datasets": {"projects": "project_id"},
    "dataset_profiles": {"datasets": "dataset_id"},
    "dataset_classes": {"datasets": "dataset_id"},
    "dataset_rows": {"datasets": "dataset_id"},
    "baseline_features": {"datasets": "dataset_id"},
    "baseline_slices": {"datasets": "dataset_id"},
    "baseline_categories": {"datasets": "dataset_id"},
    "prediction_batches": {"projects": "project_id", "model_versions": "model_version_id"},
    "predictions": {"prediction_batches": "batch_id"},
    "health_checks": {
        "projects": "project_id",
        "model_versions": "model_version_id",
        "datasets": "baseline_dataset_id",
        "prediction_batches": "prediction_batch_id",
    },
    "diagnosis_reports": {"health_checks": "health_check_id"},
    "check_features": {"health_checks": "health_check_id"},
    "check_categories": {"health_checks": "health_check_id"},
    "check_classes": {"health_checks": "health_check_id"},
    "check_confusion": {"health_checks": "health_check_id"},
    "job_events": {"projects": "project_id"},
}

# What only one row of a table may have, and the columns that say which came first.
IDENTITIES = {
    "projects": (["name"], ["created_at", "id"]),
    "model_versions": (["project_id", "name", "version"], ["created_at", "id"]),
    "datasets": (["project_id", "dataset_type", "version"], ["created_at", "load_id"]),
    "prediction_batches": (["project_id", "model_version_id", "content_hash"], ["uploaded_at", "load_id"]),
}

# Accepted enumerations and text lengths (lowest, highest; 0 allows NULL).
PROBLEM_TYPES = ["binary_classification", "multiclass_classification"]
DATASET_TYPES = ["training", "validation", "testing", "production"]
PROJECT_LENGTHS = {
    "name": (3, 150),
    "description": (0, 2000),
    "target_column": (1, 100),
    "positive_class": (0, 100),
    "metric_priority": (1, 50),
    "owner": (0, 150),
}
MODEL_LENGTHS = {
    "name": (1, 150),
    "version": (1, 50),
    "algorithm": (1, 150),
    "framework": (1, 100),
    "artifact_uri": (0, 500),
    "status": (1, 50),
}


class Store:
    """The registry tables under one shared folder."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _stored(self, table: str) -> DataFrame | None:
        try:
            rows = self.spark.read.schema(SCHEMAS[table]).parquet(self.path(table))
            return rows.drop(WRITE)
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return None

    def read(self, table: str) -> DataFrame:
        """The table without deleted rows, empty if nothing was written yet."""
        rows = self._stored(table)
        if rows is None:
            return self.spark.createDataFrame([], SCHEMAS[table])
        deleted = self._stored("deletions") if table != "deletions" else None
        if deleted is not None:
            for parent, key in self._keys(table).items():
                gone = deleted.where(F.col("table_name") == parent).select(F.col("id").alias(key))
                rows = rows.join(gone, key, "left_anti").select(*rows.columns)
        return self._sole(table, rows)

    def _sole(self, table: str, rows: DataFrame) -> DataFrame:
        """One row of each identity: of two loads that were started together the first one counts.

        A load lists a row by one append, at its end; what a load that lost has stored is in folders
        that no listed row points to. Rows without a whole identity are told apart by id.
        """
        if table not in IDENTITIES:
            return rows
        identity, order = IDENTITIES[table]
        named = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in identity])
        whose = Window.partitionBy(*identity, F.when(~named, F.col("id")))
        return rows.withColumn("place_no", F.row_number().over(whose.orderBy(*order))).where("place_no = 1").drop("place_no")

    def delete(self, table: str, ids: DataFrame, at: Column) -> None:
        """Delete rows by ``id`` and everything that refers to them.

        Only the ids are recorded, in one append; readers leave the rows out. Deleting a
        project therefore rewrites nothing, however many predictions hang on it.
        """
        gone = {table: self.read(table).join(ids.select("id").distinct(), "id", "left_semi").select("id")}
        for child, parents in REFERENCES.items():
            if "id" not in self.spark.createDataFrame([], SCHEMAS[child]).columns:
                continue
            hits = [
                self.read(child).join(gone[p].withColumnRenamed("id", key), key, "left_semi").select("id")
                for p, key in parents.items()
                if p in gone
            ]
            if hits:
                gone[child] = reduce(DataFrame.union, hits).distinct()
        marks = [g.select(F.lit(name).alias("table_name"), "id", at.alias("deleted_at")) for name, g in gone.items()]
        self.append("deletions", reduce(DataFrame.unionByName, marks))

    def compact(self) -> None:
        """Take deleted rows out of the files and forget the marks; reads then join with none.

        Of partitioned tables only the folders that hold deleted rows are rewritten, of others the
        whole table. Marks go last, so a compaction that died is repeated without harm. Nothing else
        may write to the store meanwhile; marks that are added all the same stay.
        """
        marks = self._stored("deletions")
        if marks is None:
            return
        marks = cut_lineage(marks)
        for table in SCHEMAS:
            rows = None if table == "deletions" else self._stored(table)
            if rows is not None:
                self._compact(table, rows, marks)
        left = self._stored("deletions").join(marks, ["table_name", "id"], "left_anti")
        self._exchange("deletions", cut_lineage(left))

    def _keys(self, table: str) -> dict[str, str]:
        """The columns by which a row may be deleted, by the table they point to."""
        own = {table: "id"} if "id" in self.spark.createDataFrame([], SCHEMAS[table]).columns else {}
        return {**own, **REFERENCES.get(table, {})}

    def _compact(self, table: str, rows: DataFrame, marks: DataFrame) -> None:
        hits = [
            rows.join(marks.where(F.col("table_name") == parent).select(F.col("id").alias(key)), key, "left_semi").select(*rows.columns)
            for parent, key in self._keys(table).items()
        ]
        if not hits:
            return
        by = ["load_id"] if table in BUCKETS else PARTITIONS.get(table, [])
        # Broadcast: a sort by the folder would bring all rows of a large one to one task.
        folders = as_small_side(reduce(DataFrame.union, [h.select(*by, F.lit(1).alias("hit")) for h in hits]).distinct())
        if folders.isEmpty():
            return
        kept = self.read(table)
        if not by:
            self._exchange(table, cut_lineage(kept))
            return
        met = [F.col(f"k.{c}").eqNullSafe(F.col(f"f.{c}")) for c in by]
        kept = cut_lineage(kept.alias("k").join(folders.alias("f"), reduce(lambda a, b: a & b, met), "left_semi"))
        if table in BUCKETS:
            for row in folders.select("load_id").toLocalIterator():
                self.replace_buckets(table, kept.where(F.col("load_id") == row["load_id"]), row["load_id"])
            return
        self.replace_partitions(table, kept)
        full = kept.select(*by).distinct()
        met = [F.col(f"f.{c}").eqNullSafe(F.col(f"k.{c}")) for c in by]
        # Folders are as many as loads; those without a row left go as a whole.
        for row in folders.alias("f").join(full.alias("k"), reduce(lambda a, b: a & b, met), "left_anti").toLocalIterator():
            values = ["__HIVE_DEFAULT_PARTITION__" if row[c] is None else row[c] for c in by]
            self._remove("/".join([self.path(table), *[f"{c}={v}" for c, v in zip(by, values, strict=True)]]))

    def _files(self, place: str):
        """The file system of a place, and the place as one of its paths."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(place)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _remove(self, place: str) -> None:
        system, path = self._files(place)
        system.delete(path, True)

    def _exchange(self, table: str, rows: DataFrame) -> None:
        """Put ``rows`` in the place of a table, by renaming once they are written as a whole."""
        place = self.path(table)
        system, path = self._files(place)
        _, fresh = self._files(f"{place}.fresh")
        system.delete(fresh, True)
        empty = rows.isEmpty()
        if not empty:
            self._shaped(table, rows).write.parquet(self._write_place(f"{place}.fresh"))
        system.delete(path, True)
        if not empty:
            system.rename(fresh, path)

    def _shaped(self, table: str, rows: DataFrame) -> DataFrame:
        wanted = self.spark.createDataFrame([], SCHEMAS[table])
        return rows.to(wanted.schema)

    def append(self, table: str, rows: DataFrame) -> None:
        """Add rows. Every write to an unpartitioned table has a folder of its own, so that writes
        of several sessions at a time do not meet in one."""
        shaped, by = self._shaped(table, rows), PARTITIONS.get(table)
        if by:
            shaped.write.mode("append").partitionBy(*by).parquet(self.path(table))
        else:
            shaped.write.parquet(self._write_place(self.path(table)))

    def _write_place(self, place: str) -> str:
        return f"{place}/{WRITE}={uuid.uuid4().hex}"

    def append_once(self, table: str, rows: DataFrame, key: str) -> None:
        """Append the rows whose ``key`` the table does not have yet, so that a repeat adds nothing."""
        stored = self._stored(table)
        new = rows if stored is None else rows.join(stored.select(key).distinct(), key, "left_anti").select(*rows.columns)
        self.append(table, cut_lineage(new))

    def of_runs(self, table: str, runs: list[int]) -> DataFrame | None:
        """Rows of a table that the given runs stored; other runs' folders are not listed for reading."""
        stored = self._stored(table) if runs else None
        return None if stored is None else stored.where(F.col("run_id").isin(runs))

    def store_run(self, table: str, rows: DataFrame, key: str, run_id: int, earlier: list[int]) -> None:
        """Store what a run found in its own folder, without keys that ``earlier`` runs stored.

        Repeating the write overwrites the folder. Only folders of the earlier runs are read, which
        are those that began the same jobs and did not end them.
        """
        stored = self.of_runs(table, earlier)
        new = rows if stored is None else rows.join(stored.select(key).distinct(), key, "left_anti").select(*rows.columns)
        self.replace_partitions(table, new.withColumn("run_id", F.lit(run_id)))

    def replace_partitions(self, table: str, rows: DataFrame) -> None:
        """Write rows of a partitioned table so that repeating the write changes nothing."""
        by = PARTITIONS[table]
        # Range partitions hold neighbouring batches, or a piece of one large batch, so no
        # batch has to fit into one task and every file covers a narrow range of batches.
        order = [*by, *CLUSTERING[table]]
        shaped = self._shaped(table, rows).repartitionByRange(*order).sortWithinPartitions(*order)
        writer = shaped.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(*by).parquet(self.path(table))

    def replace_buckets(self, table: str, rows: DataFrame, load_id: int) -> None:
        """Write a load's rows of a bucketed table; repeating the write changes nothing."""
        keys, place = BUCKETS[table], f"{self.path(table)}/load_id={load_id}"
        shaped = self._shaped(table, rows.withColumn("load_id", F.lit(load_id))).drop("load_id")
        # Buckets are a property of catalog tables: a name is lent to the folder while it is written.
        name = f"tidewatch_{uuid.uuid4().hex}"
        # Written aside and renamed, so that the same load in two sessions leaves one whole copy.
        aside = f"{self.path(table)}/.{name}"
        writer = shaped.repartition(BUCKET_COUNT, *keys).write.format("parquet").mode("overwrite")
        try:
            writer.bucketBy(BUCKET_COUNT, *keys).sortBy(*keys).option("path", aside).saveAsTable(name)
        finally:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        system, path = self._files(place)
        system.delete(path, True)
        system.rename(self._files(aside)[1], path)

    def read_buckets(self, table: str) -> DataFrame:
        """A bucketed table with all of its loads, empty if nothing was written yet."""
        if self._stored(table) is None:
            return self.spark.createDataFrame([], SCHEMAS[table])
        name = f"tidewatch_{table}_{zlib.crc32(self.root.encode()):08x}_{len(self.root)}"
        keys = ", ".join(BUCKETS[table])
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({SCHEMAS[table]}) USING parquet PARTITIONED BY (load_id) "
            f"CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {BUCKET_COUNT} BUCKETS LOCATION '{self.path(table)}'"
        )
        self.spark.sql(f"MSCK REPAIR TABLE {name}")
        self.spark.catalog.refreshTable(name)
        return self.spark.table(name)
