"""Training a classifier on a table and logging its predictions for monitoring."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import Bucketizer, StringIndexer, StringIndexerModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.cumulative import join_on_groups, running_totals
from tidewatch.operators.forest import Forest, bin_bounds, grow_forest
from tidewatch.operators.metrics import classification_metrics
from tidewatch.operators.profile import columns_by_kind
from tidewatch.operators.ranking import roc_auc
from tidewatch.session import BROADCAST_ROWS, as_small_side, cut_lineage

# Split share, seed, forest size and depth.
TEST_SHARE = 0.30
SEED = 42
TREES = 100
DEPTH = 5


def training_table_errors(df: DataFrame, target: str) -> DataFrame:
    """One row with the first reason the table cannot be trained on, NULL if there is none."""
    if target not in df.columns:
        return df.sparkSession.range(1).select(F.lit(f"Target column '{target}' was not found.").alias("error"))
    # Two classes exist exactly when the smallest and the largest label differ.
    counted = df.agg(F.count(F.lit(1)).alias("n"), F.min(target).alias("low"), F.max(target).alias("high"))
    return counted.select(
        F.when(F.col("n") == 0, "The training dataset is empty.")
        .when(F.col("low").isNull() | (F.col("low") == F.col("high")), "The target column must contain at least two classes.")
        .alias("error")
    )


def class_allocation(classes: DataFrame, test_share: float = TEST_SHARE) -> DataFrame:
    """Exact stratified sizes from one row ``(label, n)`` per class: test rows and train rows.

    The test set has ceil(share * rows) rows; classes get the floor of their part and the
    rest goes to the largest remainders (then the smallest label).
    """
    classes = cut_lineage(classes)
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    test_total = math.ceil(total * test_share)
    quota = F.col("n") * F.lit(test_total) / F.lit(max(total, 1))
    sized = classes.withColumns({"quota": quota, "base": F.floor(quota), "one": F.lit(1).cast("long")})
    left_over = test_total - (sized.agg(F.sum("base")).first()[0] or 0)
    sized = sized.withColumn("lack", F.floor("quota") - F.col("quota"))
    if classes.count() <= BROADCAST_ROWS:
        placed = sized.withColumn("cum_one", F.row_number().over(Window.partitionBy().orderBy("lack", "label")))
    else:
        # Places by running totals, so that any number of classes is ranked without one task.
        placed = running_totals(sized, [], ["lack", "label"], ["one"], few_groups=True)
    test = F.col("base") + F.when(F.col("cum_one") <= left_over, 1).otherwise(0)
    return placed.select("label", "n", test.alias("test_n"), (F.col("n") - test).alias("train_n"))


def _limits(counted: DataFrame, name: str) -> DataFrame:
    """The slice of each label that holds its last wanted row, and the rows before that slice.

    ``counted`` has label, ``name``, n and need; a label has at most 2^16 slices.
    """
    upto = Window.partitionBy("label").orderBy(name).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counted.withColumn("upto", F.sum("n").over(upto))
    held = placed.where("upto >= need AND upto - n < need")
    return held.select("label", F.col(name).alias("slice"), (F.col("need") - (F.col("upto") - F.col("n"))).alias("need"))


def _slice(bits: int) -> Column:
    """The first ``bits`` bits of a hash, in the order of the hashes."""
    return F.shiftright("pick", 64 - bits)


def stratified_split(df: DataFrame, target: str, test_share: float = TEST_SHARE, seed: int = SEED) -> DataFrame:
    """Add ``is_test``: in every class exactly the allocated number of rows, chosen by hash order.

    The last hash that fits is found without sorting: rows are counted by the first 16 bits of
    their hash, then those in the slice that holds it by the next 16, then the few that are left by
    their hash. If equal rows straddle the limit, it is known how many of them to take. Rows are then
    flagged by comparing hashes; only rows equal to a straddling one are numbered.
    """
    columns = df.columns
    picked = df.withColumns({"label": F.col(target), "pick": F.xxhash64(F.lit(seed), *columns)})
    rows = picked.select("label", "pick")
    counted = cut_lineage(rows.groupBy("label", _slice(16).alias("slice")).agg(F.count(F.lit(1)).alias("n")))
    sizes = as_small_side(class_allocation(counted.groupBy("label").agg(F.sum("n").alias("n")), test_share))
    needed = sizes.select("label", F.col("test_n").alias("need"))
    held = as_small_side(_limits(join_on_groups(counted, needed, ["label"]), "slice"))
    inside = join_on_groups(rows, held, ["label"]).where(_slice(16) == F.col("slice"))
    finer = inside.groupBy("label", _slice(32).alias("finer"), "need").agg(F.count(F.lit(1)).alias("n"))
    held = as_small_side(_limits(finer, "finer"))
    inside = join_on_groups(rows, held, ["label"]).where(_slice(32) == F.col("slice"))
    last = inside.groupBy("label", "pick", "slice", "need").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("label").orderBy("pick").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = last.withColumn("upto", F.sum("n").over(upto)).withColumn("before", F.col("upto") - F.col("n"))
    fits, straddles = F.col("upto") <= F.col("need"), (F.col("upto") > F.col("need")) & (F.col("before") < F.col("need"))
    # If no hash of the slice fits as a whole, the last one before the slice does.
    below = F.shiftleft(F.max("slice"), 32) - 1
    bounds = as_small_side(
        ranked.groupBy("label").agg(
            F.coalesce(F.max(F.when(fits, F.col("pick"))), below).alias("last_pick"),
            F.max(F.when(straddles, F.col("pick"))).alias("split_pick"),
            F.max(F.when(straddles, F.col("need") - F.col("before"))).alias("take"),
        )
    )
    placed = join_on_groups(picked, bounds, ["label"], "left")
    on_split = F.col("pick").eqNullSafe(F.col("split_pick"))
    whole = placed.where(~on_split).withColumn("is_test", F.coalesce(F.col("pick") <= F.col("last_pick"), F.lit(False)))
    flagged = whole.select(*columns, "is_test")
    if bounds.where("split_pick IS NOT NULL").isEmpty():
        return flagged
    # Written once, so that a repeated task cannot number the same rows differently.
    split = cut_lineage(
        placed.where(on_split).withColumns(
            {"row_no": F.monotonically_increasing_id(), "copy": F.lit(1).cast("long")}
        )
    )
    numbered = running_totals(split, ["label"], ["row_no"], ["copy"])
    taken = numbered.withColumn("is_test", F.col("cum_copy") <= F.col("take"))
    return flagged.unionByName(taken.select(*columns, "is_test"))


def balanced_weights(df: DataFrame, target: str) -> DataFrame:
    """Weight per class: rows / (classes * rows of the class)."""
    counted = cut_lineage(df.groupBy(F.col(target).alias("label")).agg(F.count(F.lit(1)).alias("n")))
    whole = counted.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds")).first()
    return counted.select("label", "n", (F.lit(whole["total"]) / (F.lit(whole["kinds"]) * F.col("n"))).alias("weight"))


@dataclass
class TrainedModel:
    """A fitted forest, the pipeline that turns its inputs into codes, and the label order it predicts in."""

    pipeline: PipelineModel
    forest: Forest
    labels: list[str]
    target: str
    features: list[str]
    numeric: list[str]
    codes: list[str]

    def predict(self, df: DataFrame) -> DataFrame:
        """Add predicted_label and confidence, the probability of the second label."""
        coded = _coded(self.pipeline, df.withColumn(self.target, F.col(self.target).cast("string")), self.numeric, self.codes)
        scored = coded.withColumn("scored", self.forest.predict([F.col(c) for c in self.codes]))
        names = F.array(*[F.lit(label) for label in self.labels])
        return scored.select(
            *self.features,
            F.col(self.target).alias("true_label"),
            F.element_at(names, F.col("scored.prediction").cast("int") + 1).alias("predicted_label"),
            F.col("scored.second").alias("confidence"),
        )


def _complete(df: DataFrame, numeric: list[str]) -> DataFrame:
    """``df``, failing where a number is missing or infinite."""

    def checked(name: str) -> Column:
        value = F.col(name).cast("double")
        odd = value.isNull() | F.isnan(value) | (F.abs(value) == F.lit(math.inf))
        return F.when(odd, F.raise_error(F.lit(f"Training rows hold a missing or infinite number in '{name}'."))).otherwise(value)

    return df.withColumns({c: checked(c) for c in numeric})


def _coded(pipeline: PipelineModel, df: DataFrame, numeric: list[str], codes: list[str]) -> DataFrame:
    """``df`` with its codes; a missing number takes the last bin."""
    filled = df.withColumns({f"{c}_filled": F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in numeric})
    return pipeline.transform(filled).withColumns({c: F.col(c).cast("int") for c in codes})


def train_forest(
    train: DataFrame,
    target: str,
    trees: int = TREES,
    depth: int = DEPTH,
    seed: int = SEED,
    categories: list[str] | None = None,
) -> TrainedModel:
    """Each known category a feature (unseen ones have none), numbers in bins, weighted random forest.

    ``categories`` names the columns to encode; their values form a vocabulary that the driver
    holds, so columns like ids or free text do not belong there and are left out when not named.
    By default all columns that are not numbers are encoded. Numbers must be finite in training rows;
    when predicting, a missing one goes right at every split.
    """
    numeric, others = columns_by_kind(train.select(*[c for c in train.columns if c != target]))
    categorical = others if categories is None else [c for c in others if c in categories]
    features = [c for c in train.columns if c in (*numeric, *categorical)]
    weights = {str(r["label"]): r["weight"] for r in balanced_weights(train.withColumn(target, F.col(target).cast("string")), target).collect()}
    labeled = train.withColumn(target, F.col(target).cast("string"))
    # Labels in sorted order, so index 1 is the last of two labels.
    indexer = StringIndexer(inputCol=target, outputCol="label_index", stringOrderType="alphabetAsc")
    label_model: StringIndexerModel = indexer.setHandleInvalid("error").fit(labeled)
    stages, kinds, bounds = [label_model], [], bin_bounds(train, numeric)
    if numeric:
        splits = [[-math.inf, *(cuts or [0.0]), math.inf] for cuts in bounds]
        names = {"inputCols": [f"{c}_filled" for c in numeric], "outputCols": [f"{c}_code" for c in numeric]}
        stages.append(Bucketizer(splitsArray=splits, handleInvalid="keep", **names))
        kinds += [0] * len(numeric)
    if categorical:
        indexed = StringIndexer(inputCols=categorical, outputCols=[f"{c}_code" for c in categorical], handleInvalid="keep").fit(labeled)
        stages.append(indexed)
        kinds += [len(known) for known in indexed.labelsArray]
    pipeline = PipelineModel(stages)
    codes = [f"{c}_code" for c in (*numeric, *categorical)]
    rows = _coded(pipeline, _complete(labeled, numeric), numeric, codes).withColumn("label_index", F.col("label_index").cast("int"))
    bins = max([len(cuts or [0.0]) + 2 for cuts in bounds], default=2)
    labels = list(label_model.labels)
    forest = grow_forest(rows.select(*codes, "label_index"), codes, "label_index", kinds, bins, [weights[x] for x in labels], trees, depth, seed)
    return TrainedModel(pipeline, forest, labels, target, features, numeric, codes)


def evaluate(predictions: DataFrame) -> DataFrame:
    """Accuracy, precision, recall, F1 and AUC of predicted rows, one row."""
    metrics = classification_metrics(predictions).select("sample_count", "accuracy", "precision", "recall", "f1")
    return join_on_groups(metrics, roc_auc(predictions), [])


def model_metadata(model: TrainedModel, scores: DataFrame, project_id: int, name: str, version: str, train_rows: int) -> DataFrame:
    """A row to register as a model version: algorithm, measures and sizes of a trained model."""
    measures = ["sample_count", "accuracy", "precision", "recall", "f1", "roc_auc"]
    pairs = [v for m in measures for v in (F.lit(m), F.col(m).cast("double"))]
    sizes = {"train_rows": train_rows, "feature_count": len(model.features), "class_count": len(model.labels)}
    pairs += [v for n, size in sizes.items() for v in (F.lit(n), F.lit(float(size)))]
    return scores.select(
        F.lit(project_id).cast("bigint").alias("project_id"),
        F.lit(name).alias("name"),
        F.lit(version).alias("version"),
        F.lit("random_forest").alias("algorithm"),
        F.lit("spark").alias("framework"),
        F.create_map(*pairs).alias("metrics"),
    )


def prediction_log(predictions: DataFrame, at: Column) -> DataFrame:
    """Predictions as a log: timestamp first, then features, labels and confidence."""
    others = [c for c in predictions.columns if c not in ("true_label", "predicted_label", "confidence")]
    iso = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
    return predictions.select(iso.alias("timestamp"), *others, "true_label", "predicted_label", "confidence")


def write_log(log: DataFrame, path: str) -> None:
    """Write a log as CSV with a header, in as many files as it has partitions."""
    log.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
