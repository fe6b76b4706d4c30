"""Quality selection by importance resampling.

Texts become bags of hashed word unigrams and bigrams. Two generative models are counted: the
target from documents labelled good, the raw one from all documents. A text's importance weight
is the log ratio of the two models over its features; a margin per feature, fitted on the
labelled sample, is taken off. Scaled Gumbel noise is added and the k highest keys are kept, k
being the number of texts of weight 0 or more. At TEMPERATURE 1 this draws k texts without
replacement in proportion to their weights; at the value set here it is in effect a threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm import grams
from tidewatch.llm.common import fresh, small_batches, tidy, without
from tidewatch.operators.cumulative import running_totals

BUCKETS = 10_007
#: Bytes of text whose features are made at a time; their arrays take some fifty bytes per byte.
BLOCK = 1 << 17
#: Labelled rows of either class used at most, taken in order of a hash of their key.
SAMPLE = 10_000
SEED = 5
#: Noise is multiplied by this: 1 draws in proportion to the weights, 0 takes the largest.
TEMPERATURE = 0.1


@dataclass(frozen=True)
class Model:
    """Log ratio of target to raw per bucket, and the margin that a feature must exceed."""

    ratio: np.ndarray
    margin: float


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of unigrams and bigrams of all texts, and their number per text.

    Unigrams are runs of letters and digits and runs of other signs, A-Z lower-cased.
    """
    low = grams.LOWER[data]
    starts, ends, counts = grams.split(grams.KIND[low], offsets)
    single = grams.mix(grams.stretch(grams.running(low), starts, ends))
    text = np.repeat(np.arange(len(counts)), counts)
    if not len(single):
        return np.zeros(0, dtype=np.int64), np.zeros(len(counts), dtype=np.int64)
    double = grams.mix(single[:-1] * grams.U(0x9FB21C651E98DF25) + single[1:])[text[:-1] == text[1:]]
    owner = np.concatenate([text, text[:-1][text[:-1] == text[1:]]])
    order = np.argsort(owner, kind="stable")
    made = np.concatenate([single, double])[order] % grams.U(BUCKETS)
    return made.astype(np.int64), np.bincount(owner, minlength=len(counts))


def labelled_sample(documents: DataFrame, labels: DataFrame, limit: int = SAMPLE, key: str = "doc_id", label: str = "quality") -> DataFrame:
    """``(key, good)`` of at most ``limit`` labelled keys per class, by hash order.

    A key with contradicting labels, a NULL key and a NULL label are left out.
    """
    named = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("good"))
    sure = named.filter("key IS NOT NULL AND good IN (0, 1)").groupBy("key").agg(F.min("good").alias("good"), F.max("good").alias("most"))
    sure = sure.filter("good = most").select("key", "good")
    draw = F.xxhash64(F.col("key").cast("string"))
    parts = [sure.filter(F.col("good") == c).orderBy(draw, "key").limit(limit) for c in (0, 1)]
    return parts[0].unionByName(parts[1])


def fit(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", limit: int = SAMPLE) -> Model:
    """Count both models over all documents and set the margin on the labelled sample.

    Without documents labelled good, or without text, the models are equal and the margin is
    negative, so every text is kept.
    """
    sample = labelled_sample(documents, labels, limit, key)
    # At most 2 x limit rows of a key and a flag: small enough to broadcast whatever the input.
    rows = documents.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    marked = rows.join(F.broadcast(sample), "key", "left").select("text", "good")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            good = np.array([x == 1 for x in batch.column("good").to_pylist()])
            for first, data, offsets in grams.blocks(batch.column("text"), BLOCK):
                found, counts = features(data, offsets)
                raw += np.bincount(found, minlength=BUCKETS)
                chosen = np.repeat(good[first : first + len(counts)], counts)
                target += np.bincount(found[chosen], minlength=BUCKETS)
        hit = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(raw[hit]), pa.array(target[hit])], names=["bucket", "raw", "target"])

    counted = marked.mapInArrow(tidy(count), "bucket long, raw long, target long")
    sums = counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.ones(BUCKETS), np.ones(BUCKETS)
    raw[sums["bucket"]] += sums["raw"]
    target[sums["bucket"]] += sums["target"]
    if target.sum() == BUCKETS:
        return Model(np.zeros(BUCKETS), -1.0)
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    chosen = rows.join(F.broadcast(sample), "key").select("text", "good")
    points = chosen.mapInArrow(tidy(_judged(raw, target)), "good int, mean double").toPandas()
    return Model(ratio, _margin(points["mean"].to_numpy(), points["good"].to_numpy()))


def _judged(raw: np.ndarray, target: np.ndarray):
    """A task that gives ``(good, mean)`` per labelled text with features: its mean log ratio.

    A text labelled good is part of the target counts; its own features are taken off them first,
    so that it is judged like a text that was not counted.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.array(batch.column("good").to_pylist(), dtype=np.int64)
            for first, data, offsets in grams.blocks(batch.column("text"), BLOCK):
                found, counts = features(data, offsets)
                owner = np.repeat(np.arange(len(counts)), counts)
                label = good[first : first + len(counts)]
                _, which, uses = np.unique(owner * BUCKETS + found, return_inverse=True, return_counts=True)
                own = np.where(label[owner] == 1, uses[which], 0)
                rest = target.sum() - np.where(label == 1, counts, 0)[owner]
                ratio = np.log((target[found] - own) / rest) - np.log(raw[found] / raw.sum())
                mean = np.bincount(owner, weights=ratio, minlength=len(counts)) / np.maximum(counts, 1)
                solid = counts > 0
                yield pa.RecordBatch.from_arrays([pa.array(label[solid].astype(np.int32)), pa.array(mean[solid])], names=["good", "mean"])

    return judge


def _margin(mean: np.ndarray, good: np.ndarray) -> float:
    """The cut with the least weighted error: losing a good text costs four bad ones kept.

    Errors are shares of their class. The cut lies halfway between the two neighbouring means.
    """
    if not (good == 1).any() or not (good == 0).any():
        return float(mean.min()) - 1.0 if len(mean) else -1.0
    order = np.argsort(mean, kind="stable")
    mean, good = mean[order], good[order]
    lost = np.concatenate([[0.0], np.cumsum(good == 1) / (good == 1).sum()])
    caught = np.concatenate([[0.0], np.cumsum(good == 0) / (good == 0).sum()])
    edges = np.concatenate([[mean[0] - 1.0], (mean[:-1] + mean[1:]) / 2, [mean[-1] + 1.0]])
    return float(edges[np.argmin(4 * lost + (1 - caught))])


def weigh(rows: DataFrame, model: Model, text: str = "text", whole: bool = True) -> DataFrame:
    """``rows`` with ``log_weight`` (log ratio less the margin, summed) and ``features``.

    NULL and empty texts have no features and weight 0. Columns so named are replaced. Without
    ``whole`` the texts do not come back from Python.
    """
    kept = rows.select(*without(rows, "log_weight", "features"))
    fields = [f for f in kept.schema.fields if whole or f.name != text]
    schema = T.StructType([*fields, T.StructField("log_weight", T.DoubleType()), T.StructField("features", T.LongType())])
    returned = [f.name for f in fields]
    ratio, margin = model.ratio, model.margin

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in grams.blocks(batch.column(text), BLOCK):
                found, counts = features(data, offsets)
                owner = np.repeat(np.arange(len(counts)), counts)
                total = np.bincount(owner, weights=ratio[found] - margin, minlength=len(counts))
                part = batch.slice(first, len(counts))
                yield pa.RecordBatch.from_arrays(
                    [
                        *[c for c, n in zip(part.columns, part.schema.names, strict=True) if whole or n != text],
                        pa.array(np.round(total.astype(np.float64), 6)),
                        pa.array(counts.astype(np.int64)),
                    ],
                    names=[*returned, "log_weight", "features"],
                )

    return kept.mapInArrow(tidy(score), schema)


def keyed(rows: DataFrame, model: Model, key: str = "doc_id", text: str = "text", seed: int = SEED, temperature: float = TEMPERATURE, whole: bool = True) -> DataFrame:
    """``rows`` with ``log_weight``, ``features`` and ``sort_key`` (weight plus Gumbel noise).

    The noise depends on the seed, the key and the text alone, so equal rows share it. Without
    ``whole`` the texts are left out.
    """
    (noise_name,) = fresh(rows, "noise")
    dice = F.xxhash64(F.lit(seed), F.col(f"`{key}`").cast("string"), F.col(f"`{text}`"))
    uniform = (F.shiftrightunsigned(dice, 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    noise = -F.log(-F.log(uniform))
    weighed = weigh(rows.withColumn(noise_name, noise).select(*without(rows, "sort_key"), noise_name), model, text, whole)
    return weighed.withColumn("sort_key", F.col("log_weight") + F.lit(temperature) * F.col(noise_name)).drop(noise_name)


def select(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", k: int | None = None, seed: int = SEED, temperature: float = TEMPERATURE) -> DataFrame:
    """The ``k`` documents with the highest keys, with ``log_weight``, ``features``, ``sort_key``.

    ``k`` defaults to the number of documents whose weight is not negative, that is, those the
    classifier takes for the target. Rows that tie with the k-th are all kept. Texts without
    features weigh 0 and are kept like borderline texts. An empty table gives an empty table.
    The k-th key is found by running counts over range-partitioned keys; only that one number
    reaches the driver.
    """
    thin = documents.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    # Python holds few texts at a time, and for the ranking none comes back.
    with small_batches(documents.sparkSession):
        model = fit(documents, labels, key, text)
        ranks = keyed(thin, model, "key", "text", seed, temperature, whole=False)
        keys = ranks.select(F.col("log_weight").alias("weight"), (-F.col("sort_key")).alias("low"), F.lit(1).cast("long").alias("one"))
        ranked = running_totals(keys, [], ["low", "weight"], ["one"], few_groups=True)
        wanted = ranked.filter("weight >= 0").count() if k is None else k
        edge = ranked.filter(F.col("cum_one") <= wanted).agg(F.max("low").alias("low")).first()["low"]
    rated = keyed(documents, model, key, text, seed, temperature)
    if edge is None:
        return rated.limit(0)
    return rated.filter(-F.col("sort_key") <= edge)
