"""From raw documents to token ids: five stages, each written as Parquet and read by the next.

1. ``quality``: documents that importance resampling rejects go.
2. ``line_dedup``: lines that repeat an earlier line go; documents left without words go.
3. ``near_duplicates``: one document of each class of similar texts stays (five-word shingles,
   similarity of 0.8 or more).
4. ``decontamination``: documents that hold a benchmark passage go.
5. ``tokens``: byte-level BPE ids of the whole texts, decoded again as a check.

Every stage works on all rows of the one before it; all but the last return the columns of
``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import byte_bpe, decontaminate, line_dedup, ngram_join, quality
from tidewatch.session import shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Words of a shingle and the least similarity in percent of near duplicates.
SHINGLE_WORDS = 5
SIMILAR_PERCENT = 80


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.select(docs, _table(spark, sf_dir, "labels")).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_per_class(docs, SHINGLE_WORDS, SIMILAR_PERCENT).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, _table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids`` (little-endian 32-bit) and the digests of ids and bytes."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = byte_bpe.encode(docs.select("doc_id", "text"), ranks, public_tokenizers.PATTERN).drop("text")
    return byte_bpe.decode(coded, ranks).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        "ids",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("raw", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality", keep_good),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("tokens", to_tokens),
]

#: The first stage fits a model and the last applies a tokenizer, which SQL cannot express; the
#: pipeline is tested against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and reread."""
    folder = shared_folder(spark, "pipeline")
    docs = _table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        place = f"{folder}/{number}_{name}"
        stage(spark, docs, sf_dir).write.parquet(place)
        docs = spark.read.parquet(place)
    return docs
