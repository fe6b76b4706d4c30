"""Session set-up and the two physical helpers every operator shares."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Largest number of rows and of bytes (values as text) a side may have to be broadcast.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20


def build_session(app_name: str = "tidewatch", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators assume (adaptive plans, UTC)."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.checkpoint.compress": "true",
        **conf,
    }
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def _ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the session; a temporary one only in local mode."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
                raise RuntimeError("Set spark.checkpoint.dir to a folder all executors can reach.")
            shared = tempfile.mkdtemp(prefix="tidewatch-checkpoint-")
        context.setCheckpointDir(shared)
    return context.getCheckpointDir()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared checkpoint folder, for tables and files of one run."""
    return f"{_ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from the written copy.

    Used where several later steps read one intermediate result: the expensive scan and
    shuffle before it then happen exactly once, and losing an executor afterwards costs a
    re-read of the files, not a recomputation.
    """
    _ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def as_small_side(df: DataFrame, bounded: bool = False, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a side that is known or found to be small.

    ``bounded`` says that its row count is limited by the schema and the number of shuffle
    partitions (no key columns), so it is broadcast as it is. Otherwise it is computed and
    measured first; above ``limit`` rows or BROADCAST_BYTES the join is left to the optimizer,
    a shuffle join whose hot partitions adaptive execution splits.
    """
    if bounded:
        return F.broadcast(df)
    width = reduce(lambda a, b: a + b, [_bytes(f) for f in df.schema], F.lit(0))
    computed = cut_lineage(df)
    found = computed.agg(F.count(F.lit(1)).alias("n"), F.sum(width).alias("bytes")).first()
    return F.broadcast(computed) if found["n"] <= limit and (found["bytes"] or 0) <= BROADCAST_BYTES else computed


def _bytes(field: T.StructField) -> Column:
    """Bytes of a value, as text where it is neither text nor of fixed size."""
    value = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0))
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(value))), F.lit(0))
    return F.lit(8)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1_000, size: str = "8m") -> Iterator[None]:
    """Arrow batches of bounded size for the actions inside, where a row is wide."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {name: spark.conf.get(name) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
