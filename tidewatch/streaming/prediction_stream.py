"""Prediction logs as a file stream: each micro-batch is loaded and checked like a batch run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewatch.plans.bulk import run_and_store
from tidewatch.plans.ingest import ingest_predictions
from tidewatch.sources.files import plain_path
from tidewatch.sources.tables import Store

# Schema of the binary file source.
FILE_SCHEMA = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"


def stream_predictions(
    store: Store,
    folder: str,
    checkpoint: str,
    route: Callable[[DataFrame], DataFrame],
    requests: Callable[[DataFrame], DataFrame],
    stamp: Callable[[], Column] = F.current_timestamp,
    files_per_batch: int = 1000,
) -> StreamingQuery:
    """Load every new log under ``folder`` and run its health check, then stop.

    ``route`` adds project_id and model_version_id to a table of paths; ``requests`` turns
    stored batches into check requests. A repeated micro-batch stores nothing twice: the content
    guard refuses files it has seen and row partitions are overwritten. Checks are asked for all
    stored batches of the micro-batch, those that an earlier attempt stored included; jobs that
    exist are not queued again and open ones are run. A micro-batch has at most
    ``files_per_batch`` files, whose paths pass through the driver.
    """
    files = (
        store.spark.readStream.format("binaryFile")
        .schema(FILE_SCHEMA)
        .option("maxFilesPerTrigger", files_per_batch)
        .option("pathGlobFilter", "*.csv")
        .load(folder)
    )

    def process(batch: DataFrame, _: int) -> None:
        at = stamp()
        uploads = batch.select(plain_path(F.col("path")).alias("path"))
        places = [row["path"] for row in batch.select("path").collect()]
        load = ingest_predictions(store, route(uploads), at, places)
        ids = load.accepted.select("id").union(load.known)
        run_and_store(store, requests(store.read("prediction_batches").join(ids, "id", "left_semi")), at)

    return (
        files.select("path")
        .writeStream.foreachBatch(process)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
