"""Streams: a live view of a run log, and enrichment of rows as they arrive."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.runlog import SCHEMA


def stream_run_log(spark: SparkSession, folder: str, files: int = 1000) -> DataFrame:
    """A log's records as a stream, at most ``files`` new files a trigger."""
    return spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files).json(f"{folder}/events")


def live_counts(records: DataFrame) -> DataFrame:
    """Rows by step and status so far."""
    return records.where("type = 'row_complete'").groupBy("step", "status").agg(F.count(F.lit(1)).alias("rows"))


def enrich_stream(rows: DataFrame, pipeline: Any, config: Any, sink: Callable[[DataFrame, int], None], checkpoint: str, row_key: str | None = None, **options: str) -> StreamingQuery:
    """Run a pipeline over each micro-batch; rows seen before are answered from the cache. ``sink`` gets the batch's data and number.

    A batch that runs again after a failure has the same number, so a sink that overwrites by it writes each row once.
    """

    def each(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            result = pipeline.run(batch, config, row_key=row_key, spark=batch.sparkSession)
            sink(result.data, number)
            result.close()

    out = rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (out.trigger(**options) if options else out.trigger(availableNow=True)).start()
