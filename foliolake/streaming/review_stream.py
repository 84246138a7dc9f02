"""The review queue as streams: last states, idempotent operations, append-only history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliolake.sources.shared import scratch


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """Event files as a stream; the path is a glob, which may match files or folders."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(path)


def last_states(events: DataFrame) -> DataFrame:
    """Each client's last status and number of events, updated as events come; late ones don't take it back."""
    last = F.max_by("status", F.struct("created_at", "event_id"))
    return events.groupBy("client_id").agg(last.alias("status"), F.count("*").alias("events"), F.max("created_at").alias("updated_at"))


def first_operations(events: DataFrame, operation: str, at: str = "created_at", delay: str | None = None) -> DataFrame:
    """Only the first event of each operation passes, however late another comes.

    With a ``delay``, ids are forgotten once the watermark has passed them by it,
    so the state stays small; later events are dropped, and an id that comes back
    after that passes again.
    """
    if delay is None:
        return events.dropDuplicates([operation])
    return events.withWatermark(at, delay).dropDuplicatesWithinWatermark([operation])


def run_to_end(stream: DataFrame, purpose: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there now and returns what it put out, with its batch numbers."""
    spark = stream.sparkSession
    out, checkpoint = scratch(spark, purpose), scratch(spark, f"{purpose}-checkpoint")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")  # a batch that runs again writes its folder again

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    writer.foreachBatch(put).start().awaitTermination()
    return spark.read.parquet(out)
