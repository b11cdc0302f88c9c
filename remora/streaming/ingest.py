"""Add requests as a stream: each micro-batch is merged into the next version of the store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.store import upsert
from ..sources.views import derive


def event_messages(events: DataFrame) -> DataFrame:
    """Events as messages: their type speaks, their properties are the text."""
    return derive(
        events.select(
            F.concat(F.lit("u"), "user_id").alias("user_id"),
            F.concat(F.lit("e"), F.date_format("ts", "yyyyMMdd")).alias("session_id"),
            F.col("event_id").alias("idx"),
            F.col("event_id").alias("seq"),
            F.col("event_type").alias("role"),
            F.coalesce("props", "event_type").alias("content"),
            F.col("ts").alias("created"),
        )
    )


def merge_into(path: str, keep: list[str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch writer: version n + 1 of the store is version n with the batch merged in.

    A replayed batch writes the same version again, so that each is applied once.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        old = spark.read.schema(batch.schema).parquet(f"{path}/v{epoch - 1}") if epoch else batch.limit(0)
        upsert(old, batch, keep).write.mode("overwrite").parquet(f"{path}/v{epoch}")

    return write


def ingest(spark: SparkSession, source: str, schema, target: str, checkpoint: str, files_per_trigger: int = 1000, glob: str = "*.parquet"):
    """Starts the stream over a folder of event files; stops when all that is there is in the store."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", glob).parquet(source)
    return event_messages(stream).writeStream.foreachBatch(merge_into(target, ["heat", "count", "layer", "user_id"])).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
