"""Continuous behaviours as Structured Streaming jobs over growing folders of Parquet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import mask_matches
from ..operators.catalog import status_upsert


def feed(spark: SparkSession, path: str, schema, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(path)


def activities(entries: DataFrame, mask: int) -> DataFrame:
    """Entries that match a mask, as they come."""
    return entries.where(mask_matches(F.col("action"), mask))


def last_status(stream: DataFrame, path: str, checkpoint: str):
    """Keeps a table of each host's status: every micro-batch is merged into the table of the one before, by the rules of status_upsert.

    The table has a row for each server, and each batch's is a new folder, so a batch that is repeated writes the same again.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        old = spark.read.schema(batch.schema).parquet(f"{path}/{batch_id - 1}") if batch_id else batch.limit(0)
        status_upsert(old.unionByName(batch), keep_seq=True).write.mode("overwrite").parquet(f"{path}/{batch_id}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress(stream: DataFrame, seconds: int = 60, late: str = "10 minutes") -> DataFrame:
    """Tumbling windows of work per host; the watermark is ours, the log itself knows no late data."""
    return (
        stream.withWatermark("ts", late).groupBy(F.window("ts", f"{seconds} seconds").alias("w"), "host")
        .agg(F.count("*").alias("n"), F.sum("amount").alias("amount")).select("host", F.col("w.start").alias("start"), "n", "amount")
    )


def latencies(sends: DataFrame, answers: DataFrame, wait: str = "10 minutes") -> DataFrame:
    """Stream-stream join of sends and answers by callback; unanswered sends are dropped after the wait."""
    s, a = sends.withWatermark("send_time", wait).alias("s"), answers.withWatermark("answer_time", wait).alias("a")
    on = (F.col("s.callback") == F.col("a.callback")) & F.col("a.answer_time").between(F.col("s.send_time"), F.col("s.send_time") + F.expr(f"INTERVAL {wait}"))
    millis = F.unix_millis("a.answer_time") - F.unix_millis("s.send_time")
    return s.join(a, on).select("s.callback", "s.host", millis.alias("millis"))


def run_once(df: DataFrame, sink: Callable, checkpoint: str, mode: str = "append") -> None:
    """Process what there is, in micro-batches, then stop."""
    df.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def collected(df: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """The stream's output so far as a table."""
    df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)
