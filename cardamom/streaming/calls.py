"""The provider-call log as a stream: duplicates dropped, metrics by window, rejects routed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: The driver's event log.
EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, schema: str = EVENTS, files_per_batch: int = 64) -> DataFrame:
    """New parquet files of a directory or glob, a bounded number of them in each batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def distinct_calls(events: DataFrame, key: str = "event_id", ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Each call once; state is kept for as long as a repeat may come late."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def windowed_metrics(events: DataFrame, ts: str = "ts", width: str = "5 minutes", late: str | None = "10 minutes") -> DataFrame:
    """start, event_type, calls, value, mean latency by tumbling window; later rows than `late` don't count."""
    if late:
        events = events.withWatermark(ts, late)
    w = events.groupBy(F.window(ts, width).alias("w"), "event_type").agg(F.count("*").alias("calls"), F.sum("value").alias("value"), F.avg("value").alias("mean"))
    return w.select(F.col("w.start").alias("start"), "event_type", "calls", "value", "mean")


def sessions(events: DataFrame, ts: str = "ts", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """user_id, start, end, calls of sessions that no gap of that length parts."""
    w = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), "user_id").agg(F.count("*").alias("calls"))
    return w.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "calls")


def run_once(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Processes what is there and stops; a second run goes on from the checkpoint, and each row is written once."""
    return df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def route(df: DataFrame, checkpoint: str, good: Callable[[DataFrame], None], bad: Callable[[DataFrame], None], is_good) -> StreamingQuery:
    """Gives the good and the other rows of each batch to two writers, which must bear a batch being given twice."""

    def both(batch: DataFrame, _: int) -> None:
        ok = F.coalesce(is_good, F.lit(False))
        good(batch.where(ok))
        bad(batch.where(~ok))

    return df.writeStream.foreachBatch(both).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
