"""Streaming forms of the event log and of crawl progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def running_counts(events: DataFrame) -> DataFrame:
    """Events by type since the start; for output modes complete and update."""
    return events.groupBy("event_type").agg(F.count("*").alias("n"))


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by type and window of event time; rows later than the watermark do not count."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Write what there is as Parquet, exactly once a checkpoint, and end."""
    stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def coalesce_progress(events: DataFrame, key: str = "job", ts: str = "ts", status: str = "status", gap_ms: int = 250) -> DataFrame:
    """What a watcher is shown: of each job, an event at most every gap_ms, and its first terminal one, after which nothing.

    State is the time last shown and whether the job has ended, for each job.
    """
    import pandas as pd

    schema = events.schema

    def show(name, frames, state):
        last, ended = state.get if state.exists else (-(2**62), False)
        for frame in frames:
            rows = []
            for _, row in frame.sort_values(ts).iterrows():
                at = int(row[ts].value // 1_000_000)
                terminal = row[status] in ("completed", "failed", "cancelled")
                if not ended and (terminal or at - last >= gap_ms):
                    rows.append(row)
                    last, ended = at, terminal
            yield pd.DataFrame(rows, columns=frame.columns)
        state.update((last, ended))

    return events.groupBy(key).applyInPandasWithState(show, schema, "last long, ended boolean", "append", "NoTimeout")
