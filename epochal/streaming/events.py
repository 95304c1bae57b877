"""Structured Streaming over the events table: beyond the batch operators, each equal to a batch result on the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """New parquet files of a folder as a stream; ts as an event-time timestamp."""
    s = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, size: str = "1 day", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Counts and sums in tumbling (or sliding) windows; rows later than the watermark are dropped."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    g = events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type")
    return g.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    g = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return g.agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def deduplicated(events: DataFrame, late: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def closed_states(events: DataFrame) -> DataFrame:
    """The interval of a user's state, put out when the user's next event closes it.

    Rows of a trigger are taken in order of (ts, event_id); an event older than the open one is not reopened.
    """

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        open_ = state.get if state.exists else None
        out = []
        for r in pd.concat(list(pdfs)).sort_values(["ts", "event_id"]).itertuples():
            if open_ is not None and r.ts.value // 1000 >= open_[1]:
                out.append((key[0], open_[0], pd.Timestamp(open_[1] * 1000), r.ts))
            if open_ is None or r.ts.value // 1000 >= open_[1]:
                open_ = (r.event_type, r.ts.value // 1000)
        if open_ is not None:
            state.update(open_)
        yield pd.DataFrame(out, columns=["user_id", "event_type", "start", "end"])

    return events.groupBy("user_id").applyInPandasWithState(
        step, "user_id long, event_type string, start timestamp, end timestamp", "event_type string, since long", "append", GroupStateTimeout.NoTimeout
    )


def run_available(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there into a memory table, for tests and small results."""
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def append_with_resume(df: DataFrame, path: str, checkpoint: str):
    """Micro-batches appended to parquet; a restart goes on where the checkpoint stands (O259)."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
