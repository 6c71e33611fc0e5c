"""Event streams: windows with watermarks, deduplication, running state per user."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LATE = "10 minutes"
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, per_trigger: int = 1) -> DataFrame:
    """A stream of event files; late rows are counted up to ``LATE`` behind the newest."""
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", per_trigger).option("pathGlobFilter", "events*.parquet").parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATE)


def hourly(events: DataFrame) -> DataFrame:
    """Counts and sums by hour and type."""
    g = events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 days") -> DataFrame:
    """Runs of a user's events without a longer gap."""
    g = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def unique(events: DataFrame) -> DataFrame:
    """Each event id once, as long as repeats come within the watermark."""
    return events.dropDuplicatesWithinWatermark(["event_id"])


def running_mean(events: DataFrame, rate: float = 0.1, fade: float = 0.01) -> DataFrame:
    """``(user_id, n, ema)`` after each batch: values in time order, the rate falling as rate / (1 + fade * n)."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, ema = state.get if state.exists else (0, 0.0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for v in rows["value"]:
            ema = v if n == 0 else ema + rate / (1 + fade * n) * (v - ema)
            n += 1
        state.update((n, float(ema)))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "ema": [float(ema)]})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, n long, ema double", "n long, ema double", "update", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now and return its rows.

    Appended rows go to the shared folder, a folder for each batch, however many they are;
    other modes keep a memory table, whose rows are counts and states, not events.
    """
    spark, rows = stream.sparkSession, f"{checkpoint}/rows"
    out = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode != "append":
        out.format("memory").queryName(name).start().awaitTermination()
        return spark.table(name)
    spark.createDataFrame([], stream.schema).write.parquet(f"{rows}/none")  # so that a stream without rows has a table as well
    out.foreachBatch(lambda df, batch: df.write.mode("overwrite").parquet(f"{rows}/{batch}")).start().awaitTermination()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(rows)
