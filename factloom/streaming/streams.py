"""The same state over Structured Streaming: deduplication, Tokyo-day metrics, lifecycle, and a sink of versions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from factloom.operators.tables import BucketTable

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events(spark: SparkSession, folder: str, schema: str = EVENTS, files_a_trigger: int = 100) -> DataFrame:
    """A stream of the Parquet files of a folder; event time gets a zone, as watermarks need one."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def once(stream: DataFrame, key: str, delay: str = "3 days") -> DataFrame:
    """Each key once, however often it is sent within the delay; state is dropped behind the watermark."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def daily_metrics(stream: DataFrame, delay: str | None = "1 day") -> DataFrame:
    """Counts by Tokyo day, which begins at 15:00 UTC. delay: none if the stream has its watermark already."""
    day = F.window("ts", "1 day", "1 day", "15 hours")
    counted = (stream.withWatermark("ts", delay) if delay else stream).groupBy(day.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return counted.select(F.to_date(F.col("w.start") + F.expr("interval 9 hours")).alias("day"), "event_type", "n", "total")


def sessions(stream: DataFrame, gap: str = "30 minutes", delay: str = "1 day") -> DataFrame:
    return stream.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("began"), F.col("w.end").alias("ended"), "n")


LIFECYCLE = "stable_key string, state string, missing_count int, counted_at timestamp"


def _advance(required: int, interval_s: int):
    def run(key: tuple, batches: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        state, count, counted = kept.get if kept.exists else ("active", 0, None)
        for row in pd.concat(list(batches)).sort_values("at").itertuples():
            if row.present:
                state, count, counted = "active", 0, None
            elif counted is None or (row.at - counted).total_seconds() >= interval_s:
                count += 1
                counted = row.at
                state = "closed" if count >= required else "suspect"
        kept.update((state, count, counted))
        yield pd.DataFrame({"stable_key": [key[0]], "state": [state], "missing_count": [count], "counted_at": [counted]})

    return run


def lifecycle(stream: DataFrame, required: int = 3, interval_hours: int = 12) -> DataFrame:
    """Lifecycle rows for every key of a batch from a stream of stable_key, at, present (one row a key and snapshot)."""
    return stream.groupBy("stable_key").applyInPandasWithState(_advance(required, interval_hours * 3600), LIFECYCLE, "state string, missing_count int, counted_at timestamp", "update", GroupStateTimeout.NoTimeout)


def merge_batches(root: str, key: str, order: str, buckets: int = 256):
    """For foreachBatch: merges each batch into the table under root; the newest row of a key wins.

    Only the buckets that a batch meets are read and written. A batch that runs again writes the same rows, and readers see whole versions.
    """

    def run(batch: DataFrame, _: int) -> None:
        def newest(old: DataFrame, new: DataFrame) -> DataFrame:
            rows = old.unionByName(new)
            return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), order).alias("x")).select("x.*")

        BucketTable(batch.sparkSession, root, [key], buckets).change(batch, newest)

    return run
