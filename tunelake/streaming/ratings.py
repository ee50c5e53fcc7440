"""Ratings that arrive as files: each batch becomes rows of the rating plan."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tunelake.operators.playlists import rating_sync

#: The state store that keyed state with timers needs.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
LAST = "path string, file_stars int, at timestamp, live boolean"


def changes(spark: SparkSession, folder: str, schema: str = "path string, file_stars int, at timestamp", late: str = "1 day") -> DataFrame:
    """New rating files as a stream; a repeated row within the lateness counts once."""
    return spark.readStream.schema(schema).parquet(folder).withWatermark("at", late).dropDuplicatesWithinWatermark(["path", "file_stars"])


def run_plan(stream: DataFrame, tracks: DataFrame, sink: str, checkpoint: str, to_files: bool = False, seen: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Join each batch with the tracks and append its plan, by batch, to a Parquet folder: a repeated batch overwrites itself."""

    def batch(df: DataFrame, number: int) -> None:
        plan = rating_sync(df, tracks, to_files)
        plan.write.mode("overwrite").parquet(f"{sink}/batch={number}")
        if seen:
            seen(plan, number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rate_windows(stream: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Ratings for each window of time: count and mean."""
    return stream.withWatermark("at", late).groupBy(F.window("at", width)).agg(F.count("*").alias("n"), F.avg("file_stars").alias("stars"))


class LastRating(StatefulProcessor):
    """The last rating of each path, which expires so long after it was given; a row whenever either happens."""

    def __init__(self, age_ms: int):
        self.age_ms = age_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "file_stars int, at timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  (Spark's names)
        best = self.last.get() if self.last.exists() else None
        before = best
        for part in rows:
            newest = part.sort_values(["at", "file_stars"]).iloc[-1]
            if best is None or newest["at"] > pd.Timestamp(best[1]):
                best = (int(newest["file_stars"]), newest["at"].to_pydatetime())
        if best is not before:
            self.last.update(best)
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(int(pd.Timestamp(best[1]).timestamp() * 1000) + self.age_ms)
            yield pd.DataFrame({"path": [key[0]], "file_stars": [best[0]], "at": [pd.Timestamp(best[1])], "live": [True]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        stars, at = self.last.get()
        self.last.clear()
        yield pd.DataFrame({"path": [key[0]], "file_stars": [stars], "at": [pd.Timestamp(at)], "live": [False]})

    def close(self) -> None:
        pass


def last_ratings(stream: DataFrame, sink: str, checkpoint: str, age: str = "12 hours", late: str = "1 hour") -> StreamingQuery:
    """Append to a Parquet folder what becomes of each path's last rating: a newer one (live), or that it expired.

    State is one rating a path, with a timer at its age; rows behind the watermark by more than the lateness are dropped.
    """
    spark = stream.sparkSession
    spark.conf.set(*STORE)
    kept = stream.select("path", "file_stars", "at").withWatermark("at", late).groupBy("path").transformWithStateInPandas(LastRating(int(pd.Timedelta(age).total_seconds() * 1000)), LAST, "Append", "EventTime")
    return kept.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def settled(changes: DataFrame) -> DataFrame:
    """(path, file_stars, at, live): the last word on each path."""
    word = F.struct("at", (~F.col("live")).alias("gone"), "file_stars", "live")
    return changes.groupBy("path").agg(F.max(word).alias("w")).select("path", "w.file_stars", "w.at", "w.live")
