"""The interval statistics on streams: event time, watermarks, and windows that slide or follow sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.intervals import measures

_LENGTH = {"second": "1 second", "minute": "1 minute", "hour": "1 hour", "day": "1 day", "week": "1 week"}


def read(spark: SparkSession, path: str, like: DataFrame, most_files: int = 100) -> DataFrame:
    """A stream of the Parquet files of a folder, with the columns of `like`."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", most_files).parquet(path)


def _timed(stream: DataFrame, ts: str, late: str) -> DataFrame:
    """The stream with its watermark; times without a zone are taken as the session's."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def _flat(df: DataFrame, window: str = "window") -> DataFrame:
    return df.select(F.col(f"{window}.start").alias("start"), F.col(f"{window}.end").alias("end"), *(c for c in df.columns if c != window))


def tumbling(stream: DataFrame, unit: str, value: str | None = None, late: str = "1 hour", ts: str = "ts", by: tuple[str, ...] = ()) -> DataFrame:
    """Statistics of intervals; a record counts in the interval of its own time, if it is no later than `late`. Weeks
    begin on Monday."""
    offset = "4 days" if unit == "week" else None
    window = F.window(ts, _LENGTH[unit], _LENGTH[unit], offset) if offset else F.window(ts, _LENGTH[unit])
    return _flat(_timed(stream, ts, late).groupBy(window, *by).agg(*measures(value)))


def sliding(stream: DataFrame, length: str, step: str, value: str | None = None, late: str = "1 hour", ts: str = "ts") -> DataFrame:
    return _flat(_timed(stream, ts, late).groupBy(F.window(ts, length, step)).agg(*measures(value)))


def sessions(stream: DataFrame, key: str, gap: str, value: str | None = None, late: str = "1 hour", ts: str = "ts") -> DataFrame:
    """Statistics of the runs of a key's records that are less than `gap` apart."""
    return _flat(_timed(stream, ts, late).groupBy(F.session_window(ts, gap), key).agg(*measures(value)), "session_window")


def group_counts(stream: DataFrame, unit: str, group: str, late: str = "1 hour", ts: str = "ts") -> DataFrame:
    return _flat(_timed(stream, ts, late).groupBy(F.window(ts, _LENGTH[unit]), F.col(group).alias("group")).agg(F.count(F.lit(1)).alias("n")))


def unique_estimates(stream: DataFrame, unit: str, value: str, late: str = "1 hour", ts: str = "ts") -> DataFrame:
    return _flat(_timed(stream, ts, late).groupBy(F.window(ts, _LENGTH[unit])).agg(F.approx_count_distinct(value, 0.01).alias("n")))


def write(df: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Start writing finished intervals as Parquet; a restart goes on from the checkpoint."""
    return df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).format("parquet").trigger(availableNow=True).start(path)
