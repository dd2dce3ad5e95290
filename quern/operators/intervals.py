"""Statistics of logs by intervals of time: what is counted, summed and merged."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNITS = ("second", "minute", "hour", "day", "week", "month")
#: Intervals of each unit that are kept; fixed values.
KEEP = {"second": 60, "minute": 60, "hour": 48, "day": 60, "week": 52, "month": 60}
TOP_GROUPS = 50
_STEP = {"second": "INTERVAL 1 SECOND", "minute": "INTERVAL 1 MINUTE", "hour": "INTERVAL 1 HOUR", "day": "INTERVAL 1 DAY", "week": "INTERVAL 7 DAYS", "month": "INTERVAL 1 MONTH"}


def floor(ts: Column, unit: str, first_weekday: int = 0) -> Column:
    """The start of the interval that a time is in; weeks begin at `first_weekday`, 0 for Monday."""
    if unit not in UNITS:
        raise ValueError(f"unknown interval {unit}")
    if unit != "week" or not first_weekday:
        return F.date_trunc(unit, ts)
    shift = F.make_dt_interval(F.lit(first_weekday))
    return F.date_trunc("week", ts - shift) + shift


def start_of(df: DataFrame, unit: str, ts: str = "ts", first_weekday: int = 0, by: Iterable[str] = ()):
    return df.groupBy(floor(F.col(ts), unit, first_weekday).alias("start"), *by)


def measures(value: str | None) -> list[Column]:
    """rows, and of a value: count, sum, mean (0 if there is none), least and greatest."""
    out = [F.count(F.lit(1)).alias("rows")]
    if value:
        out += [F.count(value).alias("n"), F.coalesce(F.sum(value), F.lit(0)).alias("total"), F.coalesce(F.avg(value), F.lit(0.0)).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high")]
    return out


def statistics(df: DataFrame, unit: str, value: str | None = None, ts: str = "ts", by: Iterable[str] = (), first_weekday: int = 0) -> DataFrame:
    """One row for each interval that has records."""
    return start_of(df, unit, ts, first_weekday, by).agg(*measures(value))


def group_counts(df: DataFrame, unit: str, group: str, ts: str = "ts", top: int = TOP_GROUPS) -> DataFrame:
    """(start, group, n): the most frequent values of each interval, ties in order of the value."""
    counts = df.where(F.col(group).isNotNull()).groupBy(floor(F.col(ts), unit).alias("start"), F.col(group).alias("group")).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("start").orderBy(F.desc("n"), "group")
    return counts.withColumn("__k", F.row_number().over(order)).where(F.col("__k") <= top).drop("__k")


def group_map(counts: DataFrame) -> DataFrame:
    """(start, groups): the counts of an interval as a map."""
    return counts.groupBy("start").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("group", "n")))).alias("groups"))


def unique_counts(df: DataFrame, unit: str, value: str, ts: str = "ts") -> DataFrame:
    """(start, n) exactly: each interval's values are made distinct first, so that no task holds an interval's values."""
    return df.select(floor(F.col(ts), unit).alias("start"), F.col(value).alias("v")).where("v is not null").distinct().groupBy("start").agg(F.count(F.lit(1)).alias("n"))


def unique_estimates(df: DataFrame, unit: str, value: str, ts: str = "ts") -> DataFrame:
    """(start, sketch, n): HyperLogLog sketches, which `combine_estimates` can merge."""
    found = start_of(df, unit, ts).agg(F.hll_sketch_agg(F.col(value), F.lit(14)).alias("sketch"))
    return found.withColumn("n", F.hll_sketch_estimate("sketch"))


def combine(stats: DataFrame, unit: str, first_weekday: int = 0) -> DataFrame:
    """Merge statistics of finer intervals into coarser ones; the mean from sums and counts."""
    merged = stats.groupBy(floor(F.col("start"), unit, first_weekday).alias("start")).agg(
        F.sum("rows").alias("rows"), F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high")
    )
    mean = F.when(F.col("n") > 0, F.col("total") / F.col("n")).otherwise(0.0)
    return merged.select("start", "rows", "n", "total", mean.alias("mean"), "low", "high")


def combine_groups(counts: DataFrame, unit: str, top: int = TOP_GROUPS) -> DataFrame:
    merged = counts.groupBy(floor(F.col("start"), unit).alias("start"), "group").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("start").orderBy(F.desc("n"), "group")
    return merged.withColumn("__k", F.row_number().over(order)).where(F.col("__k") <= top).drop("__k")


def combine_estimates(sketches: DataFrame, unit: str) -> DataFrame:
    merged = sketches.groupBy(floor(F.col("start"), unit).alias("start")).agg(F.hll_union_agg("sketch").alias("sketch"))
    return merged.withColumn("n", F.hll_sketch_estimate("sketch"))


def fill_blanks(stats: DataFrame, unit: str, start: datetime | None = None, end: datetime | None = None, first_weekday: int = 0) -> DataFrame:
    """All intervals from the first to the last, or from `start` up to `end`, with `has_value`; numbers of blanks are null."""
    first = F.lit(start) if start is not None else F.min("start")
    last = F.lit(end) - F.expr("INTERVAL 1 MICROSECOND") if end is not None else F.max("start")
    span = stats.agg(floor(first, unit, first_weekday).alias("a"), floor(last, unit, first_weekday).alias("b")).where("a is not null and a <= b")
    every = span.select(F.explode(F.sequence("a", "b", F.expr(_STEP[unit]))).alias("start"))
    return every.join(stats.withColumn("has_value", F.lit(True)), "start", "left").withColumn("has_value", F.coalesce("has_value", F.lit(False)))


def estimate_now(df: DataFrame, stats: DataFrame, unit: str, now: datetime, value: str | None = None, ts: str = "ts") -> DataFrame:
    """Statistics whose last, open interval is replaced by the records of one interval's length up to `now`."""
    length = {"second": timedelta(seconds=1), "minute": timedelta(minutes=1), "hour": timedelta(hours=1), "day": timedelta(days=1), "week": timedelta(days=7), "month": timedelta(days=30)}[unit]
    recent = df.where((F.col(ts) >= F.lit(now - length)) & (F.col(ts) < F.lit(now))).agg(*measures(value)).select(floor(F.lit(now), unit).alias("start"), "*")
    return stats.where(F.col("start") < floor(F.lit(now), unit)).unionByName(recent)


def retain(stats: DataFrame, unit: str, resolution: int = 1) -> DataFrame:
    """The newest intervals, as many as are kept of the unit."""
    newest = stats.agg(F.max("start").alias("__newest"))
    first = F.col("__newest") - F.expr(f"{KEEP[unit] * resolution - 1} * {_STEP[unit]}" if unit != "month" else f"INTERVAL {KEEP[unit] * resolution - 1} MONTH")
    return stats.join(F.broadcast(newest), stats["start"] >= first).drop("__newest")  # one row
