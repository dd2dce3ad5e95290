"""Statistics of events by intervals of time, in batches and streams."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import functions as F

from quern.operators import intervals
from quern.plans.base import query
from quern.sources.files import table
from quern.sources.shared import shared_folder
from quern.streaming import intervals as streams

_MEASURES = "count(*) AS rows, count(value) AS n, round(sum(value), 6) AS total, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high"


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events")


def _naive(df):
    """Starts without a zone, as the events' times are; sums rounded, as their order is open."""
    df = df.withColumns({c: F.round(c, 6) for c in ("total", "mean") if c in df.columns})
    return df.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(f"SELECT date_trunc('hour', ts) AS start, {_MEASURES} FROM events GROUP BY 1")
def i_hourly(spark, sf_dir):
    return _naive(intervals.statistics(_events(spark, sf_dir), "hour", "value"))


@query(f"SELECT date_trunc('day', ts) AS start, event_type, {_MEASURES} FROM events GROUP BY 1, 2")
def i_daily_by_type(spark, sf_dir):
    return _naive(intervals.statistics(_events(spark, sf_dir), "day", "value", by=["event_type"]))


@query("SELECT date_trunc('week', ts - INTERVAL 6 DAY) + INTERVAL 6 DAY AS start, count(*) AS rows FROM events GROUP BY 1")
def i_weeks_from_sunday(spark, sf_dir):
    return _naive(intervals.statistics(_events(spark, sf_dir), "week", first_weekday=6))


@query("""WITH c AS (SELECT date_trunc('day', ts) AS start, event_type AS "group", count(*) AS n FROM events GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY start ORDER BY n DESC, "group") AS k FROM c) SELECT start, "group", n FROM r WHERE k <= 3""")
def i_top_groups(spark, sf_dir):
    return _naive(intervals.group_counts(_events(spark, sf_dir), "day", "event_type", top=3))


@query("""WITH c AS (SELECT date_trunc('month', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2)
SELECT start, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS groups FROM c GROUP BY start""")
def i_group_maps(spark, sf_dir):
    found = intervals.group_map(intervals.group_counts(_events(spark, sf_dir), "month", "event_type"))
    entries = F.transform(F.array_sort(F.map_entries("groups")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return _naive(found.select("start", F.array_join(entries, ",").alias("groups")))


@query("SELECT date_trunc('day', ts) AS start, count(DISTINCT user_id) AS n FROM events GROUP BY 1")
def i_unique(spark, sf_dir):
    return _naive(intervals.unique_counts(_events(spark, sf_dir), "day", "user_id"))


@query()
def i_unique_estimate(spark, sf_dir):
    return _naive(intervals.combine_estimates(intervals.unique_estimates(_events(spark, sf_dir), "hour", "user_id"), "day").select("start", "n"))


@query("SELECT date_trunc('day', ts) AS start, count(*) AS rows, count(value) AS n, round(sum(value), 6) AS total, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high FROM events GROUP BY 1")
def i_combine(spark, sf_dir):
    days = intervals.combine(intervals.statistics(_events(spark, sf_dir), "hour", "value"), "day")
    return _naive(days.select("start", "rows", "n", "total", "mean", "low", "high"))


@query("""WITH s AS (SELECT date_trunc('minute', ts) AS start, count(*) AS rows FROM events GROUP BY 1),
e AS (SELECT unnest(generate_series((SELECT min(start) FROM s), (SELECT max(start) FROM s), INTERVAL 1 MINUTE)) AS start)
SELECT e.start, s.rows, s.rows IS NOT NULL AS has_value FROM e LEFT JOIN s ON s.start = e.start""")
def i_fill_blanks(spark, sf_dir):
    return _naive(intervals.fill_blanks(intervals.statistics(_events(spark, sf_dir), "minute"), "minute"))


@query("""SELECT date_trunc('hour', ts) AS start, count(*) AS rows FROM events WHERE ts < TIMESTAMP '2024-01-15 10:00' GROUP BY 1
UNION ALL SELECT TIMESTAMP '2024-01-15 10:00', count(*) FROM events WHERE ts >= TIMESTAMP '2024-01-15 09:25' AND ts < TIMESTAMP '2024-01-15 10:25'""")
def i_estimate_now(spark, sf_dir):
    events = _events(spark, sf_dir)
    return _naive(intervals.estimate_now(events, intervals.statistics(events, "hour"), "hour", datetime(2024, 1, 15, 10, 25)))


@query("""WITH s AS (SELECT date_trunc('hour', ts) AS start, count(*) AS rows FROM events GROUP BY 1)
SELECT start, rows FROM s WHERE start >= (SELECT max(start) FROM s) - INTERVAL 47 HOUR""")
def i_retention(spark, sf_dir):
    return _naive(intervals.retain(intervals.statistics(_events(spark, sf_dir), "hour"), "hour"))


def _run(spark, sf_dir, make):
    """The finished table of a stream over the events' file. Each batch writes the whole table anew, so that intervals the
    watermark has not passed at the end are in it too."""
    like = _events(spark, sf_dir)
    # A pattern: a path without one has to be a folder, and events may be a file or a folder of files.
    stream = spark.readStream.schema(like.schema).parquet(f"{sf_dir}/events.parque[t]")
    path = f"{shared_folder(spark)}/quern/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    made, last = make(stream), []

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        last[:] = [number]

    writer = made.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{path}/checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema(made.schema).parquet(f"{path}/batch={last[0]}") if last else spark.createDataFrame([], made.schema)
    return _naive(found)


@query("SELECT date_trunc('hour', ts) AS start, count(*) AS rows, round(sum(value), 6) AS total FROM events GROUP BY 1")
def stream_tumbling(spark, sf_dir):
    found = _run(spark, sf_dir, lambda s: streams.tumbling(s, "hour", "value"))
    return found.select("start", "rows", "total")


@query("""SELECT w AS start, count(*) AS rows FROM events, (SELECT unnest(generate_series(TIMESTAMP '2023-12-31', TIMESTAMP '2024-02-01', INTERVAL 6 HOUR)) AS w)
WHERE ts >= w AND ts < w + INTERVAL 12 HOUR GROUP BY w""")
def stream_sliding(spark, sf_dir):
    return _run(spark, sf_dir, lambda s: streams.sliding(s, "12 hours", "6 hours")).select("start", "rows")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, fresh DESC ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS rows FROM s GROUP BY user_id, k""")
def stream_sessions(spark, sf_dir):
    return _run(spark, sf_dir, lambda s: streams.sessions(s, "user_id", "6 hours")).select("user_id", "start", "rows")


@query('SELECT date_trunc(\'day\', ts) AS start, event_type AS "group", count(*) AS n FROM events GROUP BY 1, 2')
def stream_groups(spark, sf_dir):
    return _run(spark, sf_dir, lambda s: streams.group_counts(s, "day", "event_type")).select("start", "group", "n")
