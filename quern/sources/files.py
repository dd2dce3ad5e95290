"""Reading and writing node frames: Parquet, JSON lines, and slices of logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def extract(log: DataFrame, start, end, skip: int = 0, take: int | None = None, descending: bool = False, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Log records from `start` up to but without `end`, in the order of time."""
    order = [F.desc(ts), F.desc(tie)] if descending else [F.asc(ts), F.asc(tie)]
    found = log.where((F.col(ts) >= F.lit(start)) & (F.col(ts) < F.lit(end))).orderBy(*order).offset(skip)
    return found if take is None else found.limit(take)


def json_rows(df: DataFrame, name: str = "json") -> DataFrame:
    """Each row as a JSON object."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(name))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files as rows (path, modificationTime, length, content); content is read only if it is used."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def embedded(column: Column, path: str) -> Column:
    """A value inside an owned object that is held as JSON text."""
    return F.get_json_object(column, path)
