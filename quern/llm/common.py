"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that one task ranks together in `gapless`; hot keys are split into buckets of about this size.
BUCKET_ROWS = 1000
#: Rows to a part of a narrow table.
PART_ROWS = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A fresh folder in the cluster's shared checkpoint folder. Where none is set, as in tests, it is one of this machine's,
    if all executors are on it; a cluster without the setting is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="quern-")
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/quern/{uuid.uuid4().hex}"


def parts_of(rows: int) -> int:
    """Parts of a table of so many rows of a few numbers each."""
    return max(1, -(-rows // PART_ROWS))


def materialise(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Write `df` to the shared folder and read it back: lineage ends there, and lost executors cost no recomputation.

    If at most `rows` narrow rows are expected, it is written in as few parts as they need."""
    spark = df.sparkSession
    path = scratch(spark)
    (df if rows is None else df.coalesce(parts_of(rows))).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete the files that `frames`, made of materialised tables alone, read; they are not read again."""
    for name in {f.rsplit("/", 1)[0] for df in frames for f in df.inputFiles()}:
        if "/quern/" in name:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def gapless(df: DataFrame, key: str, buckets: Column, order: list[str], out: str) -> DataFrame:
    """Number the rows of each `key` from 0 without gaps, with no task per key.

    `buckets` says over how many parts the rows of a key are dealt. Rows are numbered inside (key, part);
    the parts' sizes, one row each, are summed per key and added.
    """
    df = df.withColumn("__part", F.pmod(F.xxhash64(*order), F.greatest(buckets, F.lit(1))).cast("int"))
    before = Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = (
        df.groupBy(key, "__part").agg(F.count(F.lit(1)).alias("__n"))
        .select(key, "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    )
    inside = Window.partitionBy(key, "__part").orderBy(*order)
    return (
        df.withColumn("__row", F.row_number().over(inside))
        .join(sizes, [key, "__part"])
        .withColumn(out, F.col("__before") + F.col("__row") - 1)
        .drop("__part", "__row", "__before")
    )
