"""Written tables in the folder that the cluster shares, for jobs in rounds."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where none is set, as in tests, one of this machine's, if all executors are
    on it. A cluster without the setting is an error: its executors would write to their own disks."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quern-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """Write `df` once and read it back, so that later rounds neither repeat it nor lose it with an executor."""
    path = f"{shared_folder(df.sparkSession)}/quern/{df.sparkSession.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def literal_rows(spark: SparkSession, names: list[str], rows: list[tuple]) -> DataFrame:
    """A frame of a few given rows, made in the plan itself: no Python worker is started for them."""
    made = (F.struct(*(F.lit(v).alias(n) for n, v in zip(names, row, strict=True))) for row in rows)
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*made)))


def numbered(df: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """Number the rows from 1 in this order, in column `name`. Rows are dealt by ranges of the order and numbered in each;
    only the sizes of the ranges, one row each, come together."""
    parts = written(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    sizes = parts.groupBy("__range").agg(F.count(F.lit(1)).alias("__size"))
    before = F.coalesce(F.sum("__size").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__range", before.alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    # One row for each part of a shuffle.
    return parts.withColumn(name, inside).join(F.broadcast(starts), "__range").withColumn(name, F.col("__before") + F.col(name)).drop("__range", "__before")
