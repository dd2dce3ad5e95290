"""Sharding by jump consistent hashing: a key and the number of shards decide, with no ring table.

Adding a shard moves only 1/(n+1) of the keys, all of them into the new shard.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import BUCKET_ROWS, gapless, materialise, table

SHARDS = 16


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Jump consistent hash (Lamping and Veach, 2014) of unsigned 64-bit keys, all keys at once."""
    key = keys.astype(np.uint64)
    at = np.zeros(len(key), dtype=np.int64)
    live = np.arange(len(key))
    while len(live):
        key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
        step = (key[live] >> np.uint64(33)).astype(np.float64) + 1.0
        to = ((at[live] + 1) * (float(1 << 31) / step)).astype(np.int64)
        live, to = live[to < shards], to[to < shards]
        at[live] = to
    return at


def assign(df: DataFrame, key: str, shards: int, out: str = "shard", grown: str | None = None) -> DataFrame:
    """Add the shard of each row's key, and with `grown` the shard it would have among one more.

    Keys are hashed as strings by xxhash64, so equal keys of any integer type agree; a null key is a key like any
    other. `shards` must be positive. Existing columns named `out` or `grown` are replaced.
    """
    if shards < 1:
        raise ValueError("shards must be positive")

    @F.pandas_udf("now int, more int")
    def place(hashed: pd.Series) -> pd.DataFrame:
        keys = hashed.to_numpy(dtype=np.int64).view(np.uint64)
        return pd.DataFrame({"now": jump(keys, shards).astype(np.int32), "more": jump(keys, shards + 1).astype(np.int32)})

    df = df.withColumn("__at", place(F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("\0null")))))
    df = df.withColumn(out, F.col("__at.now"))
    return (df.withColumn(grown, F.col("__at.more")) if grown else df).drop("__at")


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Shard documents by doc_id and number each shard's rows from 0.

    Sizes are UTF-8 bytes plus 1; a null text has size 1 and checksum 0. Repeated rows go to the same shard with
    slots of their own. An empty table gives no rows.
    """
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.encode("text", "UTF-8")), F.lit(0)).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    placed = materialise(assign(rows, "doc_id", shards, "shard", "grown_shard"))
    parts = max(1, placed.count() // (shards * BUCKET_ROWS))
    return gapless(placed, "shard", F.lit(parts), ["doc_id", "text_crc32", "size"], "slot")


def op3_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )
