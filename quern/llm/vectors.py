"""What the two vector searches share: usable vectors, blocks of queries and best-k merging."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of a shard and queries of a block: what one task holds at a time.
SHARD_ROWS, BLOCK_QUERIES = 4096, 1024


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", zero: bool = True) -> DataFrame:
    """(key, vector) of the rows whose vector is not null or empty and holds finite numbers only; `zero`: and may be 0.
    Floats stay floats, which are half as wide and make the same doubles later; other numbers become doubles."""
    kind = vectors.schema[vector].dataType.simpleString()
    v = F.col(vector) if kind == "array<float>" else F.col(vector).cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.select(F.col(key).cast("long").alias(key), v.alias(vector)).where(F.col(key).isNotNull() & (F.size(vector) > 0) & F.forall(vector, finite))
    return rows if zero else rows.where(F.exists(vector, lambda x: x != 0))


def dealt(column: str, parts: int, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), column), F.lit(parts)).cast("int")


def best(found: DataFrame, k: int, score: str) -> DataFrame:
    """The k highest of each query with their rank, ties to the smaller vec_id."""
    order = Window.partitionBy("query_id").orderBy(F.desc(score), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def matrix(values, width: int | None = None) -> np.ndarray:
    """A matrix of the vectors, longer ones cut and shorter ones filled with zeros where `width` is given."""
    rows = [np.asarray(v, dtype=np.float64) for v in values]
    width = width if width is not None else max(map(len, rows), default=0)
    if all(len(r) == width for r in rows):
        return np.stack(rows) if rows else np.zeros((0, width))
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r[:width]
    return out
