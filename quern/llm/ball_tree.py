"""Exact top-k search by inner product: ball-tree branch and bound in shards that share the kth score.

Vectors are dealt into shards of bounded size; a ball tree is built on each. A query visits nodes in the order of
their upper bound, q.centre + |q| radius, and stops where no node can hold a score as high as its kth. It starts in
one shard, and the kth score found there is where all other shards start from.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import materialise, table
from quern.llm.vectors import BLOCK_QUERIES, best, dealt, matrix, usable

SHARD_ROWS, LEAF = 2048, 128
LEVELS, QUERY_STEP, K = 256, 50, 5
FOUND = "query_id long, vec_id long, score long"

ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id,
         CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * v.e[i])) AS BIGINT) AS score
  FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, vec_id, score,
         CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers: in floats where these hold them exactly, else in Python's integers."""
    if a.shape[1] * np.abs(a).max(initial=0) * np.abs(b).max(initial=0) < 2**53:
        return (a @ b.T).astype(np.int64)
    to_int = np.vectorize(int, otypes=[object])
    return np.clip(to_int(a) @ to_int(b).T, -(2**63), 2**63 - 1).astype(np.int64)


class BallTree:
    """A ball tree on the rows of a matrix; leaves are slices of `order`."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points))
        self.children: list[tuple[int, int] | None] = []
        self.slices: list[tuple[int, int]] = []
        centres, radii = [], []
        todo = [(0, len(points), -1, 0)]
        while todo:
            start, end, parent, side = todo.pop()
            node = len(self.slices)
            if parent >= 0:
                pair = self.children[parent] or (0, 0)
                self.children[parent] = (node, pair[1]) if side == 0 else (pair[0], node)
            rows = points[self.order[start:end]]
            centre = rows.mean(axis=0)
            away = np.linalg.norm(rows - centre, axis=1)
            centres.append(centre)
            radii.append(away.max())
            self.slices.append((start, end))
            self.children.append(None)
            if end - start > leaf and away.max() > 0:
                # Along the line between two far points, half to each side.
                one = rows[away.argmax()]
                two = rows[np.linalg.norm(rows - one, axis=1).argmax()]
                along = np.argsort(rows @ (two - one), kind="stable")
                self.order[start:end] = self.order[start:end][along]
                middle = (start + end) // 2
                todo += [(start, middle, node, 0), (middle, end, node, 1)]
        self.centres, self.radii = np.array(centres), np.array(radii)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Upper bounds of the inner products of each query with the points of each node, rounding errors included."""
        length = np.linalg.norm(queries, axis=1)[:, None]
        size = np.linalg.norm(self.centres, axis=1) + self.radii
        return queries @ self.centres.T + length * self.radii + 1e-9 * (1 + length * size)


def search(points: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, floors: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """The k best (query, id, score) of each query among the points that reach its floor, the query's own id left out."""
    tree = BallTree(points)
    ids, points = ids[tree.order], points[tree.order]
    bounds, found = tree.bounds(queries), []
    for q, own, least, above in zip(queries, query_ids.tolist(), floors.tolist(), bounds, strict=True):
        kept: list[tuple[int, int]] = []  # (score, -id), the worst first
        nodes = [(-above[0], 0)]
        while nodes:
            bound, node = heapq.heappop(nodes)
            if -bound < (max(least, kept[0][0]) if len(kept) == k else least):
                break
            if pair := tree.children[node]:
                for child in pair:
                    heapq.heappush(nodes, (-min(above[child], -bound), child))
                continue
            start, end = tree.slices[node]
            scores = exact(q[None], points[start:end])[0]
            at = max(least, kept[0][0]) if len(kept) == k else least
            good = np.flatnonzero(scores >= at)
            for score, other in zip(scores[good].tolist(), ids[start:end][good].tolist(), strict=True):
                if other != own:
                    if len(kept) < k:
                        heapq.heappush(kept, (score, -other))
                    elif (score, -other) > kept[0]:
                        heapq.heapreplace(kept, (score, -other))
        found += [(own, -other, score) for score, other in kept]
    return found


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, levels: int = LEVELS) -> DataFrame:
    """The k best (query_id, rank, vec_id, score) of each query by the inner product of floor(levels * x).

    Both frames have vec_id and embedding. Vectors that are null or hold null or non-finite components take no part;
    shorter vectors count as filled with zeros. A row is no candidate for a query of its own vec_id. Ties go to the
    smaller vec_id; repeated rows of vectors count once each, repeated queries once. No vectors or no queries give no
    rows.
    """

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in ("query_id", "vec_id", "score")})
        width = max(map(len, [*left["embedding"], *right["embedding"]]))
        points, asked = (np.floor(levels * matrix(x["embedding"], width)) for x in (left, right))
        least = right["least"].astype(float).fillna(-np.inf).to_numpy()
        return pd.DataFrame(search(points, left["vec_id"].to_numpy(), asked, right["query_id"].to_numpy(), least, k), columns=["query_id", "vec_id", "score"])

    points, asked = usable(vectors), usable(queries).withColumnRenamed("vec_id", "query_id").distinct()
    shards = max(1, -(-points.count() // SHARD_ROWS))
    blocks = max(1, -(-asked.count() // BLOCK_QUERIES))
    asked = asked.withColumn("home", dealt("query_id", shards, 1)).withColumn("block", dealt("query_id", blocks, 2))
    # Each shard meets each block of queries: the stated queries against all rows.
    points = points.withColumn("shard", dealt("vec_id", shards, 3)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def meet(asks: DataFrame) -> DataFrame:
        return points.groupBy("shard", "block").cogroup(asks.groupBy("shard", "block")).applyInPandas(run, FOUND)

    first = materialise(meet(asked.withColumn("shard", F.col("home")).withColumn("least", F.lit(None).cast("long"))))
    kth = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("least"))
    others = F.array_except(F.sequence(F.lit(0), F.lit(shards - 1)), F.array("home"))
    rest = meet(asked.join(kth, "query_id", "left").withColumn("shard", F.explode(others)))
    return best(first.unionByName(rest), k, "score").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op9_ball_tree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where(F.col("vec_id") % QUERY_STEP == 0))
