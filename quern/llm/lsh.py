"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each table hashes a vector by several functions floor((a.v + b) / w) with Gaussian a. A query visits its own bucket
and then those that differ by one step in some functions, in the order of estimated success: the sum of the squared
distances to the boundaries that are crossed. Candidates of all tables are merged and ranked by the exact measure.
Largest inner product becomes nearest distance on vectors with one more component that evens out their lengths.
"""

from __future__ import annotations

import heapq
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import materialise, release, table
from quern.llm.text import mix
from quern.llm.vectors import best, dealt, matrix, usable

TABLES, FUNCTIONS, WIDTH, PROBES = 4, 8, 2.5, 160
K, QUERY_STEP, SEED = 20, 20, 20240229
#: Vectors of a part of a table, visits of queries to it, and queries scored at a time.
PART_ROWS, PART_VISITS, CHUNK = 16384, 100_000, 128


class Hashes:
    """The hash functions of all tables for vectors of `width` components and lengths up to `longest`."""

    def __init__(self, width: int, longest: float):
        rng = np.random.default_rng(SEED)
        self.longest = longest or 1.0
        self.a = rng.normal(size=(TABLES, width + 1, FUNCTIONS))
        self.b = rng.uniform(0, WIDTH, size=(TABLES, 1, FUNCTIONS))

    def at(self, vectors: np.ndarray, query: bool) -> np.ndarray:
        """Where vectors fall in units of the width: (table, vector, function)."""
        length = np.linalg.norm(vectors, axis=1, keepdims=True)
        if query:
            unit, more = vectors / np.where(length > 0, length, 1), np.zeros_like(length)
        else:
            unit = vectors / self.longest
            more = np.sqrt(np.clip(1 - (length / self.longest) ** 2, 0, None))
        return (np.hstack([unit, more]) @ self.a + self.b) / WIDTH


def bucket(cells: np.ndarray) -> np.ndarray:
    """A number for each row of cells."""
    out = np.zeros(len(cells), dtype=np.uint64)
    for j in range(cells.shape[1]):
        out = mix(out + cells[:, j].astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(j + 1))
    return (out >> np.uint64(1)).astype(np.int64)


@lru_cache
def sequence(functions: int, count: int) -> np.ndarray:
    """The first `count` sets of steps in the order of their expected cost, as rows of 0 and 1 over the steps.

    Steps are the 2 x `functions` moves of a query to a neighbouring cell, the nearest boundary first; positions j and
    2 x `functions` - 1 - j are the two moves of one function, of which a set has one at most.
    """
    m = functions
    up = [(j * (j + 1)) / (4 * (m + 1) * (m + 2)) for j in range(1, m + 1)]
    down = [1 - (2 * m + 1 - j) / (m + 1) + (2 * m + 1 - j) * (2 * m + 2 - j) / (4 * (m + 1) * (m + 2)) for j in range(m + 1, 2 * m + 1)]
    cost = up + down
    sets, out = [(cost[0], (0,))], [()]
    while sets and len(out) < count:
        total, chosen = heapq.heappop(sets)
        if not any(2 * m - 1 - j in chosen for j in chosen):
            out.append(chosen)
        last = chosen[-1]
        if last + 1 < 2 * m:
            heapq.heappush(sets, (total - cost[last] + cost[last + 1], (*chosen[:-1], last + 1)))
            heapq.heappush(sets, (total + cost[last + 1], (*chosen, last + 1)))
    return np.array([[j in chosen for j in range(2 * m)] for chosen in out], dtype=np.float64)


def probes(places: np.ndarray, count: int) -> np.ndarray:
    """The numbers of the first `count` buckets for each query, the likeliest first: (query, probe)."""
    cells = np.floor(places)
    low = places - cells
    n, m = places.shape
    order = np.argsort(np.hstack([low, 1 - low]), axis=1, kind="stable")
    moves = np.zeros((n, 2 * m, m))
    np.put_along_axis(moves, (order % m)[:, :, None], np.where(order < m, -1.0, 1.0)[:, :, None], axis=2)
    visited = cells[:, None, :] + sequence(m, count) @ moves
    return bucket(visited.reshape(-1, m)).reshape(n, -1)


def nearest(q: np.ndarray, own: int, points: np.ndarray, ids: np.ndarray, rows: np.ndarray, rough: np.ndarray, floor: float, k: int) -> list[tuple[int, int, int, float]]:
    """The k best by exact inner product of the points that reach the floor; `rough` has it up to rounding."""
    at = np.flatnonzero((rough >= floor - 1e-9 * (1 + abs(floor)) if np.isfinite(floor) else rough > -np.inf) & (ids != own))
    if len(at) > k:
        kth = np.partition(rough[at], len(at) - k)[len(at) - k]
        at = at[rough[at] >= kth - 1e-9 * (1 + abs(kth))]
    score = (points[at] * q).sum(axis=1)
    order = np.lexsort((ids[at], -score))[:k]
    return [(own, int(ids[at[i]]), int(rows[at[i]]), float(score[i])) for i in order]


FOUND = "query_id long, vec_id long, row long, score double"
_NONE = {"query_id": "int64", "vec_id": "int64", "row": "int64", "score": "float64"}
#: What a row found is told by: repeated rows, alike in both, are one here and counted beside.
_ROW = ["query_id", "vec_id", "row"]


def _frame(found: list[tuple[int, int, int, float]]) -> pd.DataFrame:
    return pd.DataFrame(found, columns=list(_NONE)).astype(_NONE)


def search(vectors: DataFrame, queries: DataFrame, k: int = K, count: int = PROBES) -> DataFrame:
    """The k nearest found (query_id, rank, vec_id, score) of each query; score is the inner product in doubles.

    Both frames have vec_id and embedding. Vectors that are null, empty, zero or hold null or non-finite components
    take no part; shorter vectors count as filled with zeros. A row is no candidate for a query of its own vec_id.
    Ties go to the smaller vec_id; repeated rows of vectors count once each, repeated queries once. A query whose
    buckets hold fewer than k candidates is compared with all vectors. No vectors or no queries give no rows.
    """
    points = usable(vectors, zero=False).withColumn("row", F.xxhash64("embedding"))
    asked = usable(queries, zero=False).withColumnRenamed("vec_id", "query_id").distinct()
    kind = points.schema["embedding"].dataType.simpleString()
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    known = points.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("width"), F.max(length).alias("longest")).first()
    more = asked.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("width")).first()
    width = max(known["width"] or 1, more["width"] or 1)
    hashes = Hashes(width, known["longest"] or 1.0)
    parts = max(1, -(-known["n"] // PART_ROWS), -(-more["n"] * count // PART_VISITS))

    def index(batches):
        for batch in batches:
            if len(batch):
                v = matrix(batch["embedding"], width)
                for t, place in enumerate(hashes.at(v, query=False)):
                    b = bucket(np.floor(place))
                    yield pd.DataFrame({"tab": t, "part": b % parts, "bucket": b, "vec_id": batch["vec_id"], "row": batch["row"], "place": np.arange(len(batch)), "embedding": batch["embedding"]})

    def visits(tables: range):
        def visit(batches):
            for batch in batches:
                for start in range(0, len(batch), 1000):
                    some = batch.iloc[start : start + 1000]
                    places = hashes.at(matrix(some["embedding"], width), query=True)
                    for t in tables:
                        b = probes(places[t], count)
                        group = np.arange(len(some))[:, None] * parts + b % parts
                        order = np.argsort(group, axis=None, kind="stable")
                        groups, first = np.unique(group.ravel()[order], return_index=True)
                        asks = some.iloc[groups // parts]
                        yield pd.DataFrame({"tab": t, "part": groups % parts, "buckets": np.split(b.ravel()[order], first[1:]), "query_id": asks["query_id"].to_numpy(), "least": asks["least"].to_numpy(), "embedding": asks["embedding"].to_numpy()})

        return visit

    def rank(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return _frame([])
        left = left.sort_values("bucket", kind="stable")
        ids, marks, members = left["vec_id"].to_numpy(), left["row"].to_numpy(), matrix(left["embedding"], width)
        names, inverse = np.unique(left["bucket"].to_numpy(), return_inverse=True)
        found: list[tuple[int, int, int, float]] = []
        for start in range(0, len(right), CHUNK):
            some = right.iloc[start : start + CHUNK]
            hit = np.zeros((len(some), len(names)), dtype=bool)
            for i, wanted in enumerate(some["buckets"]):
                at = np.searchsorted(names, wanted)
                hit[i, at[(at < len(names)) & (names[np.minimum(at, len(names) - 1)] == wanted)]] = True
            # The buckets that any of these queries visits are scored in one product; each query sees its own.
            rows = np.flatnonzero(hit.any(axis=0)[inverse])
            if len(rows):
                asks, held, of, marked = matrix(some["embedding"], width), members[rows], ids[rows], marks[rows]
                rough = np.where(hit[:, inverse[rows]], asks @ held.T, -np.inf)
                for own, q, floor, scores in zip(some["query_id"], asks, some["least"], rough, strict=True):
                    found += nearest(q, own, held, of, marked, scores, floor, k)
        return _frame(found)

    def scan(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return _frame([])
        ids, marks, members = left["vec_id"].to_numpy(), left["row"].to_numpy(), matrix(left["embedding"], width)
        asks = matrix(right["embedding"], width)
        return _frame([x for own, q in zip(right["query_id"], asks, strict=True) for x in nearest(q, own, members, ids, marks, members @ q, -np.inf, k)])

    table_of = materialise(points.mapInPandas(index, f"tab int, part long, bucket long, vec_id long, row long, place long, embedding {kind}"))
    sizes = table_of.groupBy("tab", "part").agg(F.ceil(F.count(F.lit(1)) / PART_ROWS).cast("int").alias("salts"))
    keys = ["tab", "part", "salt"]

    def meet(asks: DataFrame, tables: range) -> DataFrame:
        """The k best of each query in the given tables, of those that reach its floor `least`."""
        mine = table_of.where(F.col("tab").between(tables[0], tables[-1])).join(sizes, ["tab", "part"])
        mine = mine.withColumn("salt", F.pmod(F.xxhash64("vec_id", "place"), F.col("salts")).cast("int")).drop("salts", "place")
        given = asks.schema["embedding"].dataType.simpleString()
        asks = asks.select("query_id", "least", "embedding").mapInPandas(visits(tables), f"tab int, part long, buckets array<long>, query_id long, least double, embedding {given}")
        asks = asks.join(sizes, ["tab", "part"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
        found = mine.groupBy(*keys).cogroup(asks.groupBy(*keys)).applyInPandas(rank, FOUND)
        return materialise(found.groupBy(*_ROW).agg(F.max("score").alias("score")))

    repeated = materialise(points.groupBy("vec_id", "row").agg(F.count(F.lit(1)).alias("times")).where("times > 1"))

    def each(found: DataFrame) -> DataFrame:
        """Every repeated row as often as it is there; the k best take k of it at most."""
        times = F.sequence(F.lit(1), F.least(F.coalesce(F.col("times"), F.lit(1)), F.lit(k)).cast("int"))
        return found.join(repeated, ["vec_id", "row"], "left").withColumn("time", F.explode(times)).select("query_id", "vec_id", "score")

    found = meet(asked.withColumn("least", F.lit(float("-inf"))), range(1))
    # The kth score of the first table is the floor of the others.
    kth = best(each(found), k, "score").groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("least"))
    floors = asked.join(kth, "query_id", "left").fillna(float("-inf"), ["least"])
    found = found.unionByName(meet(floors, range(1, TABLES))).groupBy(*_ROW).agg(F.max("score").alias("score"))
    release(points.sparkSession, table_of)
    enough = each(found).groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
    short = asked.join(enough, "query_id", "left_anti")
    lacking = short.count()
    if lacking:
        slices = max(1, -(-known["n"] // PART_ROWS))
        groups = max(1, -(-lacking // PART_ROWS))
        left = points.distinct().withColumn("slice", dealt("vec_id", slices, 4)).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        right = short.withColumn("group", dealt("query_id", groups, 5)).withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
        extra = left.groupBy("slice", "group").cogroup(right.groupBy("slice", "group")).applyInPandas(scan, FOUND)
        found = found.unionByName(extra).groupBy(*_ROW).agg(F.max("score").alias("score"))
    return best(each(found), k, "score").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op10_multiprobe_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where(F.col("vec_id") % QUERY_STEP == 0))
