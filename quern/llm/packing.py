"""Best-fit packing of documents into token sequences, planned on the histogram of lengths.

A linear grouping scheme: lengths over a bound are sorted and cut into groups of equal cardinality, each rounded
up to its longest; column generation finds configurations of these few sizes that need the fewest sequences; the
groups' actual documents take the places; what is left, small documents above all, goes best fit into the room
that remains. Lengths are whole numbers up to the capacity, so the plan is a few thousand runs of equal sequences,
whatever the number of documents, and every document finds its place from its rank among those of its length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import BUCKET_ROWS, gapless, materialise, table
from quern.llm.text import give_back, slices
from quern.llm.tokens import BLOCK, default_tokenizer, encoder

CAPACITY = 4096
END_ID = 1
#: Numbers of groups of the linear grouping scheme, of which the best counts: more groups round less up, fewer leave
#: more room for small documents. And the part of the capacity from which a document counts as large.
GROUPS = (16, 32, 64)
LARGE = 1 / 8
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Cut each document's ids, END_ID last, into pieces of at most `capacity`; a null text is empty."""
    path = tokenizer or default_tokenizer()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, step = encoder(path), np.array([END_ID], dtype="<u4").tobytes(), 4 * capacity
        for batch in batches:
            rows = []
            docs = batch["doc_id"].to_pylist()
            for first, last, texts in slices(batch["text"], len(docs), BLOCK):
                for doc, ids in zip(docs[first:last], encode.many(texts), strict=True):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), step)):
                        part = ids[at : at + step]
                        rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )
            give_back()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES)


def _configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[np.ndarray, int]]:
    """Configurations of few sizes and how often each is used (whole numbers, rounded down), by column generation."""
    k = len(sizes)
    basis = np.diag([float(capacity // s) for s in sizes])
    amount = np.array(demand) / np.diag(basis)
    for _ in range(40 * k):
        price = np.linalg.solve(basis.T, np.ones(k))
        # The configuration of the highest price: a knapsack over the capacity.
        best, taken = np.zeros(capacity + 1), np.zeros((k, capacity + 1), dtype=np.int16)
        for g in np.flatnonzero(price > 1e-12):
            for n in range(1, capacity // sizes[g] + 1):
                moved = np.full(capacity + 1, -1.0)
                moved[sizes[g] :] = best[: -sizes[g]] + price[g]
                # One more of g only on top of n-1 of g, or of none where n is 1.
                on = taken[g][: capacity + 1 - sizes[g]] == n - 1
                better = np.zeros(capacity + 1, dtype=bool)
                better[sizes[g] :] = on & (moved[sizes[g] :] > best[sizes[g] :] + 1e-12)
                if not better.any():
                    break
                best = np.where(better, moved, best)
                taken[g][better] = n
        if best[capacity] <= 1 + 1e-7:
            break
        column, room = np.zeros(k), int(capacity)
        for g in range(k - 1, -1, -1):
            column[g] = taken[g][room]
            room -= int(column[g]) * sizes[g]
        if price @ column <= 1 + 1e-7:
            break
        move = np.linalg.solve(basis, column)
        rows = np.flatnonzero(move > 1e-9)
        if not len(rows):
            break
        leave = rows[np.argmin(amount[rows] / move[rows])]
        step = amount[leave] / move[leave]
        amount = amount - step * move
        amount[leave] = step
        basis[:, leave] = column
    left, found = np.array(demand), []
    for p in range(k):
        column = basis[:, p].astype(np.int64)
        times = int(min(np.floor(amount[p] + 1e-6), *(left[column > 0] // column[column > 0])))
        if times > 0:
            found.append((column, times))
            left = left - times * column
    return found


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: tuple[int, ...] = GROUPS) -> pd.DataFrame:
    """Where the documents of each length go, as runs: the plan of the fewest sequences among the numbers of groups.

    A run (length, rank, n, sequence, per, offset) places the `n` documents of that length from `rank` on into
    sequences from `sequence` on, `per` in each, one after another from `offset`.
    """
    return min((_plan(histogram, capacity, k) for k in groups), key=lambda found: found[1])[0]


def _plan(histogram: dict[int, int], capacity: int, groups: int) -> tuple[pd.DataFrame, int]:
    """The runs for one number of groups, and how many sequences they use."""
    runs: list[tuple[int, int, int, int, int, int]] = []
    free: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []
    used = 0

    def give(room: int, start: int, n: int) -> None:
        if room and n:
            if not free.get(room):
                free[room] = []
                insort(rooms, room)
            free[room].append((start, n))

    lengths = sorted(histogram, reverse=True)
    rest: dict[int, list[list[int]]] = {}
    large = [x for x in lengths if capacity * LARGE < x < capacity]
    for x in lengths:
        if x == capacity:
            runs.append((x, 0, histogram[x], used, 1, 0))
            used += histogram[x]
        elif x <= capacity * LARGE:
            rest[x] = [[0, histogram[x]]]
    # Groups of equal cardinality, the longest first: each a stream of (length, rank, n).
    total = sum(histogram[x] for x in large)
    streams: list[list[list[int]]] = []
    count = 0
    for x in large:
        rank = 0
        while rank < histogram[x]:
            if not streams or count >= total * len(streams) / groups:
                streams.append([])
            n = min(histogram[x] - rank, max(1, int(np.ceil(total * len(streams) / groups)) - count))
            streams[-1].append([x, rank, n])
            rank, count = rank + n, count + n
    # Groups of one size count together.
    merged: dict[int, list[list[int]]] = {}
    for stream in streams:
        merged.setdefault(stream[0][0], []).extend(stream)
    sizes = list(merged)
    found = _configurations(sizes, [sum(s[2] for s in merged[x]) for x in sizes], capacity) if sizes else []
    for column, times in found:
        places: list[list[list[int]]] = []
        for g in np.flatnonzero(column):
            for _ in range(int(column[g])):
                stream, need, place = merged[sizes[g]], times, []
                while need:
                    x, rank, n = stream[0]
                    take = min(n, need)
                    place.append([x, rank, take])
                    need -= take
                    if take == n:
                        stream.pop(0)
                    else:
                        stream[0] = [x, rank + take, n - take]
                places.append(place)
        done = 0
        while done < times:
            n, offset = min(p[0][2] for p in places), 0
            for p in places:
                x, rank, have = p[0]
                runs.append((x, rank, n, used, 1, offset))
                offset += x
                if have == n:
                    p.pop(0)
                else:
                    p[0] = [x, rank + n, have - n]
            give(capacity - offset, used, n)
            done, used = done + n, used + n
    for stream in merged.values():
        for x, rank, n in stream:
            rest.setdefault(x, []).append([rank, n])
    # Best fit, the longest first, for all that is left.
    for x in sorted(rest, reverse=True):
        for rank, n in rest[x]:
            while n:
                i = bisect_left(rooms, x)
                if i == len(rooms):
                    fresh = -(-n // (capacity // x))
                    give(capacity, used, fresh)
                    used += fresh
                    continue
                room = rooms[i]
                start, have = free[room].pop()
                if not free[room]:
                    rooms.pop(i)
                per = min(room // x, n)
                whole = min(have, n // per)
                runs.append((x, rank, whole * per, start, per, capacity - room))
                give(room - per * x, start, whole)
                give(room, start + whole, have - whole)
                rank, n = rank + whole * per, n - whole * per
    table_of = pd.DataFrame(runs, columns=["length", "rank", "n", "sequence", "per", "offset"])
    return table_of.sort_values(["length", "rank"], ignore_index=True), used


def pack(parts: DataFrame, capacity: int = CAPACITY, order: tuple[str, ...] = ("doc_id", "piece", "ids_crc32")) -> DataFrame:
    """Give each row of `parts` (with an integer `length` from 1 to `capacity`) a sequence_id and an offset.

    Rows are read more than once, so they should be a written table. Equal rows take places of their own. An empty
    table gives no rows. The plan that is sent to all tasks has a bound set by the capacity.
    """
    spark = parts.sparkSession
    sizes = parts.groupBy("length").agg(F.count(F.lit(1)).alias("__docs"))
    histogram = {int(r[0]): int(r[1]) for r in sizes.collect()}  # at most `capacity` rows
    runs = spark.sparkContext.broadcast({c: v.to_numpy(dtype=np.int64) for c, v in plan(histogram, capacity).items()})

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        r = runs.value
        length, rank = length.to_numpy(), rank.to_numpy()
        at = np.searchsorted((r["length"] << 48) + r["rank"], (length << 48) + rank, side="right") - 1
        n = rank - r["rank"][at]
        return pd.DataFrame({"sequence_id": r["sequence"][at] + n // r["per"][at], "offset": r["offset"][at] + n % r["per"][at] * length})

    parts = parts.join(F.broadcast(sizes), "length")  # at most `capacity` rows
    ranked = gapless(parts, "length", F.ceil(F.col("__docs") / BUCKET_ROWS).cast("int"), list(order), "__rank")
    return ranked.withColumn("__at", place("length", "__rank")).select(
        *(c for c in parts.columns if c != "__docs"), F.col("__at.sequence_id").alias("sequence_id"), F.col("__at.offset").alias("offset")
    )


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Tokenise, cut and pack whole documents; see `pieces` and `pack`. Other columns of `docs` are not read."""
    return pack(materialise(pieces(docs, tokenizer, capacity)), capacity)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )
