"""Breadth-first traversal and shortest paths over edge frames, one join a level."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.sources.shared import written

MOST_VISITED = 1_000_000


class BudgetError(RuntimeError):
    """More nodes were visited than allowed."""


def directed(edges: DataFrame, direction: str = "default") -> DataFrame:
    """(src, dst) along the edges, against them (`reverse`) or both ways (`both`)."""
    there, back = edges.select("src", "dst"), edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    frames = {"default": there, "reverse": back, "both": there.unionByName(back)}
    return frames[direction].where("src is not null and dst is not null").distinct()


def levels(seeds: DataFrame, edges: DataFrame, most: int, direction: str = "default", budget: int = MOST_VISITED, until: Any = None) -> DataFrame:
    """(id, level, parent) of the nodes within `most` steps of the seeds (id), which are level 0.

    A node's level is that of its shortest way, its parent the smallest node one level below. Every level is a written
    table. With `until` it ends at the level where that node is found.
    """
    return _levels(seeds, written(directed(edges, direction)), most, budget, until)


def _levels(seeds: DataFrame, edges: DataFrame, most: int, budget: int, until: Any) -> DataFrame:
    frontier = written(seeds.select("id").distinct().withColumns({"level": F.lit(0), "parent": F.lit(None).cast(seeds.schema["id"].dataType)}))
    visited, count = frontier, frontier.count()
    for level in range(1, most + 1):
        if count > budget:
            raise BudgetError(f"more than {budget} nodes visited")
        reached = edges.join(frontier.select(F.col("id").alias("src")), "src").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
        frontier = written(reached.join(visited.select("id"), "id", "left_anti").select("id", F.lit(level).alias("level"), "parent"))
        is_end = F.col("id") == F.lit(until) if until is not None else F.lit(False)
        found = frontier.agg(F.count(F.lit(1)).alias("n"), F.max(is_end).alias("end")).first()
        if not found["n"]:
            break
        visited, count = visited.unionByName(frontier), count + found["n"]
        if found["end"]:
            break
    if count > budget:
        raise BudgetError(f"more than {budget} nodes visited")
    return visited


def traverse(nodes: DataFrame, seeds: DataFrame, edges: DataFrame, least: int = 1, most: int = 1, direction: str = "default", budget: int = MOST_VISITED) -> DataFrame:
    """The rows of `nodes` whose distance to the nearest seed is from `least` to `most`, with their `level`. What lies
    between need not be among `nodes`."""
    reached = levels(seeds, edges, most, direction, budget).where(F.col("level") >= least)
    return nodes.join(reached.select("id", "level"), "id")


def shortest_path(edges: DataFrame, start: Any, end: Any, most: int = 1000, direction: str = "default", budget: int = MOST_VISITED) -> list[Any] | None:
    """The nodes of a shortest way, both ends in; of several the one through the smallest ids, seen from the end. None
    if there is no way of at most `most` steps or an end has no edge. The way back is one join a level, in one job."""
    spark, kind = edges.sparkSession, edges.schema["src"].dataType.simpleString()
    known = written(directed(edges, direction))
    ends = known.agg(*(F.max((F.col("src") == F.lit(x)) | (F.col("dst") == F.lit(x))).alias(c) for c, x in (("a", start), ("b", end)))).first()
    if not (ends["a"] and ends["b"]):
        return None
    if start == end:
        return [start]
    found = _levels(spark.range(0, 1, 1, 1).select(F.lit(start).cast(kind).alias("id")), known, most, budget, end)
    steps = found.where(F.col("id") == F.lit(end)).select("level", "parent").first()
    if steps is None:
        return None
    path = found.where(F.col("id") == F.lit(end)).select(F.array("id").alias("path"), F.col("parent").alias("next"))
    for level in range(steps["level"] - 1, -1, -1):
        below = found.where(F.col("level") == level).select(F.col("id").alias("next"), "parent")
        # One row: the way so far.
        path = below.join(F.broadcast(path), "next").select(F.concat("path", F.array("next")).alias("path"), F.col("parent").alias("next"))
    return path.first()["path"][::-1]


def circular(edges: DataFrame, most: int = 1000) -> DataFrame:
    """(id): nodes from which the edges lead back to themselves; `most` bounds the rounds, beyond it is an error.

    First nodes that no edge leads to, or that none leads from, are taken away in rounds until none is left. Then, again
    and again, every node gets the largest id that leads to it; the nodes that lead to one which thus marks
    itself, among those with its mark, are the nodes of its circles, and all with its mark that do not lead to it have
    no circle through it and go on to the next round without it.
    """
    rounds = iter(range(most))

    def step() -> None:
        if next(rounds, None) is None:
            raise BudgetError(f"more than {most} rounds")

    edges = written(directed(edges))
    own = written(edges.where("src = dst").select(F.col("src").alias("id")))
    found, rest = [own], written(edges.where("src <> dst"))
    size = rest.count()
    while size:
        # Edges between nodes that have both an edge to them and one from them.
        before = -1
        while size != before:
            step()
            inner = rest.select(F.col("src").alias("id")).distinct().join(rest.select(F.col("dst").alias("id")).distinct(), "id", "left_semi")
            inner = written(inner)
            rest = written(rest.join(inner.withColumnRenamed("id", "src"), "src", "left_semi").join(inner.withColumnRenamed("id", "dst"), "dst", "left_semi"))
            before, size = size, rest.count()
        if not size:
            break
        marks, changed = written(inner.withColumn("mark", F.col("id"))), True
        while changed:
            step()
            to = rest.join(marks.select(F.col("id").alias("src"), F.col("mark").alias("other")), "src").groupBy(F.col("dst").alias("id")).agg(F.max("other").alias("other"))
            new = written(marks.join(to, "id", "left").select("id", "mark", F.greatest("mark", F.coalesce("other", "mark")).alias("new")))
            changed = not new.where("mark <> new").isEmpty()
            marks = new.select("id", F.col("new").alias("mark"))
        # Back from the nodes that have their own id as mark, along edges between nodes of one mark.
        of = lambda c: marks.select(F.col("id").alias(c), F.col("mark").alias(f"{c}_mark"))
        same = written(rest.join(of("src"), "src").join(of("dst"), "dst").where("src_mark = dst_mark").select("src", "dst"))
        back = written(marks.where("id = mark").select("id"))
        seen, more = back, True
        while more:
            step()
            back = written(same.join(back.withColumnRenamed("id", "dst"), "dst").select(F.col("src").alias("id")).distinct().join(seen, "id", "left_anti"))
            more = not back.isEmpty()
            seen = seen.unionByName(back) if more else seen
        # A mark that only its own node leads to has no circle: a circle has an edge back to its node.
        closed = same.join(seen.withColumnRenamed("id", "src"), "src", "left_semi").join(seen.withColumnRenamed("id", "dst"), "dst", "left_semi")
        found.append(written(closed.select(F.col("src").alias("id")).distinct()))
        rest = written(rest.join(seen.withColumnRenamed("id", "src"), "src", "left_anti").join(seen.withColumnRenamed("id", "dst"), "dst", "left_anti"))
        size = rest.count()
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()
