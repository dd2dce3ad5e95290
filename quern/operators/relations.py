"""Filters by relation and nested includes, as semi, anti and outer joins."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ids in a list that are compared one by one; a longer list is joined.
INLINE_IDS = 1000


def ids_frame(nodes: DataFrame, ids: Iterable[Any], name: str) -> DataFrame:
    kind = nodes.schema[name if name in nodes.columns else "id"].dataType
    return nodes.sparkSession.createDataFrame([(i,) for i in dict.fromkeys(ids)], f"{name} {kind.simpleString()}")


def in_ids(nodes: DataFrame, ids: Iterable[Any], key: str = "id") -> DataFrame:
    """Nodes of the given ids; unknown ones are ignored, an empty list matches nothing."""
    ids = [i for i in dict.fromkeys(ids) if i is not None]
    if len(ids) <= INLINE_IDS:
        return nodes.where(F.col(key).isin(ids)) if ids else nodes.where(F.lit(False))
    return nodes.join(ids_frame(nodes, ids, key), key, "left_semi")


def relates(nodes: DataFrame, edges: DataFrame, targets: Iterable[Any], key: str = "id") -> DataFrame:
    """Nodes with an edge to one of the targets."""
    ends = in_ids(edges, targets, "dst").select(F.col("src").alias(key))
    return nodes.join(ends, key, "left_semi")


def relates_not(nodes: DataFrame, edges: DataFrame, targets: Iterable[Any], key: str = "id") -> DataFrame:
    """Nodes with no edge to any of the targets; an unknown target excludes nothing."""
    ends = in_ids(edges, targets, "dst").select(F.col("src").alias(key))
    return nodes.join(ends, key, "left_anti")


def has_path(nodes: DataFrame, path: list[DataFrame], target: Any, key: str = "id") -> DataFrame:
    """Nodes from which the edges of the path, one after another, lead to the target."""
    ends = path[-1].where(F.col("dst") == F.lit(target)).select("src").distinct()
    for edges in reversed(path[:-1]):
        ends = edges.join(ends.withColumnRenamed("src", "dst"), "dst", "left_semi").select("src").distinct()
    return nodes.join(ends.withColumnRenamed("src", key), key, "left_semi")


@dataclass(frozen=True)
class Include:
    """Related nodes to put beside each node: a column of arrays, or of one struct if `single`."""

    name: str
    edges: DataFrame
    nodes: DataFrame
    where: tuple[Column, ...] = ()
    top: int | None = None
    single: bool = False
    then: tuple[Include, ...] = field(default=())

    def merged(self, other: Include) -> Include:
        """One include for two of a name: filters add up, the higher top counts."""
        top = None if self.top is None or other.top is None else max(self.top, other.top)
        return replace(self, where=self.where + other.where, top=top, then=merge([*self.then, *other.then]))


def merge(branches: Iterable[Include]) -> tuple[Include, ...]:
    found: dict[str, Include] = {}
    for b in branches:
        found[b.name] = found[b.name].merged(b) if b.name in found else b
    return tuple(found.values())


def include(parents: DataFrame, branches: Iterable[Include], key: str = "id") -> DataFrame:
    """Add a column for each branch. Parents are all kept; children are filtered first, then cut to the top ones in the
    edges' order, then counted and nested; branches below are joined to children first."""
    for b in merge(branches):
        children = b.nodes.where(reduce(lambda x, y: x & y, (F.coalesce(w, F.lit(False)) for w in b.where))) if b.where else b.nodes
        children = include(children, b.then) if b.then else children
        body = F.struct(*children.columns).alias("__child")
        pairs = b.edges.select("src", "dst", "ord").join(children.select(F.col("id").alias("dst"), body), "dst")
        if b.top is not None or b.single:
            order = Window.partitionBy("src").orderBy("ord", "dst")
            pairs = pairs.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= (1 if b.single else b.top))
        if b.single:
            nested = pairs.select(F.col("src").alias(key), F.col("__child").alias(b.name))
            parents = parents.join(nested, key, "left")
        else:
            rows = F.sort_array(F.collect_list(F.struct("ord", "dst", "__child")))
            nested = pairs.groupBy(F.col("src").alias(key)).agg(F.transform(rows, lambda r: r["__child"]).alias(b.name))
            parents = parents.join(nested, key, "left")
            parents = parents.withColumn(b.name, F.coalesce(b.name, F.array().cast(parents.schema[b.name].dataType)))
    return parents


def include_references(parents: DataFrame, column: str, nodes: DataFrame, name: str, key: str = "id") -> DataFrame:
    """Add the nodes that a column of one id or of an array of ids points to: in stored order, repeats kept, stale ids
    left out."""
    if parents.schema[column].dataType.typeName() != "array":
        targets = nodes.select(F.col("id").alias(column), F.struct(*nodes.columns).alias(name))
        return parents.join(targets, column, "left").select(*parents.columns, name)
    places = parents.select(key, F.posexplode(column).alias("__pos", "__ref"))
    targets = nodes.select(F.col("id").alias("__ref"), F.struct(*nodes.columns).alias("__node"))
    rows = F.sort_array(F.collect_list(F.struct("__pos", "__node")))
    nested = places.join(targets, "__ref").groupBy(key).agg(F.transform(rows, lambda r: r["__node"]).alias(name))
    parents = parents.join(nested, key, "left")
    return parents.withColumn(name, F.coalesce(name, F.array().cast(parents.schema[name].dataType)))

