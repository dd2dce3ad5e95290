"""Changes to node and edge frames as batch transformations: each returns the frame afterwards.

Rows that bring an id more than once are one change: the row that comes last in the order of its columns counts (nulls
first), so the result does not depend on how rows are dealt; with `or_fail` they are a conflict if they differ.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Conflict(ValueError):
    """A change that was to fail unless it applies to all its rows."""


def _common(nodes: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    return rows.join(nodes.select(key), key, "left_semi")


def _once(rows: DataFrame, key: str, or_fail: bool = False) -> DataFrame:
    """One row of each id."""
    others = [c for c in rows.columns if c != key]
    if or_fail and not rows.distinct().groupBy(key).count().where("count > 1").isEmpty():
        raise Conflict("rows of one id differ")
    if not others:
        return rows.distinct()
    # As JSON: maps have no order of their own.
    order = [F.desc(F.to_json(F.struct(c)) if "map" in rows.schema[c].dataType.simpleString() else F.col(c)) for c in others]
    return rows.withColumn("__nth", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__nth = 1").drop("__nth")


def insert(nodes: DataFrame, rows: DataFrame, key: str = "id", or_fail: bool = False) -> DataFrame:
    """Add rows whose ids are new; with `or_fail` an id that is there is an error."""
    if or_fail and not _common(nodes, rows, key).isEmpty():
        raise Conflict("an id exists already")
    return nodes.unionByName(_once(rows, key, or_fail).join(nodes.select(key), key, "left_anti"), allowMissingColumns=True)


def delete(nodes: DataFrame, ids: DataFrame, key: str = "id", or_fail: bool = False) -> DataFrame:
    if or_fail and not ids.join(nodes.select(key), key, "left_anti").isEmpty():
        raise Conflict("an id does not exist")
    return nodes.join(ids.select(key), key, "left_anti")


def update(nodes: DataFrame, rows: DataFrame, key: str = "id", or_fail: bool = False) -> DataFrame:
    """Replace the columns that `rows` has, of the nodes that are there."""
    if or_fail and not rows.join(nodes.select(key), key, "left_anti").isEmpty():
        raise Conflict("an id does not exist")
    changed = [c for c in rows.columns if c != key]
    new = _once(rows, key, or_fail).select(F.col(key), F.struct(*changed).alias("__new"))
    joined = nodes.join(new, key, "left")
    return joined.select(*(F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in nodes.columns))


def upsert(nodes: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    return insert(update(nodes, rows, key), rows, key)


def change_type(nodes: DataFrame, ids: DataFrame, type_name: str, key: str = "id", column: str = "__type") -> DataFrame:
    return update(nodes, ids.select(key, F.lit(type_name).alias(column)), key)


def set_property(nodes: DataFrame, where: Column, **values: Any) -> DataFrame:
    """Set columns where a predicate holds; a value may be a column, as in adding to or multiplying a property."""
    holds = F.coalesce(where, F.lit(False))
    return nodes.withColumns({c: F.when(holds, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})


def update_if_different(nodes: DataFrame, rows: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """The frame afterwards and the ids that changed."""
    rows = _once(rows, key)
    columns = [c for c in rows.columns if c != key]
    old = nodes.select(key, F.struct(*columns).alias("__old"))
    changed = rows.join(old, key).where(~F.struct(*columns).eqNullSafe(F.col("__old"))).select(key)
    return update(nodes, rows, key), changed


def require(nodes: DataFrame, where: Column) -> DataFrame:
    """Fail if a row does not meet a requirement."""
    if not nodes.where(~F.coalesce(where, F.lit(False))).isEmpty():
        raise Conflict("a requirement is not met")
    return nodes


def relate(edges: DataFrame, rows: DataFrame) -> DataFrame:
    """Add edges that are not there."""
    return edges.unionByName(rows.join(edges.select("src", "dst"), ["src", "dst"], "left_anti").dropDuplicates(["src", "dst"]), allowMissingColumns=True)


def unrelate(edges: DataFrame, rows: DataFrame) -> DataFrame:
    return edges.join(rows.select("src", "dst"), ["src", "dst"], "left_anti")


def set_related(edges: DataFrame, rows: DataFrame) -> DataFrame:
    """Replace all edges of the sources that `rows` has."""
    kept = edges.join(rows.select("src").distinct(), "src", "left_anti")
    return kept.unionByName(rows.dropDuplicates(["src", "dst"]), allowMissingColumns=True)


def clear_related(edges: DataFrame, ids: DataFrame) -> DataFrame:
    return edges.join(ids.select(F.col("id").alias("src")), "src", "left_anti")
