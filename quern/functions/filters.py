"""Filters given as dictionaries, as GraphQL arguments are, made into predicates."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from quern.functions import logic

_COMPARE = {"eq": logic.eq, "ne": logic.ne, "gt": logic.gt, "gte": logic.ge, "lt": logic.lt, "lte": logic.le}


def predicate(spec: dict[str, Any]) -> Column:
    """{"name": {"eq": 1}, "and": [...], "or": [...], "not": {...}} as a predicate; all entries hold together.

    `in` of an empty list holds nowhere, `nin` of one says nothing, and an empty branch of `or` holds everywhere.
    """
    parts = []
    for name, rule in spec.items():
        if name == "and":
            parts += map(predicate, rule)
        elif name == "or":
            parts.append(logic.any_of(*map(predicate, rule)) if rule else F.lit(True))
        elif name == "not":
            parts.append(logic.negate(predicate(rule)))
        else:
            parts += [_one(F.col(name), op, value) for op, value in rule.items()]
    return logic.all_of(*parts)


def _one(column: Column, op: str, value: Any) -> Column:
    if op in _COMPARE:
        return _COMPARE[op](column, value)
    if op == "in":
        return logic.one_of(column, value)
    if op == "nin":
        return logic.negate(logic.one_of(column, value))
    raise ValueError(f"unknown comparison {op}")


def page_bounds(page: int | None, size: int | None, most: int = 1000) -> tuple[int, int]:
    """A page's index and size within bounds."""
    return max(page or 0, 0), min(max(size if size is not None else 100, 1), most)


@dataclass(frozen=True)
class Listing:
    """A page of rows. The rows of all pages are counted on the way, while those of the page are read."""

    rows: DataFrame
    page: int
    page_size: int
    seen: Observation

    def total(self) -> int:
        """How many rows all pages have; known after the first action on `rows`."""
        return int(self.seen.get.get("total", 0))


def listing(df: DataFrame, filter: dict[str, Any] | None = None, ids: list | None = None, order_by: str | None = None, descending: bool = False, page: int | None = None, page_size: int | None = None, key: str = "id", hits: DataFrame | None = None) -> Listing:
    """A page of `df` as a list query asks for it. `hits` (id, score) are what a search found: others go, and without another
    order the best come first."""
    if ids is not None:
        df = df.where(logic.one_of(F.col(key), ids))
    if filter:
        df = df.where(predicate(filter))
    order = [F.desc(order_by) if descending else F.asc(order_by)] if order_by else []
    columns = df.columns
    if hits is not None:
        df = df.join(hits.select(F.col("id").alias(key), F.col("score").alias("__score")), key)
        order = order or [F.desc("__score")]
    index, size = page_bounds(page, page_size)
    seen = Observation()
    rows = df.observe(seen, F.count(F.lit(1)).alias("total")).orderBy(*order, F.asc(key)).offset(index * size).limit(size)
    return Listing(rows.select(*columns), index, size, seen)
