"""Faceted counting with drill-sideways selection, in one pass over the rows.

Buckets of one facet are alternatives, facets restrict each other: each facet is counted on the rows that meet the
selections of all others. Every row emits its buckets of the facets for which it counts, and one grouped count, with
map-side combination, gives them all.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.ranges import POWER, date_ranges, duration_ranges, number_ranges
from quern.sources.shared import numbered

#: Numbers and times with more distinct values than this are counted in ranges.
MOST_VALUES, RANGES = 25, 10
#: Estimates of distinct values are that far off at most, in parts of them: nearer to MOST_VALUES they are counted.
ESTIMATE, DOUBT = 0.05, 0.5
NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
TIMES = (T.TimestampType, T.TimestampNTZType, T.DayTimeIntervalType)


@dataclass
class Facet:
    """What is counted of one column, and what is selected of it.

    Without values or ranges of its own, a column of numbers or times is counted in ranges if it has more than
    MOST_VALUES distinct values or if `range_count` is given, else by value. `power` bends the widths of ranges: without
    one, lower ranges of numbers and durations are finer and those of times are even. `names` are those of numbers that
    stand for names. Nulls are the missing bucket.
    """

    column: str
    kind: str = "auto"  # auto, value, range, single_range
    values: list[Any] = field(default_factory=list)
    ranges: list[tuple[Any, Any]] = field(default_factory=list)  # explicit ones, both ends in
    selected: list[Any] = field(default_factory=list)
    selected_ranges: list[tuple[Any, Any]] = field(default_factory=list)
    selected_missing: bool = False
    max_values: int | None = None
    min_count: int = 0
    include_missing: bool = True
    sort_by_count: bool = False
    range_count: int = 0
    power: float | None = None
    names: dict[int, str] = field(default_factory=dict)

    def number(self, value: Any) -> Any:
        """A name of an enumeration as its number; other values as they are."""
        return next((k for k, v in self.names.items() if v == value), value)

    def predicate(self, is_array: bool) -> Column | None:
        c, parts = F.col(self.column), []
        for v in map(self.number, self.selected):
            parts.append(F.array_contains(c, F.lit(v)) if is_array else c == F.lit(v))
        for low, high in self.selected_ranges:
            inside = lambda x, low=low, high=high: (x >= F.lit(low)) & (x <= F.lit(high))
            parts.append(F.exists(c, lambda x, f=inside: f(x)) if is_array else inside(c))
        if self.selected_missing:
            parts.append((c.isNull() | (F.size(c) == 0)) if is_array else c.isNull())
        return reduce(lambda a, b: a | b, (F.coalesce(p, F.lit(False)) for p in parts)) if parts else None


@dataclass
class Facets:
    """hits: the rows that meet all selections. buckets: (facet, position, value, low, high, n, selected)."""

    hits: DataFrame
    buckets: DataFrame


def _make_ranges(low: Any, high: Any, wanted: int, power: float | None, kind: T.DataType) -> list[tuple[Any, Any]]:
    if isinstance(low, datetime):
        return date_ranges(low, high, wanted, 1.0 if power is None else power)
    power = POWER if power is None else power
    if isinstance(low, timedelta):
        return duration_ranges(low, high, wanted, power)
    whole = isinstance(kind, T.IntegralType)
    return number_ranges(low if whole else float(low), high if whole else float(high), wanted, power, whole)


def _resolve(df: DataFrame, facets: list[Facet]) -> dict[str, list[tuple[Any, Any]] | None]:
    """The ranges of each facet that is counted in ranges; one aggregation looks at all that need it."""
    kinds = {f.column: df.schema[f.column].dataType for f in facets}
    ask = [f for f in facets if not f.values and not f.ranges and f.kind != "value" and not f.names and isinstance(kinds[f.column], (*NUMERIC, *TIMES))]
    exprs: list[Column] = []
    for f in ask:
        c = F.col(f.column)
        exprs += [F.min(c).alias(f"low_{f.column}"), F.max(c).alias(f"high_{f.column}")]
        if f.kind == "auto" and not f.range_count:
            exprs.append(F.approx_count_distinct(c, ESTIMATE).alias(f"n_{f.column}"))
    known = df.agg(*exprs).first().asDict() if exprs else {}
    # Only columns whose estimate is near the bound are counted exactly.
    near = [c for c, n in known.items() if c.startswith("n_") and MOST_VALUES * (1 - DOUBT) <= n <= MOST_VALUES * (1 + DOUBT)]
    if near:
        known |= df.agg(*(F.count_distinct(F.col(c[2:])).alias(c) for c in near)).first().asDict()
    out: dict[str, list[tuple[Any, Any]] | None] = {}
    for f in facets:
        out[f.column] = f.ranges or None
        if f not in ask:
            continue
        low, high = known[f"low_{f.column}"], known[f"high_{f.column}"]
        if low is None:
            continue
        if f.kind == "single_range":
            out[f.column] = [(low, high)]
        elif f.kind == "range" or f.range_count or known[f"n_{f.column}"] > MOST_VALUES:
            made = _make_ranges(low, high, f.range_count or RANGES, f.power, kinds[f.column])
            out[f.column] = [(low, made[0][1]), *made[1:]] if len(made) > 1 else made
    return out


def count_facets(df: DataFrame, facets: list[Facet]) -> Facets:
    """Count all facets of `df` and filter it by what is selected.

    Elements of an array count once per row. A selected value that no row has is a bucket of its own with count 0, and
    still filters. Values come in ascending order and null last, ranges in theirs, or all by falling count. Positions
    are given by ranges of this order, so that the values of one facet need not fit one task. No facets have no buckets.
    """
    if not facets:
        return Facets(df, df.sparkSession.createDataFrame([], "facet string, position int, value string, low string, high string, n long, selected boolean"))
    kinds = {f.column: df.schema[f.column].dataType for f in facets}
    arrays = {c for c, k in kinds.items() if isinstance(k, T.ArrayType)}
    ranges = _resolve(df, facets)
    masks = {f.column: f.predicate(f.column in arrays) for f in facets}
    every = [m for m in masks.values() if m is not None]
    both = lambda ms: reduce(lambda a, b: a & b, ms, F.lit(True))
    text = "struct<facet: string, place: int, value: string>"

    def buckets_of(f: Facet) -> Column:
        c, r = F.col(f.column), ranges[f.column]
        if r is not None:
            explicit, place = bool(f.ranges), []
            for i, (low, high) in enumerate(r):
                top = c <= F.lit(high) if explicit or i == len(r) - 1 else c < F.lit(high)
                place.append(F.when((c >= F.lit(low)) & top, F.struct(F.lit(f.column), F.lit(i), F.lit(None).cast("string")).cast(text)))
            found = F.array(*place)
        else:
            one = lambda v: F.struct(F.lit(f.column), F.lit(0), v.cast("string")).cast(text)
            found = F.transform(F.array_distinct(c), one) if f.column in arrays else F.array(F.when(c.isNotNull(), one(c)))
            if f.values:
                found = F.filter(found, lambda b: b["value"].isin([str(v) for v in f.values]))
        found = F.filter(found, lambda b: b.isNotNull())
        none = c.isNull() | (F.size(c) == 0) if f.column in arrays else c.isNull()
        missing = F.array(F.struct(F.lit(f.column), F.lit(-1), F.lit(None).cast("string")).cast(text))
        others = both([m for name, m in masks.items() if name != f.column and m is not None])
        return F.when(others, F.when(none, missing if f.include_missing else F.array().cast(f"array<{text}>")).otherwise(found)).otherwise(F.array().cast(f"array<{text}>"))

    rows = df.select(F.explode(F.concat(*map(buckets_of, facets))).alias("b")).select("b.*")
    counts = rows.groupBy("facet", "place", "value").agg(F.count(F.lit(1)).alias("n"))
    spark, known = df.sparkSession, []
    for f in facets:
        for i, (low, high) in enumerate(ranges[f.column] or []):
            known.append((f.column, i, None, str(low), str(high), any((low, high) == s for s in f.selected_ranges)))
        chosen = {_text(f.number(v)) for v in f.selected}
        for v in dict.fromkeys([*map(_text, f.values), *sorted(chosen)]):
            known.append((f.column, 0, v, None, None, v in chosen))
        for low, high in f.selected_ranges:
            if (low, high) not in (ranges[f.column] or []):
                known.append((f.column, 10_000, None, str(low), str(high), True))
        if f.selected_missing:
            known.append((f.column, -1, None, None, None, True))
    given = spark.createDataFrame(known, "facet string, place int, value string, low string, high string, selected boolean").alias("g")
    same = (F.col("g.facet") == F.col("c.facet")) & (F.col("g.place") == F.col("c.place")) & F.col("g.value").eqNullSafe(F.col("c.value"))
    joined = counts.alias("c").join(F.broadcast(given) if known else given, same, "full_outer").select(
        F.coalesce("c.facet", "g.facet").alias("facet"), F.coalesce("c.place", "g.place").alias("place"), F.coalesce("c.value", "g.value").alias("value"),
        "g.low", "g.high", F.coalesce("c.n", F.lit(0)).alias("n"), F.coalesce("g.selected", F.lit(False)).alias("selected"),
    )
    option = lambda get, kind: F.create_map(*(x for f in facets for x in (F.lit(f.column), F.lit(get(f)).cast(kind))))[F.col("facet")]
    numeric = {f.column for f in facets if isinstance(kinds[f.column], (*NUMERIC, T.BooleanType))}
    number = F.when(F.col("facet").isin(sorted(numeric)), F.expr("try_cast(value AS double)"))
    order = [
        F.desc(F.when(option(lambda f: f.sort_by_count, "boolean"), F.col("n")).otherwise(0)), F.asc(F.col("place") < 0), F.asc("place"),
        F.asc_nulls_last(number), F.asc_nulls_last("value"),
    ]
    ranked = _placed(joined, order, "position")
    most = option(lambda f: f.max_values, "int")
    if any(f.max_values is not None for f in facets):
        ranked = _placed(ranked, [F.desc("selected"), F.desc("n"), *order[1:]], "__rank")
        ranked = ranked.where(F.col("selected") | most.isNull() | (F.col("__rank") <= most))
    kept = ranked.where(F.col("selected") | (F.col("n") >= option(lambda f: f.min_count, "long")))
    names = [x for f in facets for k, v in f.names.items() for x in (F.lit(f"{f.column}\0{k}"), F.lit(v))]
    shown = F.coalesce(F.create_map(*names)[F.concat_ws("\0", "facet", "value")], F.col("value")) if names else F.col("value")
    buckets = kept.select("facet", F.col("position").cast("int"), shown.alias("value"), "low", "high", "n", "selected")
    return Facets(df.where(both(every)) if every else df, buckets)


def _placed(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Number the rows of each facet from 1."""
    all_rows = numbered(rows, [F.asc("facet"), *order], name)
    first = all_rows.groupBy("facet").agg(F.min(name).alias("__first"))
    # One row for each facet.
    return all_rows.join(F.broadcast(first), "facet").withColumn(name, F.col(name) - F.col("__first") + 1).drop("__first")


def _text(value: Any) -> str:
    return str(value).lower() if isinstance(value, bool) else str(value)


def relation_facet(df: DataFrame, edges: DataFrame, nodes: DataFrame, label: str, key: str = "id", selected: tuple[Any, ...] = ()) -> DataFrame:
    """(id, label, n, selected) of each node that rows of `df` are related to, in the order of labels. Selections of
    this facet are not to be in `df`; a selected node that no row has counts 0."""
    counts = edges.join(df.select(F.col(key).alias("src")), "src", "left_semi").groupBy(F.col("dst").alias("id")).agg(F.count_distinct("src").alias("n"))
    chosen = F.col("id").isin(list(selected)) if selected else F.lit(False)
    named = nodes.select("id", F.col(label).alias("label"))
    return named.join(counts, "id", "left").withColumn("selected", chosen).where(F.col("n").isNotNull() | F.col("selected")).select("id", "label", F.coalesce("n", F.lit(0)).alias("n"), "selected")


def facetable(df: DataFrame, allow: Callable[[str], bool] = lambda _: True) -> list[Facet]:
    """A facet for each column that can have one."""
    kinds = (*NUMERIC, T.StringType, T.BooleanType, *TIMES, T.ArrayType)
    return [Facet(f.name) for f in df.schema if isinstance(f.dataType, kinds) and allow(f.name)]
