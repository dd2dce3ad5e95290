"""The query over nodes: immutable, each call returns a new one; nothing runs before a result is asked for."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions import geo, logic
from quern.operators import facets as facet_ops
from quern.operators import graph, relations, search
from quern.operators.context import Context
from quern.sources.catalog import TYPE, Catalog


@dataclass(frozen=True)
class ResultSet:
    """A page of rows and where it is among all."""

    rows: DataFrame
    count: int
    total_count: int
    page_index: int
    page_size: int | None
    capped: bool = False

    @property
    def page_count(self) -> int:
        return 1 if not self.page_size else -(-self.total_count // self.page_size)

    @property
    def is_last_page(self) -> bool:
        return self.page_index >= self.page_count - 1


@dataclass(frozen=True)
class NodeQuery:
    """A query of the nodes of a type. `orders` has the sort keys, the first one decides; ties go by id, so that every
    page is the same each time. A later order_by is a stable sort of what came before: its keys come first."""

    frame: DataFrame
    catalog: Catalog | None = None
    type_name: str | None = None
    context: Context = Context()
    key: str = "id"
    orders: tuple[Column, ...] = ()
    skipped: int = 0
    taken: int | None = None
    includes: tuple[relations.Include, ...] = ()

    @staticmethod
    def of(catalog: Catalog, type_name: str | None = None, context: Context = Context(), descendants: bool = True) -> NodeQuery:
        return NodeQuery(catalog.scan(type_name, descendants), catalog, type_name, context)

    @staticmethod
    def related(catalog: Catalog, relation: str, id_: Any, reverse: bool = False) -> NodeQuery:
        r = catalog.relations[relation]
        name = r.source if reverse else r.target
        return NodeQuery(catalog.related(relation, id_, reverse, name), catalog, name)

    # Filters: more than one hold together.

    def _with(self, frame: DataFrame) -> NodeQuery:
        if self.skipped or self.taken is not None:
            raise ValueError("filter before paging; to filter a page, start a query on its rows")
        return replace(self, frame=frame)

    def where(self, *predicates: Column) -> NodeQuery:
        return self._with(self.frame.where(logic.all_of(*predicates)))

    def where_id(self, *ids: Any) -> NodeQuery:
        return self._with(relations.in_ids(self.frame, ids, self.key))

    def where_in(self, column: str, values: Iterable[Any]) -> NodeQuery:
        return self._with(relations.in_ids(self.frame, values, column))

    def where_types(self, names: Iterable[str], descendants: bool = True) -> NodeQuery:
        wanted = {t for n in names for t in (self.catalog.descendants(n) if descendants else [n])}
        return self._with(self.frame.where(F.col(TYPE).isin(sorted(wanted))))

    def where_within(self, column: str, lat: float, lon: float, metres: float) -> NodeQuery:
        return self.where(geo.is_within(F.col(f"{column}.lat"), F.col(f"{column}.lon"), lat, lon, metres))

    def where_culture(self, culture: str | None, *fallbacks: str) -> NodeQuery:
        return replace(self, context=self.context.with_culture(culture, *fallbacks))

    def where_hidden(self, hidden: bool = True) -> NodeQuery:
        return replace(self, context=self.context.with_hidden(hidden))

    def where_search(self, index: search.TextIndex, text: str, any_term: bool = False) -> NodeQuery:
        return self._with(index.matching(self.frame, text, self.key, any_term))

    def relates(self, relation: str, *ids: Any, reverse: bool = False) -> NodeQuery:
        return self._with(relations.relates(self.frame, self.catalog.edges(relation, reverse), ids, self.key))

    def relates_not(self, relation: str, *ids: Any, reverse: bool = False) -> NodeQuery:
        return self._with(relations.relates_not(self.frame, self.catalog.edges(relation, reverse), ids, self.key))

    def has(self, path: list[str], id_: Any) -> NodeQuery:
        return self._with(relations.has_path(self.frame, [self.catalog.edges(r) for r in path], id_, self.key))

    def traverse(self, relation: str, least: int = 1, most: int = 1, direction: str = "default", budget: int = graph.MOST_VISITED) -> NodeQuery:
        """The nodes that those of this query reach, with their `level`."""
        r = self.catalog.relations[relation]
        nodes = self.catalog.scan(None if r.source != r.target else r.target)
        found = graph.traverse(nodes, self.visible().select(F.col(self.key).alias("id")), self.catalog.edges(relation), least, most, direction, budget)
        return NodeQuery(found, self.catalog, r.target, self.context)

    def shortest_path(self, relation: str, start: Any, end: Any, most: int = 1000, direction: str = "default") -> list[Any] | None:
        return graph.shortest_path(self.catalog.edges(relation), start, end, most, direction)

    # Order and pages.

    def order_by(self, *keys: Column | str, descending: bool = False) -> NodeQuery:
        made = []
        for k in keys:
            if isinstance(k, str):
                kind = self.frame.schema[k].dataType
                if isinstance(kind, T.StructType) and {"lat", "lon"} <= set(kind.names):
                    raise ValueError("coordinates have no order; order by the distance to a point")
                if isinstance(kind, T.MapType):
                    raise ValueError(f"{k} has no order")
                k = F.col(k)
            made.append(k.desc() if descending else k.asc())
        return replace(self, orders=(*made, *self.orders))

    def order_by_distance(self, column: str, lat: float, lon: float, descending: bool = False) -> NodeQuery:
        return self.order_by(geo.distance(F.col(f"{column}.lat"), F.col(f"{column}.lon"), lat, lon), descending=descending)

    def take(self, n: int) -> NodeQuery:
        return replace(self, taken=n if self.taken is None else min(n, self.taken))

    def skip(self, n: int) -> NodeQuery:
        left = None if self.taken is None else max(0, self.taken - n)
        return replace(self, skipped=self.skipped + n, taken=left)

    def page(self, index: int, size: int) -> NodeQuery:
        return self.skip(index * size).take(size)

    def include(self, *branches: relations.Include) -> NodeQuery:
        return replace(self, includes=relations.merge([*self.includes, *branches]))

    # Results.

    def visible(self) -> DataFrame:
        return self.context.visible(self.frame)

    def rows(self) -> DataFrame:
        """The rows of the page, in order."""
        df = self.visible()
        if self.orders or self.skipped or self.taken is not None:
            tie = [F.col(self.key).asc()] if self.key in df.columns else []
            df = df.orderBy(*self.orders, *tie)
        df = df.offset(self.skipped) if self.skipped else df
        df = df if self.taken is None else df.limit(self.taken)
        return relations.include(df, self.includes, self.key) if self.includes else df

    def select(self, *columns: Column | str, **named: Column) -> DataFrame:
        return self.rows().select(*columns, *(c.alias(n) for n, c in named.items()))

    def select_id(self) -> DataFrame:
        return self.rows().select(self.key)

    def count(self) -> int:
        return self.rows().count() if self.skipped or self.taken is not None else self.visible().count()

    def sum(self, value: Column | str) -> DataFrame:
        """One row (sum): 0 of nothing."""
        return self.rows().agg(F.coalesce(F.sum(value), F.lit(0)).alias("sum"))

    def first(self):
        """The first row, or None."""
        return next(iter(self.take(1).rows().collect()), None)

    def single(self):
        """The only row; an error if there are none or more."""
        found = self.take(2).rows().collect()
        if len(found) != 1:
            raise LookupError("no row" if not found else "more than one row")
        return found[0]

    def count_intersection(self, other: NodeQuery) -> DataFrame:
        """One row (count): how many nodes are in both queries, of whose nodes only the ids are read."""
        ids = lambda q: q.rows().select(F.col(q.key).alias("id"))
        return ids(self).distinct().join(ids(other), "id", "left_semi").agg(F.count(F.lit(1)).alias("count"))

    def exists(self) -> bool:
        return not self.visible().isEmpty()

    def result(self) -> ResultSet:
        size = self.taken
        return ResultSet(self.rows(), self.count(), self.visible().count(), self.skipped // size if size else 0, size)

    def facets(self, *facets: facet_ops.Facet) -> facet_ops.Facets:
        """Counts of the facets, of all columns that can have one if none is named."""
        allow = {p.name for p in self.catalog.properties(self.type_name) if p.facetable} if self.catalog and self.type_name else None
        chosen = list(facets) or facet_ops.facetable(self.visible(), lambda c: allow is None or c in allow)
        return facet_ops.count_facets(self.visible(), chosen)

    def search(self, index: search.TextIndex, text: str, any_term: bool = False, vector: str | None = None, embedded: list[float] | None = None, ratio: float = search.RATIO, least: float = search.LEAST_SIMILARITY) -> DataFrame:
        """The rows with their `score`, ranked by words, by vectors if there is one, or by both."""
        df = self.visible()
        if vector is None or embedded is None:
            hits = index.hits(text, any_term)
        else:
            hits = search.hybrid(df, index, text, vector, embedded, ratio, least, any_term, key=self.key)
        return df.join(hits.withColumnRenamed("id", self.key), self.key).orderBy(F.desc("score"), self.key)
