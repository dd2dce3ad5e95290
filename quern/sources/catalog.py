"""The data model: node types with parents, their properties, relations, and the frames that hold them."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TYPE = "__type"

#: Property kinds and the Spark types that hold them.
KINDS: dict[str, T.DataType] = {
    "boolean": T.BooleanType(),
    "integer": T.IntegerType(),
    "long": T.LongType(),
    "float": T.FloatType(),
    "double": T.DoubleType(),
    "decimal": T.DecimalType(38, 10),
    "string": T.StringType(),
    "string_array": T.ArrayType(T.StringType()),
    "datetime": T.TimestampType(),
    "datetime_offset": T.StructType([T.StructField("instant", T.TimestampType()), T.StructField("offset_min", T.IntegerType())]),
    "timespan": T.DayTimeIntervalType(),
    "guid": T.StringType(),
    "guid_array": T.ArrayType(T.StringType()),
    "enum_array": T.ArrayType(T.IntegerType()),
    "byte_array": T.ArrayType(T.ByteType()),
    "float_array": T.ArrayType(T.FloatType()),
    "file": T.StructType([T.StructField("name", T.StringType()), T.StructField("size", T.LongType()), T.StructField("hash", T.StringType())]),
    "geo": T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())]),
    "reference": T.StringType(),
    "references": T.ArrayType(T.StringType()),
}
UNORDERED = {"guid", "geo", "boolean", "file", "byte_array", "float_array"}
NO_FACET = {"guid", "geo", "file", "byte_array", "float_array"}


@dataclass(frozen=True)
class Property:
    """A property; `default` stands where a node has no value, `names` are those of an enumeration's numbers."""

    name: str
    kind: str
    default: Any = None
    facet: bool = True
    range_count: int = 0
    names: dict[int, str] = field(default_factory=dict)
    low: Any = None
    high: Any = None
    longest: int | None = None
    pattern: str | None = None
    unique: bool = False

    @property
    def type(self) -> T.DataType:
        return KINDS[self.kind]

    @property
    def facetable(self) -> bool:
        return self.facet and self.kind not in NO_FACET

    def broken(self) -> Column:
        """Where a value breaks the property's limits."""
        value, rules = F.col(self.name), F.lit(False)
        if self.low is not None:
            rules = rules | (value < F.lit(self.low))
        if self.high is not None:
            rules = rules | (value > F.lit(self.high))
        if self.longest is not None:
            rules = rules | (F.length(value) > self.longest)
        if self.pattern is not None:
            rules = rules | ~value.rlike(self.pattern)
        return F.coalesce(rules, F.lit(False))


@dataclass(frozen=True)
class NodeType:
    name: str
    properties: tuple[Property, ...] = ()
    parents: tuple[str, ...] = ()


@dataclass(frozen=True)
class Relation:
    """Edges from a source type to a target type; symmetric kinds hold in both directions."""

    name: str
    source: str
    target: str
    kind: str = "many_to_many"  # one_one, one_to_one, one_to_many, many_many, many_to_many

    @property
    def symmetric(self) -> bool:
        return self.kind in ("one_one", "many_many")


class Catalog:
    """Types, relations and their frames. Node frames have `id`; edge frames have src, dst and, if ordered, ord."""

    def __init__(self, spark: SparkSession, types: Iterable[NodeType], relations: Iterable[Relation] = ()):
        self.spark = spark
        self.types = {t.name: t for t in types}
        self.relations = {r.name: r for r in relations}
        self._nodes: dict[str, DataFrame] = {}
        self._edges: dict[str, DataFrame] = {}

    def add_nodes(self, type_name: str, frame: DataFrame, id_column: str = "id") -> Catalog:
        """Hold the nodes of exactly this type; missing values become the properties' defaults."""
        frame = frame.withColumnRenamed(id_column, "id") if id_column != "id" else frame
        for p in self.properties(type_name):
            if p.name not in frame.columns:
                frame = frame.withColumn(p.name, F.lit(p.default).cast(p.type))
            elif p.default is not None:
                frame = frame.withColumn(p.name, F.coalesce(p.name, F.lit(p.default).cast(p.type)))
        self._nodes[type_name] = frame.withColumn(TYPE, F.lit(type_name))
        return self

    def add_edges(self, relation: str, frame: DataFrame) -> Catalog:
        self._edges[relation] = frame
        return self

    def ancestors(self, name: str) -> list[str]:
        found: list[str] = []
        for parent in self.types[name].parents:
            found += [parent, *self.ancestors(parent)]
        return list(dict.fromkeys(found))

    def descendants(self, name: str) -> list[str]:
        """The type and all below it."""
        return [t for t in self.types if t == name or name in self.ancestors(t)]

    def properties(self, name: str) -> list[Property]:
        """Own and inherited; the nearest definition of a name counts."""
        found = {p.name: p for t in reversed([name, *self.ancestors(name)]) for p in self.types[t].properties}
        return list(found.values())

    def scan(self, name: str | None = None, descendants: bool = True) -> DataFrame:
        """The nodes of a type, with those of the types below it; without a name all nodes."""
        if name is not None and name not in self.types:
            raise KeyError(f"no type named {name}")
        wanted = list(self.types) if name is None else self.descendants(name) if descendants else [name]
        frames = [self._nodes[t] for t in wanted if t in self._nodes]
        if not frames:
            raise KeyError(f"no nodes of type {name}")
        whole = frames[0]
        for more in frames[1:]:
            whole = whole.unionByName(more, allowMissingColumns=True)
        return whole

    def get(self, name: str | None, *ids: Any) -> DataFrame:
        return self.scan(name).where(F.col("id").isin(list(ids)))

    def exists(self, id_: Any, name: str | None = None) -> bool:
        return not self.get(name, id_).isEmpty()

    def edges(self, relation: str, reverse: bool = False) -> DataFrame:
        """(src, dst, ord) in the wanted direction; symmetric relations in both."""
        frame = self._edges[relation]
        frame = frame if "ord" in frame.columns else frame.withColumn("ord", F.lit(0))
        back = frame.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "ord")
        frame = frame.select("src", "dst", "ord")
        if self.relations[relation].symmetric:
            return frame.unionByName(back).dropDuplicates(["src", "dst"])
        return back if reverse else frame

    def contains_relation(self, relation: str, src: Any, dst: Any, reverse: bool = False) -> bool:
        return not self.edges(relation, reverse).where((F.col("src") == F.lit(src)) & (F.col("dst") == F.lit(dst))).isEmpty()

    def related(self, relation: str, id_: Any, reverse: bool = False, name: str | None = None) -> DataFrame:
        """The nodes that one node is related to."""
        ends = self.edges(relation, reverse).where(F.col("src") == F.lit(id_)).select(F.col("dst").alias("id"))
        return self.scan(name).join(ends, "id", "left_semi")

    def related_counts(self, relation: str, reverse: bool = False) -> DataFrame:
        return self.edges(relation, reverse).groupBy("src").agg(F.count(F.lit(1)).alias("n"))

    def counts(self) -> DataFrame:
        """Nodes of each type."""
        frames = [f.select(TYPE) for f in self._nodes.values()]
        whole = frames[0]
        for more in frames[1:]:
            whole = whole.unionByName(more)
        return whole.groupBy(TYPE).count()

    def check(self, name: str) -> DataFrame:
        """(id, property) of values that break their property's limits or, where they must be unique, recur."""
        frame, found = self.scan(name), None
        for p in self.properties(name):
            bad = frame.where(p.broken()).select("id", F.lit(p.name).alias("property"))
            if p.unique:
                value = F.explode(p.name) if isinstance(p.type, T.ArrayType) else F.col(p.name)
                values = frame.select("id", value.alias("value")).where(F.col("value").isNotNull()).distinct()
                twice = values.groupBy("value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
                bad = bad.unionByName(values.join(twice, "value", "left_semi").select("id", F.lit(p.name).alias("property")).distinct())
            found = bad if found is None else found.unionByName(bad)
        return found

    def check_relation(self, relation: str) -> DataFrame:
        """Edges that break the relation's cardinality, as (side, id, n)."""
        kind = self.relations[relation].kind
        out = lambda side: self.edges(relation).groupBy(F.col(side).alias("id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit(side).alias("side"), "id", "n")
        sides = {"one_one": ["src"], "one_to_one": ["src", "dst"], "one_to_many": ["dst"]}.get(kind, [])
        frames = [out(s) for s in sides] or [out("src").limit(0)]
        return frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1])
