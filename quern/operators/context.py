"""Who sees what: deleted, unpublished, hidden and foreign nodes, cultures, and the revision that counts."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Context:
    """What a query may see. Node frames may have the columns deleted, hidden, released, expires, culture, collection,
    readers (ids of groups; null or empty: everyone), revision; a rule counts where its column is there."""

    now: datetime | None = None
    culture: str | None = None
    fallbacks: tuple[str, ...] = ()
    groups: tuple[str, ...] = ()
    collections: tuple[str, ...] = ()
    deleted: bool = False
    unpublished: bool = False
    hidden: bool = False
    admin: bool = False

    def with_culture(self, culture: str | None, *fallbacks: str) -> Context:
        return replace(self, culture=culture, fallbacks=fallbacks)

    def with_hidden(self, hidden: bool = True) -> Context:
        return replace(self, hidden=hidden)

    def _cultures(self) -> list[str]:
        return [c for c in (self.culture, *self.fallbacks) if c]

    def sees(self, columns: list[str]) -> Column:
        """The predicate of what is visible."""
        has = set(columns)
        rules = [F.lit(True)]
        if "deleted" in has and not self.deleted:
            rules.append(~F.coalesce("deleted", F.lit(False)))
        if "hidden" in has and not self.hidden:
            rules.append(~F.coalesce("hidden", F.lit(False)))
        if self.now is not None and not self.unpublished:
            if "released" in has:
                rules.append(F.coalesce(F.col("released") <= F.lit(self.now), F.lit(True)))
            if "expires" in has:
                rules.append(F.coalesce(F.col("expires") > F.lit(self.now), F.lit(True)))
        if "culture" in has and self.culture:
            rules.append(F.col("culture").isNull() | F.col("culture").isin(self._cultures()))
        if "collection" in has and self.collections:
            rules.append(F.coalesce(F.col("collection").isin(list(self.collections)), F.lit(False)))
        if "readers" in has and not self.admin:
            mine = F.arrays_overlap("readers", F.array(*map(F.lit, self.groups)).cast("array<string>")) if self.groups else F.lit(False)
            rules.append(F.col("readers").isNull() | (F.size("readers") == 0) | F.coalesce(mine, F.lit(False)))
        whole = rules[0]
        for r in rules[1:]:
            whole = whole & r
        return whole

    def visible(self, nodes: DataFrame) -> DataFrame:
        return nodes.where(self.sees(nodes.columns))

    def best_revision(self, nodes: DataFrame, selected: dict | None = None, key: str = "id") -> DataFrame:
        """One revision of each node: the selected one, else a published one of the culture, then of the fallbacks in
        their order, then of no culture; ties go to the higher `revision`."""
        rank = F.lit(90)
        rank = F.when(F.col("culture").isNull(), 50).otherwise(rank)
        for k, culture in reversed(list(enumerate(self._cultures()))):
            rank = F.when(F.col("culture") == culture, 10 + k).otherwise(rank)
        if selected:
            wanted = F.create_map(*(F.lit(x) for pair in selected.items() for x in pair))
            rank = F.when(F.coalesce(wanted[F.col(key)] == F.col("revision"), F.lit(False)), 0).otherwise(rank)
        order = Window.partitionBy(key).orderBy("__rank", F.desc("revision"))
        ranked = self.visible(nodes).withColumn("__rank", rank).where(F.col("__rank") < 90)
        return ranked.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__rank", "__n")
