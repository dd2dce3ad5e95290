"""Registering queries with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.query import NodeQuery
from quern.sources.catalog import Catalog, NodeType, Relation
from quern.sources.files import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its name."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


def nodes(spark: SparkSession, sf_dir: str, name: str, key: str) -> NodeQuery:
    """A query of a table whose key column is `key`."""
    return NodeQuery(table(spark, sf_dir, name), key=key)


def graph_catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    """Regions, nations, customers and suppliers as parties, orders, and the relations between them."""
    t = lambda name: table(spark, sf_dir, name)
    catalog = Catalog(
        spark,
        [NodeType("place"), NodeType("region", parents=("place",)), NodeType("nation", parents=("place",)), NodeType("party"),
         NodeType("customer", parents=("party",)), NodeType("supplier", parents=("party",)), NodeType("order")],
        [Relation("nations", "region", "nation", "one_to_many"), Relation("customers", "nation", "customer", "one_to_many"),
         Relation("suppliers", "nation", "supplier", "one_to_many"), Relation("orders", "customer", "order", "one_to_many")],
    )
    catalog.add_nodes("region", t("region").select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("name")))
    catalog.add_nodes("nation", t("nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name")))
    catalog.add_nodes("customer", t("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")))
    catalog.add_nodes("supplier", t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")))
    catalog.add_nodes("order", t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"), F.col("o_orderdate").alias("date"), F.col("o_orderstatus").alias("status")))
    edges = lambda frame, src, dst, order: frame.select(F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst"), F.col(order).alias("ord"))
    catalog.add_edges("nations", edges(t("nation"), "n_regionkey", "n_nationkey", "n_nationkey"))
    catalog.add_edges("customers", edges(t("customer"), "c_nationkey", "c_custkey", "c_custkey"))
    catalog.add_edges("suppliers", edges(t("supplier"), "s_nationkey", "s_suppkey", "s_suppkey"))
    catalog.add_edges("orders", edges(t("orders"), "o_custkey", "o_orderkey", "o_orderkey"))
    return catalog
