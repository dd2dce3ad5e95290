"""Relations: semi and anti filters, paths, includes and references."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import mutations, relations
from quern.operators.query import NodeQuery
from quern.operators.relations import Include
from quern.plans.base import graph_catalog, query
from quern.sources.files import table


@query("SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey = 7)")
def j_relates(spark, sf_dir):
    return NodeQuery.of(graph_catalog(spark, sf_dir), "nation").relates("customers", 7).select("id", "name")


@query("SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_suppkey IN (1, 2, 3))")
def j_relates_any(spark, sf_dir):
    return NodeQuery.of(graph_catalog(spark, sf_dir), "nation").relates("suppliers", 1, 2, 3, -1).select("id", "name")


@query("SELECT c_custkey AS id FROM customer WHERE c_nationkey NOT IN (3, 4, 5)")
def j_relates_not(spark, sf_dir):
    return NodeQuery.of(graph_catalog(spark, sf_dir), "customer").relates_not("customers", 3, 4, 5, 999, reverse=True).select_id()


@query("""SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS name FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation JOIN customer ON c_nationkey = n_nationkey
JOIN orders ON o_custkey = c_custkey WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders))""")
def j_has_path(spark, sf_dir):
    catalog = graph_catalog(spark, sf_dir)
    first = catalog.scan("order").agg(F.min("id").alias("id")).first()["id"]
    return NodeQuery.of(catalog, "region").has(["nations", "customers", "orders"], first).select("id", "name")


@query("SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_nationkey = 2")
def j_related_nodes(spark, sf_dir):
    return NodeQuery.related(graph_catalog(spark, sf_dir), "customers", 2).select("id", "name")


@query("SELECT o_custkey AS id, count(*) AS n FROM orders GROUP BY o_custkey")
def j_related_counts(spark, sf_dir):
    return graph_catalog(spark, sf_dir).related_counts("orders").select(F.col("src").alias("id"), "n")


@query("""WITH n AS (SELECT r_regionkey, r_name, n_nationkey, n_name, row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) AS k
FROM region LEFT JOIN nation ON n_regionkey = r_regionkey)
SELECT CAST(r_regionkey AS BIGINT) AS id, CAST(k - 1 AS INTEGER) AS place, n_name AS nation FROM n WHERE n_name IS NOT NULL""")
def j_include(spark, sf_dir):
    catalog = graph_catalog(spark, sf_dir)
    q = NodeQuery.of(catalog, "region").include(Include("nations", catalog.edges("nations"), catalog.scan("nation")))
    return q.rows().select("id", F.posexplode("nations").alias("place", "n")).select("id", "place", F.col("n.name").alias("nation"))


@query("""WITH o AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders WHERE o_totalprice > 150000)
SELECT c_custkey AS id, round(coalesce(sum(o_totalprice), 0), 2) AS price, count(o_orderkey) AS orders FROM customer LEFT JOIN o ON o_custkey = c_custkey AND k <= 2 GROUP BY c_custkey""")
def j_include_top_filter(spark, sf_dir):
    catalog = graph_catalog(spark, sf_dir)
    branch = Include("orders", catalog.edges("orders"), catalog.scan("order").select("id", "price"), where=(F.col("price") > 150000,), top=2)
    rows = NodeQuery.of(catalog, "customer").include(branch).rows()
    total = F.aggregate("orders", F.lit(0.0), lambda s, o: s + o["price"])
    return rows.select("id", F.round(total, 2).alias("price"), F.size("orders").cast("long").alias("orders"))


@query("""SELECT CAST(r_regionkey AS BIGINT) AS id, n_name AS nation, s_suppkey AS supplier FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey""")
def j_then_include(spark, sf_dir):
    catalog = graph_catalog(spark, sf_dir)
    below = Include("suppliers", catalog.edges("suppliers"), catalog.scan("supplier").select("id"))
    branch = Include("nations", catalog.edges("nations"), catalog.scan("nation").select("id", "name"), then=(below,))
    rows = NodeQuery.of(catalog, "region").include(branch).rows()
    nations = rows.select("id", F.explode("nations").alias("n"))
    return nations.select("id", F.col("n.name").alias("nation"), F.explode("n.suppliers.id").alias("supplier"))


@query("SELECT c_custkey AS id, n_name AS nation FROM customer JOIN nation ON n_nationkey = c_nationkey")
def j_include_single(spark, sf_dir):
    catalog = graph_catalog(spark, sf_dir)
    branch = Include("nation", catalog.edges("customers", reverse=True), catalog.scan("nation").select("id", "name"), single=True)
    return NodeQuery.of(catalog, "customer").include(branch).select("id", nation=F.col("nation.name"))


@query("""WITH r AS (SELECT o_orderkey, unnest([o_custkey, o_custkey + 1000000, o_custkey % 7 + 1, o_custkey]) AS ref, generate_subscripts([1, 2, 3, 4], 1) AS pos FROM orders),
j AS (SELECT o_orderkey, pos, c_name FROM r JOIN customer ON c_custkey = ref)
SELECT o_orderkey AS id, string_agg(c_name, ',' ORDER BY pos) AS names FROM j GROUP BY o_orderkey""")
def j_include_references(spark, sf_dir):
    key = F.col("o_custkey")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.array(key, key + 1000000, key % 7 + 1, key).alias("refs"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_name")
    found = relations.include_references(orders, "refs", customers, "customers")
    return found.where(F.size("customers") > 0).select("id", F.array_join(F.transform("customers", lambda c: c["c_name"]), ",").alias("names"))


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal * 2 ELSE c_acctbal END AS balance FROM customer WHERE c_custkey % 10 <> 0
UNION ALL SELECT c_custkey + 1000000, 0 FROM customer WHERE c_custkey % 500 = 0""")
def m_upsert_delete(spark, sf_dir):
    nodes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    new = nodes.where("id % 500 = 0").select((F.col("id") + 1000000).alias("id"), F.lit(0.0).alias("balance"))
    doubled = nodes.where("id % 3 = 0").select("id", (F.col("balance") * 2).alias("balance"))
    return mutations.delete(mutations.upsert(nodes, new.unionByName(doubled)), nodes.where("id % 10 = 0"))


@query("SELECT p_partkey AS id, CASE WHEN p_size > 40 THEN p_size + 5 ELSE p_size END AS size FROM part")
def m_add_to_property(spark, sf_dir):
    nodes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("size"))
    return mutations.set_property(nodes, F.col("size") > 40, size=F.col("size") + 5)


@query("""SELECT o_custkey AS src, o_orderkey AS dst FROM orders WHERE o_custkey % 4 <> 1 AND o_orderkey % 6 <> 0 AND o_custkey % 4 <> 2
UNION ALL SELECT DISTINCT o_custkey, CAST(-1 AS BIGINT) FROM orders WHERE o_custkey % 4 = 2""")
def m_relations(spark, sf_dir):
    edges = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"))
    gone = mutations.clear_related(edges, edges.where("src % 4 = 1").select(F.col("src").alias("id")).distinct())
    gone = mutations.unrelate(gone, edges.where("dst % 6 = 0"))
    new = edges.where("src % 4 = 2").select("src").distinct().withColumn("dst", F.lit(-1).cast("long"))
    return mutations.relate(mutations.set_related(gone, new), new)
