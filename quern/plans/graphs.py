"""Traversal, shortest paths and coordinates."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import geo
from quern.operators import graph
from quern.plans.base import query
from quern.sources.files import table
from quern.sources.shared import written

#: Edges of the graph of parts and orders: all lines, keys made distinct.
_EDGES = "e AS (SELECT DISTINCT l_partkey AS src, l_orderkey + 10000000 AS dst FROM lineitem)"
_BOTH = f"{_EDGES}, b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e)"


def _edges(spark, sf_dir):
    """Written once: nodes, both directions and further searches are made of it."""
    return written(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), (F.col("l_orderkey") + 10000000).alias("dst")).distinct())


def _seed(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(F.min("l_partkey").alias("id"))


@query(f"""WITH RECURSIVE {_BOTH}, r(id, level) AS (SELECT min(src), 0 FROM e UNION SELECT b.dst, r.level + 1 FROM r JOIN b ON b.src = r.id WHERE r.level < 3)
SELECT id, CAST(min(level) AS INTEGER) AS level FROM r GROUP BY id HAVING min(level) BETWEEN 1 AND 3""")
def g_traverse(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    nodes = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    return graph.traverse(nodes, _seed(spark, sf_dir), edges, 1, 3, "both")


@query("""WITH t AS (SELECT CAST(n_nationkey AS BIGINT) + 100 AS id, 1 AS level FROM nation UNION ALL SELECT c_custkey + 1000, 2 FROM customer)
SELECT id, CAST(level AS INTEGER) AS level FROM t WHERE id IN (SELECT n_nationkey + 100 FROM nation WHERE n_regionkey = 1)
OR id IN (SELECT c_custkey + 1000 FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 1)""")
def g_traverse_tree(spark, sf_dir):
    nation, customer = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    down = nation.select(F.col("n_regionkey").cast("long").alias("src"), (F.col("n_nationkey") + 100).cast("long").alias("dst"))
    down = down.unionByName(customer.select((F.col("c_nationkey") + 100).cast("long").alias("src"), (F.col("c_custkey") + 1000).alias("dst")))
    nodes = down.select(F.col("dst").alias("id"))
    return graph.traverse(nodes, spark.range(1, 2), down, 1, 5)


@query(f"""WITH RECURSIVE {_BOTH}, r(id, level) AS (SELECT min(src), 0 FROM e UNION SELECT b.dst, r.level + 1 FROM r JOIN b ON b.src = r.id WHERE r.level < 6),
d AS (SELECT id, min(level) AS level FROM r GROUP BY id), x AS (SELECT CAST(max(id) AS BIGINT) AS id FROM d WHERE level = 3)
SELECT CAST(level AS INTEGER) AS steps, x.id AS target FROM x JOIN d ON d.id = x.id""")
def g_shortest_path(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    start = _seed(spark, sf_dir).first()["id"]
    target = graph.levels(_seed(spark, sf_dir), edges, 3, "both").where("level = 3").agg(F.max("id").alias("id")).first()["id"]
    path = graph.shortest_path(edges, start, target, 6, "both")
    return spark.createDataFrame([(len(path) - 1, target)], "steps int, target long")


_PLACE = "SELECT c_custkey AS id, (c_custkey * 7919 % 18000) / 100.0 - 90 AS lat, (c_custkey * 104729 % 36000) / 100.0 - 180 AS lon FROM customer"
_DISTANCE = "2 * 6371000.0 * asin(least(1, sqrt(pow(sin((radians(59.9) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(59.9)) * pow(sin((radians(10.7) - radians(lon)) / 2), 2))))"


def _places(spark, sf_dir):
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(key.alias("id"), (key * 7919 % 18000 / 100.0 - 90).alias("lat"), (key * 104729 % 36000 / 100.0 - 180).alias("lon"))


@query(f"WITH p AS ({_PLACE}) SELECT id FROM p WHERE {_DISTANCE} <= 1500000")
def geo_is_within(spark, sf_dir):
    return _places(spark, sf_dir).where(geo.is_within(F.col("lat"), F.col("lon"), 59.9, 10.7, 1_500_000)).select("id")


@query(f"WITH p AS ({_PLACE}) SELECT id FROM p WHERE {_DISTANCE} <= 1500000")
def geo_covered(spark, sf_dir):
    lat, lon = F.col("lat"), F.col("lon")
    coded = _places(spark, sf_dir).withColumn("code", geo.zcode(lat, lon))
    stored = written(coded.repartitionByRange("code").sortWithinPartitions("code"))
    return stored.where(geo.is_within(lat, lon, 59.9, 10.7, 1_500_000, F.col("code"))).select("id")


@query(f"WITH p AS ({_PLACE}) SELECT id, round({_DISTANCE}, 3) AS metres FROM p ORDER BY {_DISTANCE}, id LIMIT 20")
def geo_nearest(spark, sf_dir):
    metres = geo.distance(F.col("lat"), F.col("lon"), 59.9, 10.7)
    return _places(spark, sf_dir).withColumn("metres", metres).orderBy("metres", "id").limit(20).select("id", F.round("metres", 3).alias("metres"))


@query(f"""WITH p AS ({_PLACE}) SELECT id, CAST(floor((lat + 90) * 2147483648.0 / 180) AS BIGINT) AS cell,
round((floor((lat + 90) * (2147483648.0 / 180)) + 0.5) / (2147483648.0 / 180) - 90, 9) AS snapped FROM p""")
def geo_snap(spark, sf_dir):
    lat = F.col("lat")
    return _places(spark, sf_dir).select("id", F.floor((lat + 90.0) * geo.CELLS / 180.0).alias("cell"), F.round(geo.snap_lat(lat), 9).alias("snapped"))
