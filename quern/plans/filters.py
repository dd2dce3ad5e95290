"""Filters, projections, order, pages, aggregates and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import filters, logic
from quern.operators.context import Context
from quern.operators.query import NodeQuery
from quern.plans.base import graph_catalog, nodes, query
from quern.sources import files
from quern.sources.files import table


@query("""SELECT o_orderkey, o_totalprice, o_orderdate FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 100000
ORDER BY o_orderdate DESC, o_orderkey LIMIT 50""")
def f_where_and(spark, sf_dir):
    q = nodes(spark, sf_dir, "orders", "o_orderkey").where(logic.eq(F.col("o_orderpriority"), "1-URGENT"), logic.gt(F.col("o_totalprice"), 100000))
    return q.order_by("o_orderdate", descending=True).page(0, 50).select("o_orderkey", "o_totalprice", "o_orderdate")


@query("SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F') AND (o_totalprice < 50000 OR o_orderpriority = '5-LOW')")
def f_where_or_not(spark, sf_dir):
    low = logic.any_of(logic.lt(F.col("o_totalprice"), 50000), logic.eq(F.col("o_orderpriority"), "5-LOW"))
    return nodes(spark, sf_dir, "orders", "o_orderkey").where(logic.negate(logic.eq(F.col("o_orderstatus"), "F")), low).select_id()


@query("""SELECT d.doc_id, quality IS NOT DISTINCT FROM NULL AS is_null, quality IS DISTINCT FROM 1 AS not_one, coalesce(quality < 1, false) AS below
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def f_two_valued_nulls(spark, sf_dir):
    joined = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    quality = F.col("quality")
    return joined.select("doc_id", logic.eq(quality, None).alias("is_null"), logic.ne(quality, 1).alias("not_one"), logic.lt(quality, 1).alias("below"))


@query("SELECT p_partkey, p_size + 2 * 3 AS plus, -p_size AS negative, CAST(p_size // 4 AS BIGINT) AS quarter, p_retailprice / 3 AS third, p_name || '!' AS name FROM part")
def s_arithmetic(spark, sf_dir):
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select(
        "p_partkey", (size + F.lit(2) * 3).alias("plus"), (-size).alias("negative"), logic.divide(size, 4, whole=True).alias("quarter"),
        (F.col("p_retailprice") / 3).alias("third"), F.concat("p_name", F.lit("!")).alias("name"),
    )


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity * 2 > l_extendedprice / 1000 AND l_shipdate < TIMESTAMP '1995-06-01'")
def f_property_to_property(spark, sf_dir):
    inside = (F.col("l_quantity") * 2 > F.col("l_extendedprice") / 1000, F.col("l_shipdate") < F.lit("1995-06-01").cast("timestamp"))
    return table(spark, sf_dir, "lineitem").where(logic.all_of(*inside)).select("l_orderkey", "l_linenumber")


@query("SELECT p_partkey, p_brand FROM part WHERE p_brand IN ('Brand#11', 'Brand#12', 'Brand#13')")
def f_where_in(spark, sf_dir):
    return nodes(spark, sf_dir, "part", "p_partkey").where_in("p_brand", ["Brand#11", None, "Brand#12", "Brand#13"]).select("p_partkey", "p_brand")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey <= 2500 AND c_custkey % 2 = 1")
def f_where_in_ids_long(spark, sf_dir):
    return nodes(spark, sf_dir, "customer", "c_custkey").where_id(*range(1, 2501, 2), 10**12).select("c_custkey", "c_name")


@query("SELECT c_custkey FROM customer WHERE false")
def f_where_no_ids(spark, sf_dir):
    return nodes(spark, sf_dir, "customer", "c_custkey").where_id().select_id()


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1995-03-31'")
def f_in_range(spark, sf_dir):
    day = lambda s: F.lit(s).cast("timestamp")
    return table(spark, sf_dir, "orders").where(logic.in_range(F.col("o_orderdate"), day("1995-01-01"), day("1995-03-31"))).select("o_orderkey", "o_orderdate")


@query("SELECT p_partkey, p_name FROM part WHERE starts_with(p_name, 'b') OR contains(p_type, 'CONO')")
def f_string_match(spark, sf_dir):
    return nodes(spark, sf_dir, "part", "p_partkey").where(logic.any_of(logic.starts_with(F.col("p_name"), "b"), logic.contains(F.col("p_type"), "CONO"))).select("p_partkey", "p_name")


@query("SELECT doc_id FROM documents WHERE list_contains(string_split(text, ' '), 'the') AND NOT list_contains(string_split(text, ' '), 'and')")
def f_array_contains(spark, sf_dir):
    from pyspark.sql import types as T

    words, kind = F.split("text", " "), T.ArrayType(T.StringType())
    docs = table(spark, sf_dir, "documents")
    return docs.where(logic.all_of(logic.has_element(words, kind, "the"), logic.negate(logic.has_element(words, kind, "and")))).select("doc_id")


@query("SELECT count(*) AS n FROM orders WHERE 2 + 2 = 4")
def f_constant(spark, sf_dir):
    return table(spark, sf_dir, "orders").where(F.lit(2) + F.lit(2) == F.lit(4)).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderkey FROM orders WHERE o_orderdate <= TIMESTAMP '1995-02-01' AND o_orderdate + INTERVAL 30 DAY >= TIMESTAMP '1995-01-15'""")
def f_range_overlap(spark, sf_dir):
    start = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").where(
        logic.overlaps(start, start + F.expr("INTERVAL 30 DAY"), F.lit("1995-01-15").cast("timestamp"), F.lit("1995-02-01").cast("timestamp"))
    ).select("o_orderkey")


@query("""SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'O' OR o_totalprice >= 200000) AND NOT (o_orderpriority IN ('1-URGENT', '2-HIGH'))
ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 20""")
def f_filter_dictionary(spark, sf_dir):
    spec = {"or": [{"o_orderstatus": {"eq": "O"}}, {"o_totalprice": {"gte": 200000}}], "not": {"o_orderpriority": {"in": ["1-URGENT", "2-HIGH"]}}, "o_custkey": {"nin": []}}
    return filters.listing(table(spark, sf_dir, "orders"), spec, order_by="o_totalprice", descending=True, page=1, page_size=20, key="o_orderkey").rows.select("o_orderkey")


@query("""WITH v AS (SELECT doc_id, lang, source, doc_id % 7 = 0 AS deleted, doc_id % 11 = 0 AS hidden,
  TIMESTAMP '2024-01-01' + INTERVAL (doc_id % 30) DAY AS released FROM documents)
SELECT doc_id, lang FROM v WHERE NOT deleted AND NOT hidden AND released <= TIMESTAMP '2024-01-15' AND lang IN ('fr', 'en')""")
def c_visible(spark, sf_dir):
    from datetime import datetime

    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.col("lang").alias("culture"), (F.col("doc_id") % 7 == 0).alias("deleted"), (F.col("doc_id") % 11 == 0).alias("hidden"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval((F.col("doc_id") % 30).cast("int"))).alias("released"),
    )
    return Context(now=datetime(2024, 1, 15)).with_culture("fr", "en").visible(docs).select("doc_id", F.col("culture").alias("lang"))


@query("""WITH r AS (SELECT source, lang, doc_id, row_number() OVER (PARTITION BY source ORDER BY CASE lang WHEN 'es' THEN 0 WHEN 'de' THEN 1 END, doc_id DESC) AS n
  FROM documents WHERE lang IN ('es', 'de'))
SELECT source, lang, doc_id AS revision FROM r WHERE n = 1""")
def c_best_revision(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("id"), F.col("lang").alias("culture"), F.col("doc_id").alias("revision"))
    return Context().with_culture("es", "de").best_revision(docs).select(F.col("id").alias("source"), F.col("culture").alias("lang"), "revision")


@query("SELECT id, name, type FROM (SELECT c_custkey AS id, c_name AS name, 'customer' AS type FROM customer UNION ALL SELECT s_suppkey, s_name, 'supplier' FROM supplier)")
def t_scan_descendants(spark, sf_dir):
    return NodeQuery.of(graph_catalog(spark, sf_dir), "party").select("id", "name", type=F.col("__type"))


@query("""SELECT type, count(*) AS n FROM (SELECT 'region' AS type FROM region UNION ALL SELECT 'nation' FROM nation UNION ALL SELECT 'customer' FROM customer
UNION ALL SELECT 'supplier' FROM supplier UNION ALL SELECT 'order' FROM orders) GROUP BY type""")
def t_type_counts(spark, sf_dir):
    return graph_catalog(spark, sf_dir).counts().select(F.col("__type").alias("type"), F.col("count").alias("n"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name FROM nation")
def t_where_types(spark, sf_dir):
    return NodeQuery.of(graph_catalog(spark, sf_dir)).where_types(["nation"]).select("id", "name")


@query("SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey IN (1, 5, 9)")
def t_get_by_ids(spark, sf_dir):
    return graph_catalog(spark, sf_dir).get("customer", 1, 5, 9, -4).select("id", "name")


@query("SELECT o_orderkey, o_custkey, o_orderdate FROM orders ORDER BY o_custkey DESC, o_orderdate, o_orderkey LIMIT 40 OFFSET 60")
def o_order_chain_page(spark, sf_dir):
    q = nodes(spark, sf_dir, "orders", "o_orderkey").order_by("o_orderdate").order_by("o_custkey", descending=True)
    return q.skip(60).take(40).select("o_orderkey", "o_custkey", "o_orderdate")


@query("SELECT 200 AS count, (SELECT count(*) FROM lineitem) AS total_count, 3 AS page_index, ceil((SELECT count(*) FROM lineitem) / 200.0)::INT AS page_count, false AS is_last_page")
def o_page_result(spark, sf_dir):
    r = NodeQuery(table(spark, sf_dir, "lineitem"), key="l_orderkey").page(3, 200).result()
    return spark.createDataFrame([(r.count, r.total_count, r.page_index, r.page_count, r.is_last_page)], "count int, total_count long, page_index int, page_count int, is_last_page boolean")


@query("SELECT round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum FROM lineitem WHERE l_returnflag = 'R'")
def a_sum(spark, sf_dir):
    q = NodeQuery(table(spark, sf_dir, "lineitem"), key="l_orderkey").where(logic.eq(F.col("l_returnflag"), "R"))
    return q.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).select(F.round("sum", 2).alias("sum"))


@query("SELECT CAST(0 AS DOUBLE) AS sum FROM region WHERE r_regionkey = 0")
def a_sum_of_nothing(spark, sf_dir):
    return NodeQuery(table(spark, sf_dir, "lineitem"), key="l_orderkey").where(F.lit(False)).sum("l_tax").select(F.col("sum"))


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice), 2) AS price, round(avg(l_discount), 6) AS discount, min(l_shipdate) AS first,
max(l_shipdate) AS last, count(DISTINCT l_suppkey) AS suppliers, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def a_grouped(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum("l_extendedprice"), 2).alias("price"), F.round(F.avg("l_discount"), 6).alias("discount"), F.min("l_shipdate").alias("first"),
        F.max("l_shipdate").alias("last"), F.count_distinct("l_suppkey").alias("suppliers"), F.count(F.lit(1)).alias("n"),
    )


@query("""(SELECT o_custkey AS id FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')
EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'""")
def x_set_operations(spark, sf_dir):
    by = lambda s: table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("id"))
    return by("F").intersect(by("O")).subtract(by("P"))


@query("""SELECT count(*) AS count FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')""")
def x_count_intersection(spark, sf_dir):
    orders = nodes(spark, sf_dir, "orders", "o_custkey")
    return orders.where(logic.eq(F.col("o_orderstatus"), "F")).count_intersection(orders.where(logic.eq(F.col("o_orderstatus"), "O")))


@query("""WITH a AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_totalprice > 200000), b AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderstatus = 'P')
(SELECT id FROM a EXCEPT SELECT id FROM b) UNION ALL (SELECT id FROM b EXCEPT SELECT id FROM a)""")
def x_symmetric_difference(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    a = orders.where("o_totalprice > 200000").select(F.col("o_custkey").alias("id")).distinct()
    b = orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id")).distinct()
    return a.join(b, "id", "left_anti").unionByName(b.join(a, "id", "left_anti"))


@query("SELECT event_id, ts, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-11' ORDER BY ts DESC, event_id DESC LIMIT 30 OFFSET 10")
def l_extract(spark, sf_dir):
    day = lambda d: F.lit(f"2024-01-{d}").cast("timestamp")
    return files.extract(table(spark, sf_dir, "events"), day(10), day(11), skip=10, take=30, descending=True).select("event_id", "ts", "event_type")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def s_json_property(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", files.embedded(F.col("props"), "$.k").cast("int").alias("k"))


@query("""SELECT '{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}' AS json FROM region""")
def k_json_rows(spark, sf_dir):
    return files.json_rows(table(spark, sf_dir, "region").select("r_regionkey", "r_name"))
