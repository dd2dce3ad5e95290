"""Facets: values, ranges, missing, selections, options, arrays and relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators.facets import Facet, count_facets, relation_facet
from quern.plans.base import graph_catalog, query
from quern.sources.files import table

_SHOWN = ("facet", "value", "n", "selected")


@query("""SELECT 'l_returnflag' AS facet, l_returnflag AS value, count(*) AS n, false AS selected FROM lineitem GROUP BY l_returnflag
UNION ALL SELECT 'l_linestatus', l_linestatus, count(*), false FROM lineitem GROUP BY l_linestatus""")
def facet_values(spark, sf_dir):
    return count_facets(table(spark, sf_dir, "lineitem"), [Facet("l_returnflag"), Facet("l_linestatus")]).buckets.select(*_SHOWN)


@query("""SELECT 'p_brand' AS facet, p_brand AS value, count(*) FILTER (p_size <= 10) AS n, p_brand IN ('Brand#11', 'Brand#22') AS selected FROM part GROUP BY p_brand
HAVING n > 0 OR selected
UNION ALL SELECT 'p_type', p_type, count(*), false FROM part WHERE p_brand IN ('Brand#11', 'Brand#22') AND p_size <= 10 GROUP BY p_type
UNION ALL SELECT 'p_size', NULL, count(*), true FROM part WHERE p_brand IN ('Brand#11', 'Brand#22') AND p_size BETWEEN 1 AND 10
UNION ALL SELECT 'p_size', NULL, count(*), false FROM part WHERE p_brand IN ('Brand#11', 'Brand#22') AND p_size BETWEEN 11 AND 50""")
def facet_drill_sideways(spark, sf_dir):
    found = count_facets(table(spark, sf_dir, "part"), [
        Facet("p_brand", selected=["Brand#11", "Brand#22"]), Facet("p_type", kind="value"), Facet("p_size", ranges=[(1, 10), (11, 50)], selected_ranges=[(1, 10)]),
    ])
    return found.buckets.select(*_SHOWN)


@query("SELECT p_partkey FROM part WHERE p_brand IN ('Brand#11', 'Brand#22') AND p_size BETWEEN 1 AND 10 ORDER BY p_partkey LIMIT 25")
def facet_hits(spark, sf_dir):
    found = count_facets(table(spark, sf_dir, "part"), [Facet("p_brand", selected=["Brand#11", "Brand#22"]), Facet("p_size", ranges=[(1, 10), (11, 50)], selected_ranges=[(1, 10)])])
    return found.hits.orderBy("p_partkey").limit(25).select("p_partkey")


@query("""SELECT 'quality' AS facet, CAST(quality AS VARCHAR) AS value, count(*) AS n, quality IS NULL AS selected FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY quality
UNION ALL SELECT 'lang', lang, count(*), false FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE quality IS NULL GROUP BY lang""")
def facet_missing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return count_facets(docs, [Facet("quality", selected_missing=True), Facet("lang")]).buckets.select(*_SHOWN)


@query("""WITH c AS (SELECT p_type AS value, count(*) AS n FROM part GROUP BY p_type), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, value) AS k FROM c)
SELECT 'p_type' AS facet, value, n, false AS selected, CAST(row_number() OVER (ORDER BY n DESC, value) AS INTEGER) AS position FROM r WHERE k <= 5""")
def facet_options(spark, sf_dir):
    found = count_facets(table(spark, sf_dir, "part"), [Facet("p_type", kind="value", max_values=5, min_count=2, sort_by_count=True)])
    return found.buckets.select(*_SHOWN, "position")


@query("""WITH e AS (SELECT min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem), b AS (SELECT CAST(floor(low / 5) AS BIGINT) * 5 + 5 * i AS start, low, high FROM e, range(0, 10) t(i))
SELECT 'l_quantity' AS facet, CAST(greatest(start, low) AS DOUBLE) AS low, CAST(start + 5 AS DOUBLE) AS high, count(*) AS n, CAST(row_number() OVER (ORDER BY start) AS INTEGER) AS position
FROM b JOIN lineitem ON l_quantity >= greatest(start, low) AND (l_quantity < start + 5 OR start + 5 >= high AND l_quantity <= start + 5) GROUP BY start, b.low""")
def facet_auto_ranges(spark, sf_dir):
    found = count_facets(table(spark, sf_dir, "lineitem"), [Facet("l_quantity", power=1.0)]).buckets
    return found.select("facet", F.col("low").cast("double").alias("low"), F.col("high").cast("double").alias("high"), "n", "position")


@query("""WITH d AS (SELECT date_trunc('year', o_orderdate) AS y, count(*) AS n, min(min(o_orderdate)) OVER () AS first FROM orders GROUP BY 1)
SELECT strftime(greatest(y, first), '%Y-%m-%d %H:%M:%S') AS low, strftime(y + INTERVAL 1 YEAR, '%Y-%m-%d %H:%M:%S') AS high, n FROM d""")
def facet_date_ranges(spark, sf_dir):
    found = count_facets(table(spark, sf_dir, "orders"), [Facet("o_orderdate")]).buckets
    return found.select(F.substring("low", 1, 19).alias("low"), F.substring("high", 1, 19).alias("high"), "n")


@query("""WITH a AS (SELECT date_diff('day', TIMESTAMP '1990-01-01', o_orderdate) AS days FROM orders), k AS (SELECT days // 365 AS k, count(*) AS n FROM a GROUP BY 1)
SELECT greatest(k * 365, (SELECT min(days) FROM a)) AS low, k * 365 + 365 AS high, n FROM k""")
def facet_durations(spark, sf_dir):
    days = F.make_dt_interval(F.datediff("o_orderdate", F.lit("1990-01-01").cast("date")))
    found = count_facets(table(spark, sf_dir, "orders").select(days.alias("age")), [Facet("age", power=1.0)]).buckets
    number = lambda c: F.regexp_extract(c, "^(\\d+) day", 1).cast("long").alias(c)
    return found.select(number("low"), number("high"), "n")


@query("SELECT CAST(min(o_totalprice) AS VARCHAR) AS low, CAST(max(o_totalprice) AS VARCHAR) AS high, count(*) AS n FROM orders")
def facet_single_range(spark, sf_dir):
    return count_facets(table(spark, sf_dir, "orders"), [Facet("o_totalprice", kind="single_range")]).buckets.select("low", "high", "n")


@query("""WITH w AS (SELECT doc_id, unnest(list_distinct(string_split(text, ' '))) AS value FROM documents)
SELECT 'words' AS facet, value, count(*) AS n FROM w WHERE value IN ('the', 'and', 'de', 'und') GROUP BY value""")
def facet_arrays(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.split("text", " ").alias("words"))
    found = count_facets(docs, [Facet("words", values=["the", "and", "de", "und"])]).buckets
    return found.where("n > 0").select("facet", "value", "n")


@query("SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS label, count(*) AS n, n_nationkey = 3 AS selected FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal > 0 GROUP BY ALL")
def facet_relation(spark, sf_dir):
    catalog = graph_catalog(spark, sf_dir)
    rich = catalog.scan("customer").where("balance > 0")
    return relation_facet(rich, catalog.edges("customers", reverse=True), catalog.scan("nation"), "name", selected=(3,))


@query("""SELECT 'stage' AS facet, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE 'partly' END AS value, count(*) AS n, o_orderstatus = 'O' AS selected
FROM orders GROUP BY o_orderstatus""")
def facet_enum_names(spark, sf_dir):
    stage = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    orders = table(spark, sf_dir, "orders").select("o_orderkey", stage.alias("stage"))
    return count_facets(orders, [Facet("stage", names={0: "finished", 1: "open", 2: "partly"}, selected=["open"])]).buckets.select(*_SHOWN)


@query("""SELECT 'o_orderstatus' AS facet, o_orderstatus AS value, count(*) AS n, false AS selected FROM orders GROUP BY o_orderstatus
UNION ALL SELECT 'o_orderstatus', 'none', 0, true""")
def facet_unmatched_selection(spark, sf_dir):
    return count_facets(table(spark, sf_dir, "orders"), [Facet("o_orderstatus", selected=["none"])]).buckets.select(*_SHOWN)
