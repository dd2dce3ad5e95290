"""Goldens and brute-force checks of the operators."""

import math
import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions import filters, geo, logic, ranges, text
from quern.operators import graph, intervals, mutations, search
from quern.operators.facets import Facet, count_facets
from quern.operators.query import NodeQuery
from quern.operators.relations import Include, include, include_references
from quern.plans import logs
from quern.sources.catalog import Catalog, NodeType, Property, Relation
from quern.sources.shared import written


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_null_comparisons_are_true_or_false(spark):
    null = F.lit(None).cast("int")
    assert one(spark, logic.eq(null, None)) and not one(spark, logic.eq(null, 1)) and one(spark, logic.ne(null, 1))
    assert one(spark, logic.lt(null, 1)) is False and one(spark, logic.negate(logic.lt(null, 1))) is True
    assert one(spark, logic.all_of()) and not one(spark, logic.any_of())


def test_division_truncates(spark):
    assert [one(spark, logic.divide(F.lit(a), F.lit(b), True)) for a, b in ((7, 2), (-7, 2))] == [3, -3]
    assert one(spark, logic.divide(F.lit(7), F.lit(2), False)) == 3.5


@pytest.mark.parametrize(("kind", "value", "found"), [(T.IntegerType(), "2", True), (T.IntegerType(), 2.5, False), (T.IntegerType(), "x", False), (T.DoubleType(), 2, True), (T.StringType(), 2, False)])
def test_array_elements_without_loss(spark, kind, value, found):
    array = F.array(F.lit(1), F.lit(2)).cast(T.ArrayType(kind))
    assert one(spark, logic.has_element(array, T.ArrayType(kind), value)) is found


def test_string_comparison_must_be_ordinal():
    with pytest.raises(ValueError):
        logic.contains(F.lit("a"), "a", comparison="ignore case")


def test_filter_dictionary(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "id int, name string")
    ids = lambda spec: [r["id"] for r in df.where(filters.predicate(spec)).orderBy("id").collect()]
    assert ids({"name": {"ne": "a"}}) == [2, 3]
    assert ids({"name": {"in": []}}) == [] and ids({"name": {"nin": []}}) == [1, 2, 3] and ids({"or": []}) == [1, 2, 3]
    assert ids({"or": [{"id": {"eq": 1}}, {"name": {"eq": None}}]}) == [1, 2]
    assert filters.page_bounds(-3, 10**6) == (0, 1000)


def test_listing_counts_what_all_pages_have(spark):
    df = spark.createDataFrame([(i, i % 3, "mine") for i in range(30)], "id int, part int, score string")
    found = filters.listing(df, {"part": {"eq": 1}}, order_by="id", descending=True, page=1, page_size=4)
    assert [r["id"] for r in found.rows.collect()] == [16, 13, 10, 7] and found.total() == 10
    hits = spark.createDataFrame([(4, 1.0), (7, 2.0), (10, 2.0), (99, 9.0)], "id int, score double")
    found = filters.listing(df, ids=[4, 7, 10, 11], page_size=2, hits=hits)
    assert [tuple(r) for r in found.rows.collect()] == [(7, 1, "mine"), (10, 1, "mine")] and found.total() == 3
    none = filters.listing(df, {"part": {"eq": 9}})
    assert none.rows.count() == 0 and none.total() == 0


def test_number_ranges():
    assert ranges.number_ranges(50, 60, 10, power=1, whole=True) == [(i, i + 1) for i in range(50, 60)]
    assert ranges.number_ranges(3, 3) == [(3, 3)]
    for low, high, n, power in ((0.3, 977.0, 10, 1.0), (-5.5, 7.2, 7, 1.8), (1, 10_000, 10, 1.8), (0, 1e-6, 5, 1.0)):
        found = ranges.number_ranges(low, high, n, power)
        assert found[0][0] <= low and found[-1][1] >= high and len(found) <= ranges.allowed(n)
        assert all(a[1] == b[0] and a[0] < a[1] for a, b in zip(found, found[1:], strict=False))


def test_time_ranges():
    found = ranges.date_ranges(datetime(2020, 2, 3), datetime(2023, 11, 5), 4)
    assert [a.year for a, _ in found] == [2020, 2021, 2022, 2023] and all((a.month, a.day) == (1, 1) for a, _ in found[1:])
    assert len(ranges.date_ranges(datetime(2024, 1, 1, tzinfo=UTC), datetime(2024, 1, 31, tzinfo=UTC), 5)) <= 6
    assert ranges.duration_ranges(timedelta(0), timedelta(hours=1), 6, power=1) == [(timedelta(minutes=10 * i), timedelta(minutes=10 * i + 10)) for i in range(6)]


def test_ranges_hold_what_they_must():
    rng = random.Random(7)
    for _ in range(300):
        low, n = rng.choice([0, rng.uniform(0, 1e6), rng.uniform(-50, 50)]), rng.randint(1, 14)
        high = low + 10 ** rng.uniform(-6, 6)
        for power in (1.0, 1.8, 0.5):
            found = ranges.number_ranges(low, high, n, power)
            assert found[0][0] <= low and found[-1][1] >= high and all(a[1] == b[0] and a[0] < a[1] for a, b in zip(found, found[1:], strict=False))
            assert len(found) <= (ranges.allowed(n) if power == 1 or low < 0 else n)
    assert ranges.number_ranges(1, 10_000, 5, whole=True) == [(0, 500), (500, 2000), (2000, 4000), (4000, 7000), (7000, 10_000)]


def test_years_and_durations_along_a_curve():
    assert [a.year for a, _ in ranges.date_ranges(datetime(1963, 5, 1), datetime(2024, 1, 1), 6)] == [1960, 1970, 1980, 1990, 2000, 2010, 2020]
    hours = timedelta(hours=1)
    assert ranges.duration_ranges(0 * hours, 100 * hours, 4) == [(0 * hours, 9 * hours), (9 * hours, 30 * hours), (30 * hours, 60 * hours), (60 * hours, 108 * hours)]
    bent = ranges.date_ranges(datetime(2000, 1, 1), datetime(2020, 1, 1), 4, 2.0)
    widths = [b - a for a, b in bent]
    assert bent[0][0] == datetime(2000, 1, 1) and bent[-1][1] >= datetime(2020, 1, 1) and widths == sorted(widths)


def products(spark):
    data = [(1, "book", 10.0, ["a", "b"], None), (2, "book", 20.0, ["a", "a"], True), (3, "toy", 30.0, [], True), (4, None, 40.0, None, False)]
    return spark.createDataFrame(data, "id int, category string, price double, tags array<string>, active boolean")


def buckets(found, name):
    return [(r["value"], r["n"], r["selected"]) for r in found.buckets.where(F.col("facet") == name).orderBy("position").collect()]


def test_facets_drill_sideways(spark):
    found = count_facets(products(spark), [Facet("category", selected=["book"]), Facet("tags"), Facet("active", selected=[True])])
    assert buckets(found, "category") == [("book", 1, True), ("toy", 1, False)]
    assert buckets(found, "tags") == [("a", 1, False)]
    assert buckets(found, "active") == [("true", 1, True), (None, 1, False)]
    assert [r["id"] for r in found.hits.collect()] == [2]


def test_facet_options_and_missing(spark):
    found = count_facets(products(spark), [Facet("category", max_values=1, sort_by_count=True, selected=["none"]), Facet("tags", selected_missing=True)])
    assert ("none", 0, True) in buckets(found, "category")
    assert (None, 0, True) in buckets(found, "tags")
    assert (None, 2, True) in buckets(count_facets(products(spark), [Facet("tags", selected_missing=True)]), "tags")
    assert found.hits.count() == 0


def test_facet_ranges_cover_all(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(1, 101)], "id int, price double")
    found = count_facets(df, [Facet("price")]).buckets.collect()
    assert sum(r["n"] for r in found) == 100 and len(found) > 5


def test_no_facets_and_distinct_values_at_the_bound(spark):
    assert count_facets(products(spark), []).buckets.count() == 0
    df = spark.range(1000).select((F.col("id") % 25).alias("few"), (F.col("id") % 26).alias("many"))
    found = count_facets(df, [Facet("few"), Facet("many")]).buckets
    assert found.where("facet = 'few' and value is not null").count() == 25 and found.where("facet = 'many' and low is not null").count() > 3
    assert found.where("facet = 'many' and value is not null").count() == 0


TREE = [("c1", "root"), ("c2", "root"), ("gc1", "c1"), ("gc2", "c1"), ("ggc1", "gc1")]


def test_traverse_tree(spark):
    edges = spark.createDataFrame([(p, c) for c, p in TREE], "src string, dst string")
    nodes = spark.createDataFrame([(n,) for n in ("root", "c1", "c2", "gc1", "gc2", "ggc1", "unrelated")], "id string")
    seeds = nodes.where("id = 'root'")
    levels = lambda *a, **k: {r["id"]: r["level"] for r in graph.traverse(nodes, seeds, edges, *a, **k).collect()}
    assert levels(1, 3) == {"c1": 1, "c2": 1, "gc1": 2, "gc2": 2, "ggc1": 3}
    assert levels(2, 2) == {"gc1": 2, "gc2": 2} and levels(0, 1) == {"root": 0, "c1": 1, "c2": 1}
    cycle = edges.union(spark.createDataFrame([("ggc1", "root")], "src string, dst string"))
    assert {r["id"] for r in graph.traverse(nodes, seeds, cycle, 1, 10).collect()} == {"c1", "c2", "gc1", "gc2", "ggc1"}
    assert graph.shortest_path(edges, "root", "ggc1") == ["root", "c1", "gc1", "ggc1"]
    assert graph.shortest_path(edges, "ggc1", "c2", direction="both") == ["ggc1", "gc1", "c1", "root", "c2"]
    assert graph.shortest_path(edges, "ggc1", "c2") is None and graph.shortest_path(edges, "root", "nowhere") is None
    with pytest.raises(graph.BudgetError):
        graph.levels(seeds, edges, 3, budget=2)
    assert {r["id"] for r in graph.circular(cycle).collect()} == {"root", "c1", "gc1", "ggc1"} and graph.circular(edges).count() == 0


def test_circles_against_brute_force(spark):
    rng = random.Random(3)
    for size, count in ((12, 14), (25, 30)):
        pairs = {(rng.randrange(size), rng.randrange(size)) for _ in range(count)}
        reach = {a: {b for x, b in pairs if x == a} for a in range(size)}
        for _ in range(size):
            reach = {a: bs | {c for b in bs for c in reach[b]} for a, bs in reach.items()}
        got = {r["id"] for r in graph.circular(spark.createDataFrame(sorted(pairs), "src int, dst int")).collect()}
        assert got == {a for a in range(size) if a in reach[a]}


def catalog(spark):
    c = Catalog(spark, [NodeType("thing", (Property("name", "string", unique=True),)), NodeType("brand", parents=("thing",)), NodeType("product", (Property("price", "integer", default=0, low=0),), ("thing",))], [Relation("makes", "brand", "product", "one_to_many"), Relation("friends", "brand", "brand", "many_many")])
    c.add_nodes("brand", spark.createDataFrame([(1, "Acme"), (2, "Other")], "id long, name string"))
    c.add_nodes("product", spark.createDataFrame([(10, "P100", 100), (11, "P200", 200), (12, "P300", 300), (13, "P50", None)], "id long, name string, price int"))
    c.add_edges("makes", spark.createDataFrame([(1, 10, 2), (1, 11, 1), (1, 12, 3), (2, 13, 1)], "src long, dst long, ord int"))
    return c.add_edges("friends", spark.createDataFrame([(1, 2)], "src long, dst long"))


def test_catalog_and_query(spark):
    c = catalog(spark)
    ids = lambda q: [r["id"] for r in q.order_by("id").select_id().collect()]
    assert ids(NodeQuery.of(c, "thing")) == [1, 2, 10, 11, 12, 13] and ids(NodeQuery.of(c, "thing", descendants=True).where_types(["brand"])) == [1, 2]
    q = NodeQuery.of(c, "product").where(logic.ge(F.col("price"), 100))
    assert ids(q) == [10, 11, 12] and ids(q.where(logic.lt(F.col("price"), 250))) == [10, 11] and q.count() == 3
    assert ids(q.relates("makes", 1, reverse=True)) == [10, 11, 12] and ids(q.relates_not("makes", 1, reverse=True)) == []
    assert ids(NodeQuery.of(c, "brand").relates("makes", 13)) == [2] and ids(NodeQuery.of(c, "brand").relates("friends", 1)) == [2]
    assert ids(NodeQuery.related(c, "makes", 1)) == [10, 11, 12] and c.contains_relation("makes", 2, 13) and not c.exists(99)
    page = NodeQuery.of(c, "product").order_by("price", descending=True).page(1, 3).result()
    assert (page.count, page.total_count, page.page_count, page.is_last_page) == (1, 4, 2, True)
    assert NodeQuery.of(c, "product").sum("price").first()["sum"] == 600 and NodeQuery.of(c, "product").where_id(11).single()["name"] == "P200"
    with pytest.raises(LookupError):
        q.single()
    with pytest.raises(ValueError):
        q.take(1).where(F.lit(True))
    assert c.get("product", 13).first()["price"] == 0
    assert c.check("product").count() == 0 and c.check_relation("makes").count() == 0


def test_last_order_by_decides(spark):
    df = spark.createDataFrame([(1, "b", 1), (2, "a", 2), (3, "a", 1)], "id int, x string, y int")
    assert [r["id"] for r in NodeQuery(df).order_by("y").order_by("x").rows().collect()] == [3, 2, 1]
    place = df.withColumn("at", F.struct(F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon")))
    with pytest.raises(ValueError):
        NodeQuery(place).order_by("at")


def test_includes(spark):
    c = catalog(spark)
    top = Include("products", c.edges("makes"), c.scan("product").select("id", "name", "price"), where=(F.col("price") != 200,), top=1)
    rows = {r["name"]: [p["name"] for p in r["products"]] for r in include(c.scan("brand"), [top]).collect()}
    assert rows == {"Acme": ["P100"], "Other": ["P50"]}
    merged = include(c.scan("brand"), [top, Include("products", c.edges("makes"), c.scan("product"), top=2)]).collect()
    assert {r["name"]: len(r["products"]) for r in merged} == {"Acme": 2, "Other": 1}
    refs = spark.createDataFrame([(1, [2, 1, 99, 2]), (2, None)], "id int, brands array<long>")
    found = {r["id"]: [b["name"] for b in r["made"]] for r in include_references(refs, "brands", c.scan("brand"), "made").collect()}
    assert found == {1: ["Other", "Acme", "Other"], 2: []}


def test_geo_against_brute_force(spark):
    rng = random.Random(1234)
    points = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(2000)] + [(2000, None, None)]
    df = spark.createDataFrame(points, "id int, lat double, lon double")
    with_code = lambda rows: written(rows.withColumn("code", geo.zcode(F.col("lat"), F.col("lon"))))
    coded = with_code(df)

    def metres(a, b, c, d):
        a, b, c, d = map(math.radians, (a, b, c, d))
        h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
        return 2 * 6_371_000 * math.asin(min(1, math.sqrt(h)))

    for lat, lon, far in ((59.9, 10.7, 2e6), (-10, 179.5, 3e6), (89, 0, 2e6), (0, -179, 1.2e7), (5, 5, -1)):
        got = {r["id"] for r in df.where(geo.is_within(F.col("lat"), F.col("lon"), lat, lon, far)).collect()}
        assert got == {i for i, a, b in points if a is not None and metres(a, b, lat, lon) <= far}
        ranges = geo.cover(lat, lon, far)
        assert len(ranges) <= 64 and all(a <= b for a, b in ranges) and all(x[1] < y[0] - 1 for x, y in zip(ranges, ranges[1:], strict=False))
        code = F.col("code")
        assert {r["id"] for r in coded.where(geo.is_within(F.col("lat"), F.col("lon"), lat, lon, far, code)).collect()} == got
        if far == 2e6 and lat == 59.9:
            assert coded.where(geo.is_covered(code, lat, lon, far)).count() < 300
    edge = with_code(spark.createDataFrame([(1, 0.0, 180.0), (2, 0.0, -180.0), (3, 90.0, 12.0), (4, 0.0, 1e-9)], "id int, lat double, lon double"))
    near = lambda lat, lon, m: [r["id"] for r in edge.where(geo.is_within(F.col("lat"), F.col("lon"), lat, lon, m, F.col("code"))).orderBy("id").collect()]
    assert near(0, 179.999, 500) == [1, 2] and near(90, 0, 1) == [3] and near(0, 0, 1) == [4]
    assert df.where("id = 2000").select(geo.distance(F.col("lat"), F.col("lon"), 0, 0).alias("d")).first()["d"] == math.inf
    assert df.where("id < 2000").select(F.max(geo.zcode(F.col("lat"), F.col("lon"))).alias("z")).first()["z"] < 2**62


T0 = datetime(2026, 6, 1, 10)
LOG = [(0, 1, 0.5, "a", "u1"), (10, 2, 1.5, "a", "u2"), (20, 3, 2.5, "b", "u1"), (30, 4, 3.5, "c", "u3"), (60, 10, 1.0, "a", "u1"), (70, 20, 2.0, "d", "u1")]


def log(spark):
    return spark.createDataFrame([(T0 + timedelta(minutes=m), *rest) for m, *rest in LOG], "ts timestamp, i int, d double, g string, u string")


def test_interval_goldens(spark):
    hours = intervals.statistics(log(spark), "hour", "i").orderBy("start").collect()
    assert [(r["rows"], r["total"], r["low"], r["high"], r["mean"]) for r in hours] == [(4, 10, 1, 4, 2.5), (2, 30, 10, 20, 15.0)]
    assert [r["total"] for r in intervals.statistics(log(spark), "hour", "d").orderBy("start").collect()] == [8.0, 3.0]
    assert [r["groups"] for r in intervals.group_map(intervals.group_counts(log(spark), "hour", "g")).orderBy("start").collect()] == [{"a": 2, "b": 1, "c": 1}, {"a": 1, "d": 1}]
    assert [r["n"] for r in intervals.unique_counts(log(spark), "hour", "u").orderBy("start").collect()] == [3, 1]
    day = intervals.combine(intervals.statistics(log(spark), "hour", "i"), "day").first()
    assert (day["rows"], day["total"], day["mean"]) == (6, 40, 40 / 6)
    blanks = intervals.fill_blanks(intervals.statistics(log(spark), "hour", "i"), "hour", T0 - timedelta(hours=1), T0 + timedelta(hours=3)).orderBy("start").collect()
    assert [r["has_value"] for r in blanks] == [False, True, True, False]
    assert intervals.statistics(log(spark).limit(0), "hour", "i").count() == 0
    with pytest.raises(ValueError):
        intervals.floor(F.col("ts"), "decade")


def test_stream_equals_batch(spark, tmp_path):
    from quern.streaming import intervals as streams

    log(spark).write.parquet(str(tmp_path / "in"))
    stream = streams.read(spark, str(tmp_path / "in"), log(spark))
    found = streams.tumbling(stream, "hour", "i")
    found.writeStream.outputMode("complete").format("memory").queryName("golden").trigger(availableNow=True).start().awaitTermination()
    assert [(r["rows"], r["total"]) for r in spark.table("golden").orderBy("start").collect()] == [(4, 10), (2, 30)]
    streams.write(streams.tumbling(streams.read(spark, str(tmp_path / "in"), log(spark)), "hour", "i", late="10 minutes"), str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


@pytest.mark.parametrize("name", ["stream_sessions", "stream_tumbling", "stream_sliding", "stream_groups"])
def test_stream_results_are_written_tables(spark, name):
    found = logs.__dict__[name](spark, "/root/testdata/sf0.001")
    assert found.inputFiles() and all("/quern/" in f for f in found.inputFiles())


def test_streams_read_a_folder_of_files(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    for name in ("stream_tumbling", "stream_sessions"):
        one_file, folder = (sorted(map(tuple, logs.__dict__[name](spark, d).collect())) for d in ("/root/testdata/sf0.001", str(tmp_path)))
        assert folder == one_file and folder


def test_unique_estimates_are_near(spark):
    for r in logs.i_unique(spark, "/root/testdata/sf0.01").join(logs.i_unique_estimate(spark, "/root/testdata/sf0.01").withColumnRenamed("n", "about"), "start").collect():
        assert abs(r["about"] - r["n"]) <= max(2, 0.03 * r["n"])


def test_tokens_and_terms(spark):
    words = lambda t, **k: one(spark, text.tokens(F.lit(t), **k))
    assert words("Foo;bar it's a B-C near, NEAR", stop_words=["near"]) == ["foobar", "it's"]
    assert words("x" * 40) == ["x" * 30] and words("") == []
    assert [(t.word, t.prefix, t.infix, t.fuzzy) for t in text.terms("Foo* *bar ab baz~")] == [("foo", True, False, False), ("bar", False, True, False), ("baz", False, False, True)]


def test_search_terms(spark):
    df = spark.createDataFrame([(1, "red fox jumps"), (2, "red dog"), (3, "foxes and dogs"), (4, None)], "id int, body string")
    index = search.TextIndex.of(df, F.col("body"))
    ids = lambda *a, **k: sorted(r["id"] for r in index.hits(*a, **k).collect())
    assert ids("red fox") == [1] and ids("red fox", any_term=True) == [1, 2] and ids("fox*") == [1, 3] and ids("*oxe") == [3]
    assert ids("foxs~") == [1, 3] and ids("re red") == [1, 2] and ids("zzz") == [] and ids("") == []
    assert one(spark, text.snippet(F.lit("aaa Fox bbb"), ["fox"])) == "aaa [Fox] bbb"
    near = lambda t, words, **k: one(spark, text.snippet(F.lit(t), words, **k))
    assert near("foxes, a Fax (bbb)", ["fox"], edits=1) == "[fox]es, a Fax (bbb)" and near("prefax, Fax!", ["fox"], edits=1) == "prefax, [Fax]!"
    assert near("a cat", ["fox", "bat"], edits=1) == "a [cat]" and near("a cat", ["fox"], edits=1) == "a cat" and near("", ["fox"], edits=1) == ""


def test_stored_index_and_words_without_a_cap(spark, tmp_path):
    df = spark.createDataFrame([(i, f"word{i} and other{i % 7}") for i in range(400)], "id int, body string")
    index = search.TextIndex.of(df, F.col("body"))
    stored = index.write(str(tmp_path / "index"))
    for query, any_term in (("word*", False), ("*ord1", False), ("word12~", False), ("*ord1*", False), ("other3 word3", False), ("word5 other5", True), ("wor12~*", False)):
        a, b = (sorted((r["id"], round(r["score"], 9)) for r in x.hits(query, any_term).collect()) for x in (index, stored))
        assert a == b, query
    assert index.hits("word*").count() == 400 and index.hits("*ther").count() == 400 and index.hits("and", top=3).count() == 3
    assert sorted(map(tuple, stored.suggest("other9").collect())) == sorted(map(tuple, index.suggest("other9").collect()))
    found = search.ranked(df, index.hits("other3"), 5, "body", ["other3"])
    rows = found.rows.collect()
    assert found.capped and len(rows) == 5 and all("[other3]" in r["sample"] for r in rows) and not search.ranked(df, index.hits("word7")).capped


def test_clusters_find_most_and_all(spark):
    v = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    held = search.ClusteredVectors.of(v, "embedding", clusters=8)
    part, whole = 0, 0
    for q in v.orderBy("vec_id").limit(8).collect():
        query = list(q["embedding"])
        ids = lambda df: [r["id"] for r in df.collect()]
        exact = ids(search.similar_vectors(v, "embedding", query, top=10, key="vec_id"))
        assert ids(held.search(query, accuracy=1.0, top=10, key="vec_id")) == exact
        part, whole = part + len(set(exact) & set(ids(held.search(query, accuracy=0.75, top=10, key="vec_id")))), whole + len(exact)
    assert part / whole >= 0.9


def test_repeated_ids_in_changes(spark):
    nodes = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    rows = spark.createDataFrame([(2, "x"), (2, "y"), (3, "c"), (3, None), (3, "c")], "id int, name string")
    assert sorted(map(tuple, mutations.upsert(nodes, rows).collect())) == [(1, "a"), (2, "y"), (3, "c")]
    assert sorted(map(tuple, mutations.update_if_different(nodes, rows)[1].collect())) == [(2,)]
    with pytest.raises(mutations.Conflict):
        mutations.insert(nodes.limit(0), rows, or_fail=True)


def test_mutations(spark):
    nodes = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    rows = spark.createDataFrame([(2, "B"), (3, "c")], "id int, name string")
    got = lambda df: sorted(map(tuple, df.collect()))
    assert got(mutations.insert(nodes, rows)) == [(1, "a"), (2, "b"), (3, "c")]
    assert got(mutations.update(nodes, rows)) == [(1, "a"), (2, "B")] and got(mutations.upsert(nodes, rows)) == [(1, "a"), (2, "B"), (3, "c")]
    assert got(mutations.delete(nodes, rows)) == [(1, "a")]
    after, changed = mutations.update_if_different(nodes, rows)
    assert got(changed) == [(2,)] and got(after) == [(1, "a"), (2, "B")]
    for f in (mutations.insert, mutations.delete, mutations.update):
        with pytest.raises(mutations.Conflict):
            f(nodes, rows, or_fail=True)
    with pytest.raises(mutations.Conflict):
        mutations.require(nodes, F.col("id") > 1)


def test_fusion(spark):
    words = spark.createDataFrame([(1, 9.0), (2, 5.0)], "id int, score double")
    vectors = spark.createDataFrame([(2, 0.9), (3, 0.8)], "id int, score double")
    got = {r["id"]: r["score"] for r in search.fuse(words, vectors, 0.5).collect()}
    assert got == pytest.approx({1: 0.5 / 61, 2: 0.5 / 62 + 0.5 / 61, 3: 0.5 / 62})
