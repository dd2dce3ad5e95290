"""Resolution of WARC revisit records that were not modified.

A revisit has no body: it says that the server answered 304 to a request with validators. An as-of join by canonical
URL finds the latest full response before it; if the validators agree, the revisit gets that response's body and
headers, updated by those headers that a 304 may change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import materialise, release, table

#: Headers that a 304 response may carry for the stored response (RFC 9110, 15.4.5, and Last-Modified); fixed values.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: In how many ranges the records are dealt: as a tuple of one number, or, if it is empty, as many as shuffles have.
SLICES: tuple[int, ...] = ()
PATTERN = "^([A-Za-z][A-Za-z0-9+.-]*)://([^/?]*)([^?]*)[?]?(.*)$"


def canonical(url: Column) -> Column:
    """The URL without scheme, fragment, leading www., default port, tracking parameters and trailing slash; the host
    in lower case and the parameters in order. What is no URL stays as it is, and null stays null."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, PATTERN, 2)), "^www[0-9]*[.]", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, PATTERN, 3), "/+$", "")
    query = F.array_join(F.array_sort(F.filter(F.split(F.regexp_extract(bare, PATTERN, 4), "&"), lambda p: (p != "") & ~p.startswith("utm_"))), "&")
    whole = F.concat(host, F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(bare.rlike(PATTERN), whole).otherwise(bare)


def _latest_before(slim: DataFrame) -> DataFrame:
    """Each revisit's latest earlier response as `found`, null where there is none: slim has canonical, at, record_id, kind, seen.

    Records are dealt by ranges of (canonical, at, record_id), so a URL of many records is cut by rank wherever its times
    are, and a cut falls between two records of one time too. The ranges are written with the records: they come from a
    sample and would not be the same twice."""
    cut = slim.distinct().repartitionByRange(*(SLICES or ()), "canonical", "at", "record_id").withColumn("slice", F.spark_partition_id())
    cut = materialise(cut)
    full = F.when(F.col("kind") == "response", F.col("seen"))
    earlier = Window.partitionBy("canonical", "slice").orderBy("at", "record_id", "kind", "seen").rowsBetween(Window.unboundedPreceding, -1)
    inside = cut.withColumn("found", F.last(full, ignorenulls=True).over(earlier)).where("kind = 'revisit'")
    # What the slices before leave behind: a row for each slice.
    ends = cut.groupBy("canonical", "slice").agg(F.max(F.when(F.col("kind") == "response", F.struct("at", "record_id", "seen"))).alias("end"))
    before = Window.partitionBy("canonical").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("carried", F.last("end", ignorenulls=True).over(before)["seen"]).where(F.col("carried").isNotNull()).select("canonical", "slice", "carried")
    return inside.join(carried, ["canonical", "slice"], "left").withColumn("found", F.coalesce("found", "carried")).drop("carried", "slice")


def resolve(records: DataFrame) -> DataFrame:
    """Resolve the revisits of `records` and keep its responses.

    Columns read: record_id long, url, captured_at (a number or timestamp), kind ('response' or 'revisit'), etag,
    last_modified, digest, headers map<string, string> with names in lower case, body. Returned: record_id, canonical,
    captured_at, outcome, source_id, headers, body. The outcome is

    - response: a full response, as it came;
    - resolved: at least one validator is in both records and none differs; the source's body and merged headers;
    - mismatch: the latest earlier response has other validators, or none in common; source_id says which, no body;
    - orphan: no earlier response, or no url.

    Of equal times the smaller record_id is the earlier. Records of another kind and repeated rows are kept as they
    are: each revisit is resolved by itself. A record is known by its id, URL, time and validators; of responses that
    share all of these the one whose body's MD5, then the JSON of whose headers, comes first is the source. Null headers
    count as empty. Other columns are not returned.
    """
    keyed = records.select(
        F.col("record_id").cast("long").alias("record_id"), canonical(F.col("url")).alias("canonical"), "captured_at",
        F.col("captured_at").cast("double").alias("at"), "kind", "etag", "last_modified", "digest",
        F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers"), "body",
    )
    validators = ("etag", "last_modified", "digest")
    # Null-safe as one text: every part of it is there, nulls with a mark of their own.
    seen = F.struct("record_id", "at", *validators).alias("seen")
    name = F.xxhash64(F.to_json(F.struct("record_id", "at", "canonical", *validators), {"ignoreNullFields": "false"}))
    slim = keyed.where(F.col("canonical").isNotNull()).select("canonical", "at", "record_id", "kind", seen, name.alias("name"))
    slim = slim.withColumn("seen", F.col("seen").withField("name", F.col("name")))
    latest = _latest_before(slim)
    found = materialise(latest.select("name", F.col("found.record_id").alias("source_id"), F.col("found.name").alias("source"), "seen", "found").dropDuplicates(["name"]))
    release(records.sparkSession, latest)
    agree = lambda v: F.col(f"seen.{v}") == F.col(f"found.{v}")
    none_differs = ~F.greatest(*(F.coalesce(~agree(v), F.lit(False)) for v in validators))
    one_agrees = F.greatest(*(F.coalesce(agree(v), F.lit(False)) for v in validators))
    found = found.select(
        "name", "source", "source_id",
        F.when(F.col("found").isNull(), "orphan").when(one_agrees & none_differs, "resolved").otherwise("mismatch").alias("outcome"),
    )
    revisits = keyed.where("kind = 'revisit'").withColumn("name", name).drop("body").join(found, "name", "left")
    revisits = revisits.select("record_id", "canonical", "captured_at", F.coalesce("outcome", F.lit("orphan")).alias("outcome"), "source", "source_id", "headers")
    one = F.row_number().over(Window.partitionBy("source").orderBy(F.md5("body"), F.to_json("stored")))
    stored = keyed.where("kind = 'response'").select(name.alias("source"), F.col("headers").alias("stored"), "body").withColumn("nth", one).where("nth = 1").drop("nth")
    fresh = F.map_filter("headers", lambda k, v: k.isin(*PERMITTED))
    old = F.map_filter("stored", lambda k, v: ~F.array_contains(F.map_keys(fresh), k))
    resolved = revisits.where("outcome = 'resolved'").join(stored, "source").withColumn("headers", F.map_concat(old, fresh))
    columns = ["record_id", "canonical", "captured_at", "outcome", "source_id", "headers", "body"]
    others = revisits.where("outcome <> 'resolved'").withColumn("body", F.lit(None).cast("string"))
    kept = keyed.where(~F.col("kind").eqNullSafe("revisit")).withColumn("outcome", F.coalesce("kind", F.lit("unknown"))).withColumn("source_id", F.lit(None).cast("long"))
    return kept.select(*columns).unionByName(resolved.select(*columns)).unionByName(others.select(*columns))


def crawl(pages: DataFrame) -> DataFrame:
    """WARC records of a crawl of `pages`: each page's response at second 10 page_id, and a revisit of it 5,000,000,000
    seconds later; every tenth page also has a revisit 1 second before its response. Entity tags are MD5 of the HTML."""
    html, k = F.coalesce("html", F.lit("")), F.col("page_id").cast("long")
    base = pages.select(k.alias("page"), "url", html.alias("html"), F.md5(html).alias("etag"))
    nothing = F.lit(None).cast("string")

    def made(offset: int, at: Column, kind: str, headers: dict[str, Column], body: Column) -> tuple[Column, ...]:
        pairs = [x for name, value in headers.items() for x in (F.lit(name), value)]
        return ((F.col("page") * 4 + offset).alias("record_id"), F.col("url"), at.alias("captured_at"), F.lit(kind).alias("kind"), F.col("etag"),
                nothing.alias("last_modified"), nothing.alias("digest"), F.create_map(*pairs).alias("headers"), body.alias("body"))

    at = F.col("page") * 10
    full = {"date": at.cast("string"), "etag": F.col("etag"), "content-type": F.lit("text/html"), "content-length": F.length("html").cast("string")}
    short = lambda t: {"date": t.cast("string"), "cache-control": F.lit("max-age=60"), "content-length": F.lit("0")}
    late, early = at + 5_000_000_000, at - 1
    return (
        base.select(*made(0, at, "response", full, F.col("html")))
        .unionByName(base.select(*made(1, late, "revisit", short(late), nothing)))
        .unionByName(base.where(F.col("page") % 10 == 0).select(*made(2, early, "revisit", short(early), nothing)))
    )


def op7_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    header = lambda name: F.col("headers")[name].alias(name.replace("-", "_"))
    return resolve(crawl(table(spark, sf_dir, "pages"))).select(
        "record_id", "canonical", "captured_at", "outcome", "source_id", header("date"), header("cache-control"), header("content-type"), header("content-length"),
        F.md5("body").alias("body_md5"),
    )


ORACLE_SQL = f"""
WITH p AS (
  SELECT CAST(page_id AS BIGINT) AS page, regexp_replace(trim(url), '#.*$', '') AS u, coalesce(html, '') AS html FROM pages
), q AS (
  SELECT page, u, html, md5(html) AS etag,
         regexp_replace(regexp_replace(lower(regexp_extract(u, '{PATTERN}', 2)), '^www[0-9]*[.]', ''), ':(80|443)$', '') AS host,
         regexp_replace(regexp_extract(u, '{PATTERN}', 3), '/+$', '') AS path,
         array_to_string(list_sort(list_filter(string_split(regexp_extract(u, '{PATTERN}', 4), '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_'))), '&') AS query
  FROM p
), c AS (
  SELECT page, html, etag,
         CASE WHEN regexp_matches(u, '{PATTERN}') THEN host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN query = '' THEN '' ELSE '?' || query END ELSE u END AS canonical
  FROM q
), r AS (
  SELECT page * 4 AS record_id, canonical, page * 10 AS captured_at, 'response' AS kind, etag, html FROM c
  UNION ALL SELECT page * 4 + 1, canonical, page * 10 + 5000000000, 'revisit', etag, NULL FROM c
  UNION ALL SELECT page * 4 + 2, canonical, page * 10 - 1, 'revisit', etag, NULL FROM c WHERE page % 10 = 0
), j AS (
  SELECT v.record_id, v.canonical, v.captured_at, v.etag, s.record_id AS source_id, s.etag AS s_etag, s.html AS s_html,
         row_number() OVER (PARTITION BY v.record_id ORDER BY s.captured_at DESC NULLS LAST, s.record_id DESC) AS n
  FROM r AS v LEFT JOIN r AS s ON s.kind = 'response' AND s.canonical = v.canonical
       AND (s.captured_at < v.captured_at OR s.captured_at = v.captured_at AND s.record_id < v.record_id)
  WHERE v.kind = 'revisit'
)
SELECT record_id, canonical, captured_at, 'response' AS outcome, CAST(NULL AS BIGINT) AS source_id, CAST(captured_at AS VARCHAR) AS date,
       CAST(NULL AS VARCHAR) AS cache_control, 'text/html' AS content_type, CAST(length(html) AS VARCHAR) AS content_length, md5(html) AS body_md5
FROM r WHERE kind = 'response'
UNION ALL
SELECT record_id, canonical, captured_at,
       CASE WHEN source_id IS NULL THEN 'orphan' WHEN etag = s_etag THEN 'resolved' ELSE 'mismatch' END, source_id,
       CAST(captured_at AS VARCHAR), 'max-age=60',
       CASE WHEN etag = s_etag THEN 'text/html' END,
       CASE WHEN etag = s_etag THEN CAST(length(s_html) AS VARCHAR) ELSE '0' END,
       CASE WHEN etag = s_etag THEN md5(s_html) END
FROM j WHERE n = 1
"""
