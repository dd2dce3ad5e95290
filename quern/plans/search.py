"""Text, vector and hybrid search, spelling, snippets and HTML."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import filters, text
from quern.operators import search
from quern.operators.search import TextIndex
from quern.plans.base import query
from quern.sources.files import table

#: Stop words of these queries; the library takes any list.
STOP = ("the", "and", "for", "with")
_STOP_SQL = ", ".join(f"'{w}'" for w in STOP)
_POSTINGS = rf"""w AS (SELECT doc_id, unnest(list_transform(list_filter(string_split_regex(
  regexp_replace(lower(text), '[^\p{{L}}\p{{Nd}}'' \t\n\r,.=/\\?&|+\-*()\[\]{{}}:]', '', 'g'), '[ \t\n\r,.=/\\?&|+\-*()\[\]{{}}:]+'),
  lambda x: length(x) >= 3), lambda x: substr(x, 1, 30))) AS term FROM documents),
k AS (SELECT doc_id, term FROM w WHERE term NOT IN ({_STOP_SQL})),
l AS (SELECT d.doc_id, count(term) AS words FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id GROUP BY d.doc_id),
p AS (SELECT doc_id, term, least(count(*), 255) AS tf FROM k GROUP BY doc_id, term),
v AS (SELECT term, count(*) AS df FROM p GROUP BY term),
g AS (SELECT count(*) AS texts, avg(words) AS mean FROM l),
s AS (SELECT p.doc_id, p.term, ln(1 + (texts - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * words / mean)) AS score
  FROM p JOIN v ON v.term = p.term JOIN l ON l.doc_id = p.doc_id, g)"""


def _index(spark, sf_dir) -> TextIndex:
    return TextIndex.of(table(spark, sf_dir, "documents"), F.col("text"), "doc_id", STOP)


def _shown(hits):
    return hits.select("id", F.round("score", 6).alias("score"))


@query(f"WITH {_POSTINGS} SELECT doc_id AS id, CAST(words AS INTEGER) AS words FROM l")
def text_lengths(spark, sf_dir):
    return _index(spark, sf_dir).lengths


@query(f"WITH {_POSTINGS} SELECT term, df FROM v WHERE df >= 20")
def text_vocabulary(spark, sf_dir):
    return _index(spark, sf_dir).vocabulary().where("df >= 20")


@query(f"WITH {_POSTINGS} SELECT doc_id AS id, round(sum(score), 6) AS score FROM s WHERE term IN ('that', 'from') GROUP BY doc_id HAVING count(*) = 2")
def text_search_and(spark, sf_dir):
    return _shown(_index(spark, sf_dir).hits("that from", stop_words=STOP))


@query(f"WITH {_POSTINGS} SELECT doc_id AS id, round(sum(score), 6) AS score FROM s WHERE term IN ('idiot', 'pour') GROUP BY doc_id ORDER BY sum(score) DESC, doc_id LIMIT 30")
def text_search_or_top(spark, sf_dir):
    return _shown(_index(spark, sf_dir).hits("idiot the pour", any_term=True, stop_words=STOP, top=30))


@query(f"""WITH {_POSTINGS}, x AS (SELECT term FROM v WHERE starts_with(term, 'lice'))
SELECT doc_id AS id, round(sum(score), 6) AS score FROM s WHERE term IN (SELECT term FROM x) GROUP BY doc_id""")
def text_search_prefix(spark, sf_dir):
    return _shown(_index(spark, sf_dir).hits("lice*"))


@query(f"""WITH {_POSTINGS}, i AS (SELECT term FROM v WHERE contains(term, 'icens')),
x AS (SELECT 'icens' AS term, 1 AS k UNION ALL SELECT term, row_number() OVER (ORDER BY term) + 1 FROM i WHERE term <> 'icens')
SELECT doc_id AS id, round(sum(score / k), 6) AS score FROM s JOIN x ON x.term = s.term GROUP BY doc_id""")
def text_search_infix(spark, sf_dir):
    return _shown(_index(spark, sf_dir).hits("*icens"))


@query(f"""WITH {_POSTINGS}, n AS (SELECT term, levenshtein(term, 'licensa') AS d FROM v), a AS (SELECT count(*) AS c FROM n WHERE d = 1),
c AS (SELECT term FROM n, a WHERE d BETWEEN 1 AND CASE WHEN c > 2 THEN 1 ELSE 2 END),
x AS (SELECT 'licensa' AS term, 1 AS k UNION ALL SELECT term, row_number() OVER (ORDER BY term) + 1 FROM c)
SELECT doc_id AS id, round(sum(score / k), 6) AS score FROM s JOIN x ON x.term = s.term GROUP BY doc_id""")
def text_search_fuzzy(spark, sf_dir):
    return _shown(_index(spark, sf_dir).hits("licensa~"))


@query(f"""WITH {_POSTINGS} SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM p WHERE term IN ('apache', 'version') GROUP BY doc_id HAVING count(*) = 2)""")
def text_where_search(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return _index(spark, sf_dir).matching(docs, "Apache version", "doc_id").select("doc_id", "lang")


@query(f"""WITH {_POSTINGS}, n AS (SELECT term, levenshtein(term, 'licence') AS distance, df FROM v), a AS (SELECT count(*) AS c FROM n WHERE distance = 1)
SELECT term, CAST(distance AS INTEGER) AS distance, df FROM n, a WHERE distance BETWEEN 1 AND CASE WHEN c > 2 THEN 1 ELSE 2 END ORDER BY distance, term LIMIT 10""")
def text_suggest(spark, sf_dir):
    return _index(spark, sf_dir).suggest("Licence")


@query("""WITH p AS (SELECT doc_id, text, length(text) AS n, position('apache' IN lower(text)) AS here FROM documents),
q AS (SELECT *, greatest(least(here + 3 - 40, n - 79), 1) AS a FROM p), r AS (SELECT *, greatest(least(a + 80, n + 1), here + 6) AS b FROM q)
SELECT doc_id, CASE WHEN here > 0 THEN CASE WHEN a > 1 THEN '...' ELSE '' END || substr(text, a, here - a) || '[' || substr(text, here, 6) || ']' || substr(text, here + 6, b - here - 6) || CASE WHEN b <= n THEN '...' ELSE '' END
ELSE substr(text, 1, 80) || CASE WHEN n > 80 THEN '...' ELSE '' END END AS part FROM r""")
def text_snippet(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.snippet(F.col("text"), ["apache"], 80).alias("part"))


@query(r"""WITH p AS (SELECT doc_id, text, length(text) AS n, regexp_extract_all(text, '[\p{L}\p{Nd}'']+|[^\p{L}\p{Nd}'']+') AS parts FROM documents),
f AS (SELECT *, list_position(list_transform(parts, lambda w: levenshtein(lower(w), 'licenza') <= 2), true) AS i FROM p),
h AS (SELECT *, CASE WHEN i > 0 THEN 1 + coalesce(list_sum(list_transform(parts[1:i - 1], lambda w: length(w))), 0) ELSE 0 END::BIGINT AS here, CASE WHEN i > 0 THEN length(parts[i]) ELSE 0 END AS w FROM f),
q AS (SELECT *, greatest(least(here + w // 2 - 40, n - 79), 1) AS a FROM h), r AS (SELECT *, greatest(least(a + 80, n + 1), here + w) AS b FROM q)
SELECT doc_id, CASE WHEN here > 0 THEN CASE WHEN a > 1 THEN '...' ELSE '' END || substr(text, a, here - a) || '[' || substr(text, here, w) || ']' || substr(text, here + w, b - here - w) || CASE WHEN b <= n THEN '...' ELSE '' END
ELSE substr(text, 1, 80) || CASE WHEN n > 80 THEN '...' ELSE '' END END AS part FROM r""")
def text_snippet_near(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.snippet(F.col("text"), ["licenza"], 80, edits=2).alias("part"))


@query(f"""WITH {_POSTINGS}, h AS (SELECT doc_id, sum(score) AS score FROM s WHERE term IN ('apache', 'version') GROUP BY doc_id HAVING count(*) = 2)
SELECT doc_id, lang FROM documents JOIN h USING (doc_id) WHERE lang = 'en' ORDER BY round(score, 9) DESC, doc_id LIMIT 4 OFFSET 4""")
def text_listing(spark, sf_dir):
    hits = _index(spark, sf_dir).hits("Apache version").withColumn("score", F.round("score", 9))
    docs = table(spark, sf_dir, "documents")
    return filters.listing(docs, {"lang": {"eq": "en"}}, page=1, page_size=4, key="doc_id", hits=hits).rows.select("doc_id", "lang")


_QUERY_VECTOR = "(SELECT embedding FROM embeddings WHERE vec_id = 3)"
_DOT = "list_sum(list_transform(range(1, 65), lambda i: CAST(e.embedding[i] AS DOUBLE) * CAST(q.embedding[i] AS DOUBLE)))"


def _vector(spark, sf_dir, vec_id: int = 3) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).first()["embedding"])


@query(f"SELECT e.vec_id AS id, round({_DOT}, 6) AS score FROM embeddings e, {_QUERY_VECTOR} q ORDER BY {_DOT} DESC, e.vec_id LIMIT 10")
def vector_top(spark, sf_dir):
    return _shown(search.similar_vectors(table(spark, sf_dir, "embeddings"), "embedding", _vector(spark, sf_dir), top=10, key="vec_id"))


@query(f"SELECT e.vec_id AS id, round({_DOT}, 6) AS score FROM embeddings e, {_QUERY_VECTOR} q WHERE {_DOT} >= 0.15")
def vector_least_similarity(spark, sf_dir):
    return _shown(search.similar_vectors(table(spark, sf_dir, "embeddings"), "embedding", _vector(spark, sf_dir), least=0.15, key="vec_id"))


@query()
def vector_clustered(spark, sf_dir):
    held = search.ClusteredVectors.of(table(spark, sf_dir, "embeddings"), "embedding", clusters=8)
    return _shown(held.search(_vector(spark, sf_dir), accuracy=0.5, top=10, key="vec_id"))


@query(f"""WITH {_POSTINGS}, a AS (SELECT doc_id AS id, row_number() OVER (ORDER BY sum(score) DESC, doc_id) AS r FROM s WHERE term = 'that' AND doc_id IN (SELECT vec_id FROM embeddings)
  GROUP BY doc_id),
b AS (SELECT e.vec_id AS id, row_number() OVER (ORDER BY {_DOT} DESC, e.vec_id) AS r FROM embeddings e, {_QUERY_VECTOR} q WHERE {_DOT} >= 0.05 AND e.vec_id IN (SELECT doc_id FROM documents))
SELECT id, round(sum(part), 6) AS score FROM (SELECT id, 0.6 / (r + 60) AS part FROM a UNION ALL SELECT id, 0.4 / (r + 60) FROM b) GROUP BY id""")
def hybrid_search(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id"), "doc_id")
    return _shown(search.hybrid(docs, _index(spark, sf_dir), "that", "embedding", _vector(spark, sf_dir), ratio=0.4, least=0.05, key="doc_id"))


@query(r"""SELECT page_id, array_to_string(regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=\s*["'']([^"'']*)["'']', 1), ' ') AS links,
array_to_string(regexp_extract_all(html, '(?i)<img\s[^>]*?src\s*=\s*["'']([^"'']*)["'']', 1), ' ') AS images FROM pages""")
def html_links_images(spark, sf_dir):
    html, flat = F.col("html"), lambda c, name: F.array_join(c, " ").alias(name)
    return table(spark, sf_dir, "pages").select("page_id", flat(text.html_links(html), "links"), flat(text.html_images(html), "images"))


@query(r"""SELECT page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(html, '(?i)(?:href|src)\s*=\s*["'']([^"'']*)["'']', 1))), ' ') AS urls,
regexp_replace(html, '(?i)((?:href|src)\s*=\s*["''])https://', '\1http://', 'g') AS rewritten FROM pages""")
def html_urls_rewrite(spark, sf_dir):
    html = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(F.array_sort(text.html_urls(html)), " ").alias("urls"), text.html_rewrite(html, "https://", "http://").alias("rewritten"))


@query(r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<!--.*?-->', ' ', 'g'), '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g') AS h FROM pages),
b AS (SELECT page_id, replace(replace(replace(replace(replace(replace(regexp_replace(h, '(?s)<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS t FROM a)
SELECT page_id, length(trim(regexp_replace(t, '\s+', ' ', 'g'))) AS chars, md5(trim(regexp_replace(t, '\s+', ' ', 'g'))) AS digest FROM b""")
def html_to_text(spark, sf_dir):
    plain = text.html_text(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.length(plain).cast("long").alias("chars"), F.md5(plain).alias("digest"))


@query("SELECT doc_id, md5(lang || ' ' || source || ' ' || source) AS digest FROM documents")
def text_combined(spark, sf_dir):
    docs = search.combined_text(table(spark, sf_dir, "documents"), {"lang": 1, "source": 2})
    return docs.select("doc_id", F.md5("__text").alias("digest"))
