"""Full-text ranking, vector similarity and their fusion."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import MAX_COUNT, MIN_WORD, Term, snippet, terms, tokens
from quern.sources.shared import literal_rows, numbered, written

#: Fixed values of BM25 and of reciprocal rank fusion.
K1, B, RRF = 1.2, 0.75, 60
RATIO, LEAST_SIMILARITY = 0.5, 0.34
#: How far a vector's similarity may fall below a bound of 1 or -1 by rounding.
SLACK = 1e-4
#: For words shorter than the first number, the edit distance that is tried first and the wider one.
DISTANCES = ((2, (0, 0)), (5, (0, 1)), (10, (1, 2)), (15, (2, 3)))
LONG_DISTANCES = (3, 4)
#: More variations than this at the first distance, and the wider one is not tried.
FEW = 2


def fuzzy_distances(length: int) -> tuple[int, int]:
    """The edit distance that is tried first for a word of this length, and the wider one for few results."""
    return next((found for below, found in DISTANCES if length < below), LONG_DISTANCES)


def _within(term: Column, word: str, distance: int) -> Column:
    """Whether a term is at an edit distance from 1 to `distance` of the word."""
    near = F.levenshtein(term, F.lit(word), distance)
    return (F.abs(F.length(term) - len(word)) <= distance) & near.between(1, distance)


@dataclass
class TextIndex:
    """The words of the texts of a frame, to be searched.

    Made by `of`, it has the texts' words (id, words) and reads them once for each search, of which it keeps those that
    are asked for. Made by `read`, it has stored postings (id, term, tf, words), ordered by term so that a search reads
    the row groups of its terms alone; words is the length of the text.
    """

    texts: DataFrame | None
    stored: DataFrame | None = None
    stored_lengths: DataFrame | None = None

    @staticmethod
    def of(df: DataFrame, text: Column, key: str = "id", stop_words: Iterable[str] = (), min_word: int = MIN_WORD) -> TextIndex:
        return TextIndex(df.select(F.col(key).alias("id"), tokens(text, stop_words, min_word).alias("words")))

    @staticmethod
    def read(spark: SparkSession, path: str) -> TextIndex:
        """The index that `write` left in a folder."""
        return TextIndex(None, spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/lengths"))

    def write(self, path: str) -> TextIndex:
        """Store the index in a folder and read it from there."""
        self.lengths.write.parquet(f"{path}/lengths")
        self.postings.repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.parquet(f"{path}/postings")
        return TextIndex.read(self.lengths.sparkSession, path)

    @property
    def lengths(self) -> DataFrame:
        """(id, words): how many words each text has."""
        return self.texts.select("id", F.size("words").alias("words")) if self.texts is not None else self.stored_lengths

    @property
    def postings(self) -> DataFrame:
        """(id, term, tf, words) of every word of every text."""
        if self.texts is None:
            return self.stored
        return _counted(self.texts.select("id", F.size("words").alias("words"), F.explode("words").alias("term")))

    def vocabulary(self) -> DataFrame:
        """(term, df): in how many texts each word is."""
        return _frequencies(self.postings)

    @cached_property
    def _totals(self) -> tuple[int, float]:
        return _sizes(self.lengths)

    def find(self, wanted: Callable[[Column], Column]) -> tuple[DataFrame, int, float]:
        """Postings of the terms for which a predicate holds, a written table; the number of texts and their mean length."""
        if self.texts is None:
            return written(self.stored.where(wanted(F.col("term")))), *self._totals
        rows = written(self.texts.select("id", F.size("words").alias("words"), F.filter("words", wanted).alias("found")))
        postings = _counted(rows.where(F.size("found") > 0).select("id", "words", F.explode("found").alias("term")))
        return written(postings), *_sizes(rows)

    def hits(self, query: str | list[Term], any_term: bool = False, stop_words: Iterable[str] = (), top: int | None = None) -> DataFrame:
        """(id, score) of the texts that have all terms of the query, or any; all of them or the `top` best.

        Every word that a term stands for counts: a prefix's, an infix's or a misspelling's variations are joined,
        not listed. Of two texts with one score the smaller id comes first.
        """
        asked = terms(query, stop_words) if isinstance(query, str) else query
        if not asked:
            return self.lengths.select("id", F.lit(0.0).alias("score")).limit(0)
        postings, texts, mean = self.find(lambda w: reduce(lambda a, b: a | b, [_stands_for(term, w) for term in asked]))
        words = _frequencies(postings)
        if all(not (t.prefix or t.infix or t.fuzzy) for t in asked):
            named = literal_rows(postings.sparkSession, ["t", "term", "variation"], [(k, t.word, 1) for k, t in enumerate(asked)])
            variations = F.broadcast(words.join(named, "term"))  # the words of the query
        else:
            words = written(words)
            variations = reduce(DataFrame.unionByName, [_variations(words, t).withColumn("t", F.lit(k)) for k, t in enumerate(asked)])
            variations = words.join(variations, "term")
        idf = F.log(1 + (texts - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("words") / (mean or 1.0)))
        found = postings.join(variations, "term").groupBy("id").agg(F.sum(idf * weight / F.col("variation")).alias("score"), F.size(F.collect_set("t")).alias("n"))
        found = (found if any_term else found.where(F.col("n") == len(asked))).select("id", "score")
        return found if top is None else found.orderBy(F.desc("score"), "id").limit(top)

    def matching(self, df: DataFrame, query: str, key: str = "id", any_term: bool = False) -> DataFrame:
        """The rows of `df` whose text matches, unranked."""
        return df.join(self.hits(query, any_term).select(F.col("id").alias(key)), key, "left_semi")

    def suggest(self, word: str, common: bool = False, most: int = 10) -> DataFrame:
        """(term, distance, df): spellings near a word, the nearest first; `common` divides by how common they are."""
        word = word.lower()
        narrow, wide = fuzzy_distances(len(word))
        postings, *_ = self.find(lambda w: _within(w, word, wide) if wide else F.lit(False))
        near = written(_frequencies(postings).withColumn("distance", F.levenshtein(F.col("term"), F.lit(word))))
        if narrow and near.where(F.col("distance") <= narrow).limit(FEW + 1).count() > FEW:
            near = near.where(F.col("distance") <= narrow)
        return near.orderBy(F.col("distance") / F.col("df") if common else F.col("distance"), "term").limit(most)


def _counted(words: DataFrame) -> DataFrame:
    return words.groupBy("id", "term", "words").agg(F.least(F.count(F.lit(1)), F.lit(MAX_COUNT)).alias("tf")).select("id", "term", "tf", "words")


def _frequencies(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def _sizes(lengths: DataFrame) -> tuple[int, float]:
    row = lengths.agg(F.count(F.lit(1)).alias("texts"), F.avg("words").alias("mean")).first()
    return row["texts"], float(row["mean"] or 0.0)


def _stands_for(term: Term, w: Column) -> Column:
    """Whether a term of a query can stand for a word of a text."""
    holds = w == F.lit(term.word)
    if term.prefix:
        holds |= w.startswith(term.word)
    if term.infix:
        holds |= w.contains(term.word)
    if term.fuzzy:
        wide = fuzzy_distances(len(term.word))[1]
        holds |= F.exists(_beginnings(w), lambda b: _within(b, term.word, wide)) if term.prefix else _within(w, term.word, wide)
    return holds


def _beginnings(w: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda n: F.substring(w, F.lit(1), n))


def _variations(words: DataFrame, term: Term) -> DataFrame:
    """(term, variation): the words a term stands for. The word itself is variation 1; then come words that contain it and
    misspellings of it, each in order and numbered on. With a prefix, all words that begin with a variation have its number."""
    own = literal_rows(words.sparkSession, ["term", "place"], [(term.word, 0)])
    found = [own]
    if term.infix:
        found.append(words.where(F.col("term").contains(term.word) & (F.col("term") != term.word)).select("term", F.lit(1).alias("place")))
    if term.fuzzy:
        narrow, wide = fuzzy_distances(len(term.word))
        close = words.where(_within(F.col("term"), term.word, wide)) if wide else words.limit(0)
        if narrow and wide > narrow and close.where(_within(F.col("term"), term.word, narrow)).limit(FEW + 1).count() > FEW:
            close = close.where(_within(F.col("term"), term.word, narrow))
        found.append(close.select("term", F.lit(2).alias("place")))
    if len(found) == 1:
        variations = own.select("term", F.lit(1).cast("long").alias("variation"))
    else:
        each = reduce(DataFrame.unionByName, found).groupBy("term").agg(F.min("place").alias("place"))
        variations = numbered(each, ["place", "term"], "variation").select("term", "variation")
    if not term.prefix:
        return variations
    begins = words.select("term", F.explode(_beginnings(F.col("term"))).alias("begin"))
    return begins.join(variations.withColumnRenamed("term", "begin"), "begin").select("term", "variation")


def dot(vector: Column, query: list[float]) -> Column:
    """Inner product in doubles, in the order of the components."""
    other = F.array(*(F.lit(float(x)) for x in query))
    return F.aggregate(F.zip_with(vector, other, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def similar_vectors(df: DataFrame, vector: str, query: list[float], least: float = -1.0, top: int | None = None, key: str = "id") -> DataFrame:
    """(id, score) of the vectors at least so similar, the most similar first; vectors are taken as of length 1."""
    bound = least - SLACK if least in (1.0, -1.0) else least
    found = df.select(F.col(key).alias("id"), dot(F.col(vector), query).alias("score")).where(F.col("score") >= bound)
    return found if top is None else found.orderBy(F.desc("score"), "id").limit(top)


@dataclass
class ClusteredVectors:
    """Vectors with the cluster that each is in: a search looks into the nearest clusters alone."""

    frame: DataFrame
    centres: list[list[float]]
    vector: str

    @staticmethod
    def of(df: DataFrame, vector: str, clusters: int = 16, seed: int = 7) -> ClusteredVectors:
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        rows = df.withColumn("__v", array_to_vector(F.col(vector).cast("array<double>")))
        model = KMeans(k=clusters, seed=seed, featuresCol="__v", predictionCol="__cluster").fit(rows)
        return ClusteredVectors(model.transform(rows).drop("__v"), [list(map(float, c)) for c in model.clusterCenters()], vector)

    def search(self, query: list[float], accuracy: float = 0.25, top: int = 10, least: float = -1.0, key: str = "id") -> DataFrame:
        """Look into the part `accuracy` of the clusters, the nearest ones; 1 is exact."""
        order = sorted(range(len(self.centres)), key=lambda k: -sum(a * b for a, b in zip(self.centres[k], query, strict=True)))
        nearest = order[: max(1, round(accuracy * len(order)))]
        return similar_vectors(self.frame.where(F.col("__cluster").isin(nearest)), self.vector, query, least, top, key)


def fuse(words: DataFrame, vectors: DataFrame, ratio: float = RATIO) -> DataFrame:
    """(id, score): reciprocal rank fusion of two lists of (id, score), `ratio` the weight of the vectors'.

    Each list is ranked by its own score, ties by id, in parts that are numbered one after another. A ratio near 0 or 1
    is the one list alone.
    """
    if ratio <= 0.01:
        return words
    if ratio >= 0.99:
        return vectors
    part = lambda hits, weight: numbered(hits, [F.desc("score"), F.asc("id")], "rank").select("id", (F.lit(weight) / (F.col("rank") + RRF)).alias("part"))
    return part(words, 1 - ratio).unionByName(part(vectors, ratio)).groupBy("id").agg(F.sum("part").alias("score"))


def hybrid(df: DataFrame, index: TextIndex, query: str, vector: str, embedded: list[float], ratio: float = RATIO, least: float = LEAST_SIMILARITY, any_term: bool = False, most_hits: int | None = None, key: str = "id") -> DataFrame:
    """Ranked search of the rows of `df` by words and vectors: the filter comes before the cut of each list, if one is asked for."""
    words = index.hits(query, any_term).join(df.select(F.col(key).alias("id")), "id", "left_semi")
    words = words if most_hits is None else words.orderBy(F.desc("score"), "id").limit(most_hits)
    return fuse(words, similar_vectors(df, vector, embedded, least, most_hits, key), ratio)


@dataclass
class SearchHits:
    """Rows with their score and a sample of their text, the best first, and whether more were found than asked for."""

    rows: DataFrame
    capped: bool


def ranked(df: DataFrame, hits: DataFrame, most_hits: int | None = None, text: str | None = None, words: Iterable[str] = (), key: str = "id", length: int = 255) -> SearchHits:
    """The rows of `df` that are among the hits (id, score), with `score` and, of the column `text`, a `sample` around the
    first of the words."""
    hits = written(hits.join(df.select(F.col(key).alias("id")), "id", "left_semi"))
    capped = most_hits is not None and hits.limit(most_hits + 1).count() > most_hits
    best = hits if most_hits is None else hits.orderBy(F.desc("score"), "id").limit(most_hits)
    rows = df.join(best.withColumnRenamed("id", key), key)
    if text is not None:
        rows = rows.withColumn("sample", snippet(F.col(text), list(words), length))
    return SearchHits(rows.orderBy(F.desc("score"), key), capped)


def combined_text(df: DataFrame, boosts: dict[str, int], children: DataFrame | None = None) -> DataFrame:
    """Add `__text`: the text properties joined, each repeated as often as it is boosted, and the children's (parent, text)."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c, n in boosts.items() for _ in range(n)]
    whole = F.concat_ws(" ", *parts)
    if children is None:
        return df.withColumn("__text", whole)
    below = children.groupBy("parent").agg(F.concat_ws(" ", F.sort_array(F.collect_list("text"))).alias("__below"))
    joined = df.withColumn("__text", whole).join(below.withColumnRenamed("parent", "id"), "id", "left")
    return joined.withColumn("__text", F.concat_ws(" ", "__text", "__below")).drop("__below")
