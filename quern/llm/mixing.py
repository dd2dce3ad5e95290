"""Mixing documents to target weights of domains with soft membership, in DataFrame operations alone.

A naive Bayes classifier, fitted on a table of labelled documents, gives every document its posterior of each domain.
Document rates x >= 0 are then fitted by projected gradient descent on least squares, so that the expected tokens of
each domain, the sum of x times tokens times posterior, match the targets. A step needs one sum per domain and per pair
of domains over all documents; the rates themselves stay on the executors.
"""

from __future__ import annotations

import json
import math
import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import materialise, release, table

#: Most words of each domain's lexicon, how many times likelier than anywhere they must be, and the part of the
#: domain's documents that must have them; RANGES ranges for each statistic.
LEXICON, LIFT, SUPPORT, RANGES = 64, 4.0, 0.01, 10
#: Most labelled documents that are fitted: those whose ids hash lowest.
FIT_ROWS = 20_000
#: Posteriors are softened by this power.
TEMPERATURE = 1.0
#: Each target is met up to this part of it; steps that no targets in reach should need.
TOLERANCE, STEPS = 1e-4, 60
#: How little it counts that rates leave 1, against targets.
EASE = 1e-7
TARGETS = {"good": 0.90, "poor": 0.08, "toxic": 0.02}
_CAPITALS, _SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "!$%&#*|"


def _words(text: Column) -> Column:
    """Runs of letters and digits in lower case."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{Nd}]+"), lambda w: w != "")


def _ranges(text: Column, words: Column, lexicons: list[list[str]]) -> list[Column]:
    """In which range each statistic of a text is: the part of capitals and that of symbols among its characters, and
    how many words of each lexicon it has."""
    share = lambda chars: (F.length(text) - F.length(F.translate(text, chars, ""))) / F.greatest(F.length(text), F.lit(1))
    found = [F.floor(share(chars) * 2 * RANGES) for chars in (_CAPITALS, _SYMBOLS)]
    found += [F.size(F.array_intersect(words, _literal(lexicon, "array<string>"))) for lexicon in lexicons]
    return [F.least(x, F.lit(RANGES - 1)).cast("int") for x in found]


@dataclass
class DomainModel:
    """A log prior of each domain, its lexicon, and the log likelihood of each range of each statistic in it."""

    domains: list[str]
    prior: list[float]
    lexicons: list[list[str]]
    ranges: list[list[list[float]]]


def learn(labelled: DataFrame, domains: list[str], most: int = FIT_ROWS) -> DomainModel:
    """Fit naive Bayes on at most `most` rows of (doc_id, text, domain).

    Its inputs are statistics of the characters and the number of words of each domain's lexicon, the words that tell
    it best from the others. Rows of other domains or null texts teach nothing, copies of a text count once; without
    rows all are alike. What reaches the driver are the lexicons and the counts of the ranges.
    """
    rows = labelled.where(F.col("domain").isin(domains) & F.col("text").isNotNull()).orderBy(F.xxhash64("doc_id"), "doc_id", "domain").limit(most)
    rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy(F.xxhash64("text")).orderBy("doc_id"))).where("copy = 1")
    rows = materialise(rows.select("domain", "text", F.array_distinct(_words(F.col("text"))).alias("words")))
    n = {r["domain"]: r["count"] for r in rows.groupBy("domain").count().collect()}
    n = [n.get(d, 0) for d in domains]
    total = max(sum(n), 1)
    counts = [F.count(F.when(F.col("domain") == d, 1)).alias(f"n{k}") for k, d in enumerate(domains)]
    held = materialise(rows.select("domain", F.explode("words").alias("word")).groupBy("word").agg(*counts, F.count(F.lit(1)).alias("n")).where("n > 2"))
    lexicons = []
    for k in range(len(domains)):
        # Pointwise information on the domain, of words LIFT times likelier in it than anywhere.
        mine = F.col(f"n{k}")
        lift = mine / max(n[k], 1) / (F.col("n") / total)
        best = held.where((lift >= LIFT) & (mine >= SUPPORT * n[k])).orderBy(F.desc(mine * F.log(lift)), "word").limit(LEXICON)
        lexicons.append([r["word"] for r in best.collect()])
    found = rows.select("domain", F.posexplode(F.array(*_ranges(F.col("text"), F.col("words"), lexicons))).alias("k", "i"))
    seen = {(r["domain"], r["k"], r["i"]): r["count"] for r in found.groupBy("domain", "k", "i").count().collect()}
    ranges = [
        [[math.log((seen.get((d, k, i), 0) + 0.5) / (n[j] + 0.5 * RANGES)) for j, d in enumerate(domains)] for i in range(RANGES)]
        for k in range(2 + len(domains))
    ]
    release(labelled.sparkSession, rows, held)
    return DomainModel(domains, [math.log((x + 1) / (sum(n) + len(n))) for x in n], lexicons, ranges)


def _literal(values: list, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(values)), kind)


def posteriors(docs: DataFrame, model: DomainModel) -> DataFrame:
    """Add `tokens`, the number of words, and `posterior`, an array over the domains, from the whole text of each row.

    A null or empty text has no tokens and the prior as posterior.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.withColumn("__words", _words(text)).withColumn("tokens", F.size("__words").cast("long"))
    at = [f"__r{k}" for k in range(len(model.ranges))]
    docs = docs.withColumns(dict(zip(at, _ranges(text, F.col("__words"), model.lexicons), strict=True)))
    said = [F.get(_literal(r, "array<array<double>>"), F.col(c)) for r, c in zip(model.ranges, at, strict=True)]
    names = [f"__s{k}" for k in range(len(model.domains))]
    for k, name in enumerate(names):
        score = sum((F.get(s, k) for s in said), F.lit(model.prior[k]))
        docs = docs.withColumn(name, F.when(F.col("tokens") > 0, score).otherwise(F.lit(model.prior[k])))
    powers = [F.exp((F.col(n) - F.greatest(*names)) / TEMPERATURE) for n in names]
    total = sum(powers[1:], powers[0])
    return docs.withColumn("posterior", F.array(*(p / total for p in powers))).drop("__words", *at, *names)


def _rate(moved: np.ndarray) -> Column:
    """The rate of a row after the gradients summed in `moved`: 1 less posterior . moved, projected to 0 or more."""
    down = F.aggregate(F.zip_with("posterior", _literal(moved.tolist(), "array<double>"), lambda p, m: p * m), F.lit(0.0), lambda s, x: s + x)
    return F.greatest(F.lit(0.0), 1.0 - down)


def fit_rates(rows: DataFrame, targets: list[float], steps: int = STEPS) -> tuple[DataFrame, list[float]]:
    """Add `rate` to `rows`, a written table of (tokens, posterior, ...); `targets` are the tokens wanted of each domain.

    Least squares: rates x >= 0 make sum over domains of (tokens - target)^2 / (EASE target) + sum over rows of
    tokens (x - 1)^2 least, so targets are met but for a small part of EASE, by rates as near to 1 as that lets them be.
    Projected gradient descent in its lazy form: gradients are summed and the sum is projected. A gradient is a
    combination of the posteriors, so the sum is one number for each domain. It is scaled by the sum of tokens times
    posterior times posterior over the rows whose rate is above 0, so a step is right at once but for the rates that
    meet 0; a step that goes too far is halved. Rows are read once a step and not written. Returned are also the tokens
    reached; where rates >= 0 cannot meet the targets, those are as near as least squares get.
    """
    k = len(targets)
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]
    wanted = np.array(targets, dtype=float)
    ease = EASE * np.maximum(wanted, 1.0)

    def state(moved: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """The dual of the sum of squares, the tokens reached, and the scale of the gradient."""
        p, held = F.col("posterior"), rows.select("tokens", "posterior", _rate(moved).alias("rate"))
        free = F.when(F.col("rate") > 0, F.col("tokens")).otherwise(F.lit(0))
        sums = [F.sum(F.col("tokens") * F.col("rate") * F.col("rate"))] + [F.sum(F.col("rate") * F.col("tokens") * p[d]) for d in range(k)] + [F.sum(free * p[i] * p[j]) for i, j in pairs]
        found = [float(x or 0.0) for x in held.agg(*(x.alias(f"s{n}") for n, x in enumerate(sums))).first()]
        scale = np.diag(ease)
        for (i, j), x in zip(pairs, found[k + 1 :], strict=True):
            scale[i, j] = scale[j, i] = scale[i, j] + x
        return found[0] / 2 + float(moved @ wanted + (ease * moved * moved).sum() / 2), np.array(found[1 : k + 1]), scale

    moved = np.zeros(k)
    value, reached, scale = state(moved)
    for _ in range(steps):
        slope = reached - wanted - ease * moved
        if (np.abs(slope) <= TOLERANCE / 10 * np.maximum(wanted, 1.0)).all():
            break
        step = np.linalg.solve(scale, slope)
        part, gain = 1.0, float(slope @ step)
        while part > 1e-6:
            new = state(moved + part * step)
            if new[0] <= value - 1e-4 * part * gain + 1e-12 * abs(value):
                break
            part /= 2
        else:
            break
        moved = moved + part * step
        value, reached, scale = new
    return rows.withColumn("rate", _rate(moved)), reached.tolist()


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], budget: float | str | None = None, most: int = FIT_ROWS, without: tuple[str, ...] = ()) -> DataFrame:
    """Add tokens, posterior, rate and copies to `docs`, so that domains get the target shares of the budget.

    `labelled` has (doc_id, domain). The budget is in tokens; by default as many as there are; the name of a domain
    stands for as many as give that domain what it has. copies is the rate rounded up or down by a hash of doc_id, so
    that it is right on average. An empty table gives no rows; texts without words weigh nothing and have rates too.
    Targets that no rates can meet, as those of a domain in which no document can be, are met as nearly as least
    squares allow, and a warning says so.
    Columns of these names are replaced; those named in `without` are not returned, nor written in between.
    """
    domains = sorted(targets)
    few = labelled.where(F.col("domain").isin(domains)).groupBy("doc_id").agg(F.max("domain").alias("domain"))
    few = few.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    model = learn(docs.select("doc_id", "text").join(F.broadcast(few), "doc_id"), domains, most)  # `most` rows at most
    rows = materialise(posteriors(docs, model).drop(*without))
    have = rows.agg(F.sum("tokens").alias("all"), *(F.sum(F.col("tokens") * F.col("posterior")[d]).alias(f"d{d}") for d in range(len(domains)))).first()
    share = sum(targets.values())
    if isinstance(budget, str):
        budget = float(have[f"d{domains.index(budget)}"] or 0.0) * share / targets[budget]
    total = float(have["all"] or 0.0) if budget is None else budget
    wanted = [total * targets[d] / share for d in domains]
    rows, reached = fit_rates(rows, wanted)
    missed = {d: (r, w) for d, r, w in zip(domains, reached, wanted, strict=True) if abs(r - w) > TOLERANCE * max(w, 1.0)}
    if missed and total > 0:
        warnings.warn(f"targets that rates >= 0 cannot meet, as (tokens reached, tokens wanted): {missed}", stacklevel=2)
    chance = F.pmod(F.xxhash64("doc_id", F.lit("mix")), F.lit(1 << 20)) / (1 << 20)
    return rows.withColumn("copies", F.floor(F.col("rate") + chance).cast("long"))


def label_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of `labels`: toxic, else good or poor by quality."""
    name = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")
    return labels.select("doc_id", name.alias("domain")).where(F.col("domain").isNotNull())


def op6_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = mix(docs, label_domains(table(spark, sf_dir, "labels")), TARGETS, without=("text",))
    return mixed.select("doc_id", "source", "tokens", *(F.col("posterior")[k].alias(f"p_{d}") for k, d in enumerate(sorted(TARGETS))), "rate", "copies")
