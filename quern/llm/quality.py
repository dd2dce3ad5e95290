"""Quality classification by a factorisation machine.

Inputs are hashed words, statistics of a text's structure and its length. Each input has a weight and a vector of
RANK components; every pair of inputs interacts by the inner product of their vectors. The sum over all pairs is
half of (the square of the sum less the sum of squares) in each component, so scoring is linear in the inputs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import table
from quern.llm.language import part_of
from quern.llm.text import blocks, codes, fold, kinds, span_hashes

#: Buckets of hashed words (a power of 2); then structure statistics and the length, each a number and a range.
WORDS, STATS, RANGES = 4096, 12, 10
INPUTS = WORDS + STATS + STATS * RANGES
RANK = 8
#: Most labelled rows that are fitted: with INPUTS numbers to a row at most, the bound of what the driver gathers.
FIT_ROWS, EPOCHS, BATCH, RATE, DECAY, SEED = 12_000, 12, 64, 0.02, 2e-5, 5
#: Parts of the labelled rows of which each is scored by a fit on the others.
FOLDS = 3
THRESHOLD = 0.3


def inputs(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse inputs of the texts as (row, input, value), ordered by row; every text has some, empty ones too."""
    n = len(texts)
    words = np.zeros((0, 2), dtype=np.int64)
    held = []
    total = np.zeros((n, 8))  # characters, words, letters, digits, upper case, blanks, lines, distinct marks' runs
    lengths = np.zeros(n)
    for parts, rows, _ in blocks(texts):
        points, at = codes(parts)
        low, _ = codes([fold(p) for p in parts])
        of = np.repeat(np.arange(len(parts)), np.diff(np.append(at, len(points))))
        row, kind = rows[of], kinds(points)
        sums = lambda x: np.bincount(row[x], minlength=n)  # noqa: B023, E731
        blank, line = (points == 32) | (points == 9) | (points == 10) | (points == 13), points == 10
        mark = (kind == 0) & ~blank
        inside = kind > 0
        change = np.diff(np.concatenate([[0], inside.astype(np.int8)]))
        starts, ends = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
        again = mark & np.concatenate([[False], mark[:-1]])
        for k, x in enumerate((kind >= 0, None, kind == 1, kind == 2, points != low, blank, line, again)):
            total[:, k] += np.bincount(row[starts], minlength=n) if x is None else sums(x)
        lengths += np.bincount(row[starts], weights=ends - starts, minlength=n)
        if len(starts):
            h = (span_hashes(low, starts, ends) & np.uint64(WORDS - 1)).astype(np.int64)
            keys, counts = np.unique(row[starts] * WORDS + h, return_counts=True)
            held.append(np.stack([keys, counts], axis=1))
    chars, count, letters, digits, upper, white, lines, again = total.T
    if held:
        keys, inverse = np.unique(np.concatenate([x[:, 0] for x in held]), return_inverse=True)
        words = np.stack([keys, np.bincount(inverse, weights=np.concatenate([x[:, 1] for x in held])).astype(np.int64)], axis=1)
    row, bucket, tf = words[:, 0] // WORDS, words[:, 0] % WORDS, np.log1p(words[:, 1])
    norm = np.sqrt(np.bincount(row, weights=tf * tf, minlength=n))
    distinct = np.bincount(row, minlength=n)
    per = lambda x, y: x / np.maximum(y, 1)
    marks = chars - letters - digits - white
    stats = np.stack(
        [np.log1p(chars) / 12, per(letters, chars), per(digits, chars), per(upper, letters), per(white, chars), per(marks, chars), np.minimum(per(marks, count), 3) / 3,
         per(again, chars), np.minimum(per(lengths, count), 20) / 20, np.minimum(per(count, lines), 200) / 200, per(distinct, np.minimum(np.maximum(count, 1), WORDS)), np.log1p(count) / 10],
        axis=1,
    )
    ranges = np.minimum((np.clip(stats, 0, 1) * RANGES).astype(np.int64), RANGES - 1)
    k = np.arange(STATS)
    rows_of = np.repeat(np.arange(n), STATS)
    out = (
        np.concatenate([row, rows_of, rows_of]),
        np.concatenate([bucket, np.tile(WORDS + k, n), (WORDS + STATS + k * RANGES + ranges).ravel()]),
        np.concatenate([tf / norm[row], stats.ravel(), np.full(n * STATS, 0.5)]),
    )
    order = np.argsort(out[0], kind="stable")
    return out[0][order], out[1][order], out[2][order].astype(np.float32)


@dataclass
class Machine:
    bias: float
    weights: np.ndarray
    vectors: np.ndarray
    slope: float = 1.0  # of margins, and what is added to them, for scores that are probabilities
    shift: float = 0.0

    def margins(self, row: np.ndarray, at: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        """Of n rows: bias, weights and all pairs, by the sum-of-squares identity."""
        first = np.searchsorted(row, np.arange(n))
        part = self.vectors[at] * value[:, None]
        sums, squares = np.add.reduceat(part, first), np.add.reduceat(part * part, first)
        return self.bias + np.add.reduceat(self.weights[at] * value, first) + 0.5 * (sums**2 - squares).sum(axis=1)

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        out = []
        for start in range(0, len(texts), 500):
            part = texts[start : start + 500]
            margins = self.slope * self.margins(*inputs(part), len(part)).astype(np.float64) + self.shift
            out.append(1 / (1 + np.exp(-np.clip(margins, -30, 30))))
        return np.concatenate(out).astype(np.float64)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> Machine:
    """Fit by stochastic gradient descent with Adagrad steps on the logistic loss; rows are (inputs, values)."""
    rng = np.random.default_rng(SEED)
    rate = np.clip(labels.mean() if len(labels) else 0.5, 1e-3, 1 - 1e-3)
    m = Machine(float(np.log(rate / (1 - rate))), np.zeros(INPUTS, np.float32), rng.normal(0, 0.01, (INPUTS, RANK)).astype(np.float32))
    seen_w, seen_v, seen_b = np.full(INPUTS, 1e-4, np.float32), np.full((INPUTS, RANK), 1e-4, np.float32), 1e-4
    for _ in range(EPOCHS if len(labels) else 0):
        order = rng.permutation(len(labels))
        for start in range(0, len(order), BATCH):
            chosen = order[start : start + BATCH]
            sizes = [len(rows[i][0]) for i in chosen]
            row = np.repeat(np.arange(len(chosen)), sizes)
            at, value = np.concatenate([rows[i][0] for i in chosen]).astype(np.int64), np.concatenate([rows[i][1] for i in chosen])
            first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            part = m.vectors[at] * value[:, None]
            sums = np.add.reduceat(part, first)
            margin = m.bias + np.add.reduceat(m.weights[at] * value, first) + 0.5 * (sums**2 - np.add.reduceat(part * part, first)).sum(axis=1)
            slope = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[chosen]) / len(chosen)
            each = slope[row] * value
            grad_v = each[:, None] * (sums[row] - part)
            names, back = np.unique(at, return_inverse=True)
            gw = np.bincount(back, weights=each).astype(np.float32) + DECAY * m.weights[names]
            gv = np.stack([np.bincount(back, weights=grad_v[:, f]) for f in range(RANK)], axis=1).astype(np.float32) + DECAY * m.vectors[names]
            gb = float(slope.sum())
            seen_w[names] += gw**2
            seen_v[names] += gv**2
            seen_b += gb**2
            m.weights[names] -= RATE * 5 * gw / np.sqrt(seen_w[names])
            m.vectors[names] -= RATE * gv / np.sqrt(seen_v[names])
            m.bias -= RATE * gb / np.sqrt(seen_b)
    return m


def calibrate(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift that make margins the log odds of label 1: logistic regression by Newton's method, each label taken
    as a little less certain (as if one more row of each were seen). Without both labels margins stay as they are."""
    ones = int(labels.sum())
    if not 0 < ones < len(labels):
        return 1.0, 0.0
    wanted = np.where(labels == 1, (ones + 1) / (ones + 2), 1 / (len(labels) - ones + 2))
    x, w = np.stack([margins.astype(np.float64), np.ones(len(margins))], axis=1), np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (p - wanted) + 1e-6 * (w - [1.0, 0.0]))
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return (float(w[0]), float(w[1])) if w[0] > 0 else (1.0, 0.0)


def learn(labelled: DataFrame, most: int = FIT_ROWS) -> Machine:
    """Fit on at most `most` rows of (doc_id, text, label), those whose ids hash lowest; labels other than 0 and 1 and
    nulls teach nothing. Scores are calibrated by the margins that each row has where its part of FOLDS parts is kept
    from the fit. No rows give a machine that scores 0.5."""

    @F.pandas_udf("inputs array<short>, values array<float>")
    def sparse(texts: pd.Series) -> pd.DataFrame:
        row, at, value = inputs(texts.tolist())
        cut = np.searchsorted(row, np.arange(1, len(texts)))
        return pd.DataFrame({"inputs": np.split(at.astype(np.int16), cut), "values": np.split(value, cut)})

    chosen = labelled.where(F.col("label").isin(0, 1)).orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(most)
    got = chosen.select("doc_id", "label", sparse("text").alias("x")).select("doc_id", "label", "x.*").toPandas()  # at most `most` rows
    got = got.sort_values(["doc_id", "label"], kind="stable")
    rows, labels = list(zip(got["inputs"], got["values"], strict=True)), got["label"].to_numpy(dtype=np.float64)
    machine, margins = fit(rows, labels), np.zeros(len(rows))
    fold = np.zeros(len(rows), dtype=np.int64)
    for label in (0, 1):  # of each label alike
        of = np.flatnonzero(labels == label)
        fold[of] = np.arange(len(of)) % FOLDS
    for k in range(FOLDS if len(np.unique(labels)) == 2 else 0):
        out = np.flatnonzero(fold == k)
        if len(out):
            other, some = fit([rows[i] for i in np.flatnonzero(fold != k)], labels[fold != k]), [rows[i] for i in out]
            of = np.repeat(np.arange(len(some)), [len(x) for x, _ in some])
            margins[out] = other.margins(of, np.concatenate([x for x, _ in some]).astype(np.int64), np.concatenate([v for _, v in some]), len(some))
    machine.slope, machine.shift = calibrate(margins, labels)
    return machine


def score(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        out = []
        for start in range(0, len(texts), 500):
            part = texts[start : start + 500]
            margins = self.slope * self.margins(*inputs(part), len(part)).astype(np.float64) + self.shift
            out.append(1 / (1 + np.exp(-np.clip(margins, -30, 30))))
        return np.concatenate(out).astype(np.float64)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> Machine:
    """Fit by stochastic gradient descent with Adagrad steps on the logistic loss; rows are (inputs, values)."""
    rng = np.random.default_rng(SEED)
    rate = np.clip(labels.mean() if len(labels) else 0.5, 1e-3, 1 - 1e-3)
    m = Machine(float(np.log(rate / (1 - rate))), np.zeros(INPUTS, np.float32), rng.normal(0, 0.01, (INPUTS, RANK)).astype(np.float32))
    seen_w, seen_v, seen_b = np.full(INPUTS, 1e-4, np.float32), np.full((INPUTS, RANK), 1e-4, np.float32), 1e-4
    for _ in range(EPOCHS if len(labels) else 0):
        order = rng.permutation(len(labels))
        for start in range(0, len(order), BATCH):
            chosen = order[start : start + BATCH]
            sizes = [len(rows[i][0]) for i in chosen]
            row = np.repeat(np.arange(len(chosen)), sizes)
            at, value = np.concatenate([rows[i][0] for i in chosen]).astype(np.int64), np.concatenate([rows[i][1] for i in chosen])
            first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            part = m.vectors[at] * value[:, None]
            sums = np.add.reduceat(part, first)
            margin = m.bias + np.add.reduceat(m.weights[at] * value, first) + 0.5 * (sums**2 - np.add.reduceat(part * part, first)).sum(axis=1)
            slope = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[chosen]) / len(chosen)
            each = slope[row] * value
            grad_v = each[:, None] * (sums[row] - part)
            names, back = np.unique(at, return_inverse=True)
            gw = np.bincount(back, weights=each).astype(np.float32) + DECAY * m.weights[names]
            gv = np.stack([np.bincount(back, weights=grad_v[:, f]) for f in range(RANK)], axis=1).astype(np.float32) + DECAY * m.vectors[names]
            gb = float(slope.sum())
            seen_w[names] += gw**2
            seen_v[names] += gv**2
            seen_b += gb**2
            m.weights[names] -= RATE * 5 * gw / np.sqrt(seen_w[names])
            m.vectors[names] -= RATE * gv / np.sqrt(seen_v[names])
            m.bias -= RATE * gb / np.sqrt(seen_b)
    return m


def calibrate(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift that make margins the log odds of label 1: logistic regression by Newton's method, each label taken
    as a little less certain (as if one more row of each were seen). Without both labels margins stay as they are."""
    ones = int(labels.sum())
    if not 0 < ones < len(labels):
        return 1.0, 0.0
    wanted = np.where(labels == 1, (ones + 1) / (ones + 2), 1 / (len(labels) - ones + 2))
    x, w = np.stack([margins.astype(np.float64), np.ones(len(margins))], axis=1), np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (p - wanted) + 1e-6 * (w - [1.0, 0.0]))
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return (float(w[0]), float(w[1])) if w[0] > 0 else (1.0, 0.0)


def learn(labelled: DataFrame, most: int = FIT_ROWS) -> Machine:
    """Fit on at most `most` rows of (doc_id, text, label), those whose ids hash lowest; labels other than 0 and 1 and
    nulls teach nothing. Scores are calibrated by the margins that each row has where its part of FOLDS parts is kept
    from the fit. No rows give a machine that scores 0.5."""

    @F.pandas_udf("inputs array<short>, values array<float>")
    def sparse(texts: pd.Series) -> pd.DataFrame:
        row, at, value = inputs(texts.tolist())
        cut = np.searchsorted(row, np.arange(1, len(texts)))
        return pd.DataFrame({"inputs": np.split(at.astype(np.int16), cut), "values": np.split(value, cut)})

    chosen = labelled.where(F.col("label").isin(0, 1)).orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(most)
    got = chosen.select("doc_id", "label", sparse("text").alias("x")).select("doc_id", "label", "x.*").toPandas()  # at most `most` rows
    got = got.sort_values(["doc_id", "label"], kind="stable")
    rows, labels = list(zip(got["inputs"], got["values"], strict=True)), got["label"].to_numpy(dtype=np.float64)
    kept = np.zeros(len(rows), dtype=bool)
    for label in (0, 1):  # of each label alike
        kept[np.flatnonzero(labels == label)[FOLDS - 1 :: FOLDS]] = True
    machine = fit([r for r, k in zip(rows, kept, strict=True) if not k], labels[~kept])
    if kept.any():
        some = [r for r, k in zip(rows, kept, strict=True) if k]
        of = np.repeat(np.arange(len(some)), [len(x) for x, _ in some])
        margins = machine.margins(of, np.concatenate([x for x, _ in some]).astype(np.int64), np.concatenate([v for _, v in some]), len(some))
        machine.slope, machine.shift = calibrate(margins, labels[kept])
    return machine


def score(docs: DataFrame, machine: Machine, text: str = "text") -> Column:
    """A column of scores from 0 to 1 for the whole text of each row; null texts count as empty."""
    held = docs.sparkSession.sparkContext.broadcast(machine)  # INPUTS x (RANK + 1) numbers

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(held.value.score(texts.tolist()))

    return scored(F.col(text))


def op5_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(part_of("doc_id", 5) != 0).where(F.col("quality").isin(0, 1))
    labels = labels.groupBy("doc_id").agg(F.max("quality").alias("label"))
    few = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS)
    machine = learn(docs.select("doc_id", "text").join(F.broadcast(few), "doc_id"))  # FIT_ROWS rows at most
    return (
        docs.select("doc_id", F.coalesce(part_of("doc_id", 5) == 0, F.lit(False)).alias("held_out"), score(docs, machine).alias("score"))
        .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
    )
