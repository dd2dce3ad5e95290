"""Language identification by language-bitmask n-gram filters.

A bit-sliced Bloom filter holds, at each position, a bit for every language: one lookup of an n-gram, ANDed over
its positions, gives the set of all languages that contain it. A text's n-grams are counted per language, the
counts are corrected for the filter's false positives, and the largest decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import materialise, table
from quern.llm.text import blocks, codes, fold, kinds, mix, slices

UNKNOWN = "und"
#: Positions of the filter, a power of 2; positions of each n-gram; languages to a 64-bit slice.
POSITIONS, HASHES, SLICE = 1 << 20, 3, 64
#: A language contains an n-gram that it shows so often, and at this part of the highest rate of any language.
LEAST_COUNT, SHARE = 3, 0.3
#: Bytes of texts that are held as strings while n-grams are counted.
SLICE_CHARS = 2_000_000


def trigrams(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The letter trigrams of each part, a blank at word ends, and the part of each; other characters are blanks."""
    points, at = codes(parts)
    letters = np.where(kinds(points) == 1, points, np.uint32(32)).astype(np.uint64)
    blank = letters == 32
    keep = np.flatnonzero(~blank | ~np.concatenate([[True], blank[:-1]]))
    letters = np.concatenate([np.array([32], dtype=np.uint64), letters[keep]])
    if len(letters) < 3:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    middle = np.flatnonzero(letters[1:-1] != 32)
    grams = (letters[middle] << np.uint64(42)) | (letters[middle + 1] << np.uint64(21)) | letters[middle + 2]
    return grams, np.searchsorted(at, keep[middle], side="right") - 1


def positions(grams: np.ndarray) -> np.ndarray:
    """Where each n-gram is in the filter: HASHES columns."""
    h = mix(grams + np.uint64(1))
    low, high = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return np.stack([((low + np.uint64(j) * high) & np.uint64(POSITIONS - 1)).astype(np.int64) for j in range(HASHES)], axis=1)


@dataclass
class LanguageFilter:
    languages: list[str]
    slices: list[np.ndarray]  # of POSITIONS unsigned 64-bit masks each
    false_rates: np.ndarray  # chance that an n-gram seems to be in each language

    def counts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """For each text, the n-grams found in each language, and all its n-grams."""
        found, total = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for parts, rows, _ in blocks(texts):
            grams, of = trigrams([fold(p) for p in parts])
            at, row = positions(grams), rows[of]
            total += np.bincount(row, minlength=len(texts))
            for s, masks in enumerate(self.slices):
                mask = masks[at[:, 0]]
                for j in range(1, HASHES):
                    mask = mask & masks[at[:, j]]
                for k in range(s * SLICE, min(len(self.languages), (s + 1) * SLICE)):
                    found[:, k] += np.bincount(row[(mask >> np.uint64(k % SLICE)) & np.uint64(1) == 1], minlength=len(texts))
        return found, total

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The language of each text, and the part of its n-grams that the language contains."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        found, total = self.counts(texts)
        true = np.clip((found - total[:, None] * self.false_rates) / np.maximum(1 - self.false_rates, 1e-9), 0, None)
        best = true.argmax(axis=1)
        score = np.clip(true[np.arange(len(texts)), best] / np.maximum(total, 1), 0, 1)
        return [self.languages[b] if n else UNKNOWN for b, n in zip(best, total, strict=True)], score


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each language has each n-gram, in texts (lang, text) without nulls."""
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        langs = np.array(batch["lang"].to_pylist(), dtype=object)
        for start, end, texts in slices(batch["text"], len(langs), SLICE_CHARS):
            names = langs[start:end]
            for name in set(names):
                for parts, _, _ in blocks([texts[i] for i in np.flatnonzero(names == name)]):
                    grams, n = np.unique(trigrams([fold(p) for p in parts])[0], return_counts=True)
                    if name in held:
                        old, m = held[name]
                        grams, inverse = np.unique(np.concatenate([old, grams]), return_inverse=True)
                        n = np.bincount(inverse, weights=np.concatenate([m, n])).astype(np.int64)
                    held[name] = (grams, n)
                    if len(grams) > 1_000_000:
                        yield _counted(name, *held.pop(name))
    for name, (grams, n) in held.items():
        yield _counted(name, grams, n)


def _counted(name: str, grams: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([name] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang") -> LanguageFilter:
    """Learn a filter from texts with their languages; rows where either is null teach nothing.

    N-grams are counted over all rows; what reaches the driver is a row for each language and one for each position
    of the filter, whatever the number of rows. Languages are in alphabetical order, and ties go to the first.
    """

    @F.pandas_udf("array<int>")
    def places(grams: pd.Series) -> pd.Series:
        return pd.Series(list(positions(grams.to_numpy(dtype=np.int64).view(np.uint64)).astype(np.int32)))

    seen = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")).dropna()
    grams = materialise(seen.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    sizes = {r["lang"]: r["n"] for r in grams.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return LanguageFilter([], [], np.zeros(0))
    of = F.create_map(*(F.lit(x) for k, name in enumerate(languages) for x in (name, k)))
    size = F.create_map(*(F.lit(x) for name in languages for x in (name, float(sizes[name]))))
    rate = F.col("n") / size[F.col("lang")]
    contained = (
        grams.withColumn("rate", rate)
        .withColumn("most", F.max("rate").over(Window.partitionBy("gram")))
        .where((F.col("n") >= LEAST_COUNT) & (F.col("rate") >= SHARE * F.col("most")))
        .withColumn("k", of[F.col("lang")])
    )
    bits = (
        contained.withColumn("position", F.explode(places("gram")))
        .groupBy("position", F.floor(F.col("k") / SLICE).alias("slice"))
        .agg(F.bit_or(F.expr(f"shiftleft(1L, k % {SLICE})")).alias("mask"))
    )
    masks = [np.zeros(POSITIONS, dtype=np.uint64) for _ in range(-(-len(languages) // SLICE))]
    got = bits.toPandas()  # at most POSITIONS rows to a slice
    for s, part in got.groupby("slice"):
        masks[int(s)][part["position"].to_numpy()] = part["mask"].to_numpy(dtype=np.int64).view(np.uint64)
    fill = [np.count_nonzero(masks[k // SLICE] & (np.uint64(1) << np.uint64(k % SLICE))) / POSITIONS for k in range(len(languages))]
    return LanguageFilter(languages, masks, np.array(fill) ** HASHES)


def identify(docs: DataFrame, model: LanguageFilter, text: str = "text") -> Column:
    """A column of structs (lang_pred, score) for the whole text of each row of `docs`.

    A text that is null or has no letter is `und` with score 0. A text none of whose n-grams are known gets the first
    language with score 0.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # POSITIONS masks to a slice

    @F.arrow_udf("lang_pred string, score double")
    def predict(texts: pa.Array) -> pa.Array:
        names, scores = [], [np.zeros(0)]
        for _, _, some in slices(texts):
            name, score = held.value.predict(some)
            names += name
            scores.append(score)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate(scores))], ["lang_pred", "score"])

    return predict(F.col(text))


def part_of(column: str, parts: int) -> Column:
    """Rows fall into parts by the CRC-32 of an id as text; a null id has no part."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % parts


def op4_language_bitmask(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.where(part_of("doc_id", 4) != 2))
    return (
        docs.withColumn("__p", identify(docs, model))
        .select("doc_id", F.coalesce(part_of("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "__p.lang_pred", "__p.score")
    )
