"""Substring dedup by hashing the lines of all documents, cut further into sentences.

Units are normalised (words alone, lower case) and hashed; digests are grouped over all documents, the first
document by id keeps its first occurrence, and every other occurrence is a repeat. Runs of repeats in a row that
reach a number of words are removed; the original offsets of what is removed are kept. A passage that begins or
ends inside a line leaves no equal line behind, so lines are cut at sentence ends and where a capital letter follows
a word without one; the run, not the unit, decides, so short units that recur by chance stay. Whole lines are a kind of their own: every
later occurrence of a line goes, whatever its surroundings, if the line has LINE_WORDS words.

Passages that begin and end inside units are found by anchors: of any WINDOW runs of ANCHOR_WORDS words in a row, the
one of least hash is an anchor, wherever it is. So a passage of RUN_WORDS words has the same anchors in both
documents, they touch one another, and fewer than WINDOW words lie before the first and after the last. Where a row of
anchors ends, words are compared one by one with those of the kept occurrence, and the passage goes on as far as they
are equal. Words of units and of passages count together for RUN_WORDS.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import materialise, release, table
from quern.llm.text import blocks, codes, fold, kinds, mix, slices, span_hashes

#: Words that a run of repeated units must have to be removed.
RUN_WORDS = 30
#: Words that a whole line must have to be removed where it recurs: shorter ones are headings and items of lists.
LINE_WORDS = 4
#: Words of an anchor, and runs of so many words of which the one of least hash is an anchor.
ANCHOR_WORDS = WINDOW = 15
KINDS = UNIT, LINE, ANCHOR = 0, 1, 2
WITHIN = 3
_LINE_END = re.compile("\n")
_STOPS = np.array([ord(c) for c in ".!?…。！？"], dtype=np.uint32)
_BLANKS = np.array([ord(c) for c in " \t\n\r"], dtype=np.uint32)


def split(texts: list[str | None]) -> tuple[np.ndarray, ...]:
    """The words of the texts in order: (row, start, end, hash, whether a unit begins, whether a line begins).

    A word's span goes on to the next word; the spans cover a text without gaps. A text without words has none.
    """
    held = []
    for parts, rows, offsets in blocks(texts, _LINE_END):
        points, at = codes(parts)
        low, _ = codes([fold(p) for p in parts])
        inside = np.concatenate([[0], (kinds(points) > 0).astype(np.int8)])
        change = np.diff(inside)
        starts, ends = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
        if not len(starts):
            continue
        of = np.searchsorted(at, starts, side="right") - 1
        blank = np.isin(points, _BLANKS)
        stop = np.isin(points, _STOPS) & np.append(blank[1:], True)
        stops = np.concatenate([[0], np.cumsum(stop | (points == 10))])
        breaks = np.concatenate([[0], np.cumsum(points == 10)])
        capital = points[starts] != low[starts]
        line = np.ones(len(starts), dtype=bool)
        line[1:] = (of[1:] != of[:-1]) | (breaks[starts[1:]] > breaks[ends[:-1]])
        first = line.copy()
        first[1:] |= (stops[starts[1:]] > stops[ends[:-1]]) | (capital[1:] & ~capital[:-1])
        lead = np.diff(of, prepend=-1) > 0  # the first word of its part
        limits = np.array([len(p) for p in parts])
        left = np.where(lead, 0, starts - at[of])
        right = np.append(left[1:], 0)
        last = np.append(lead[1:], True)
        right[last] = limits[of[last]]
        held.append((rows[of], left + offsets[of], right + offsets[of], span_hashes(low, starts, ends), first, line))
    if not held:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, np.zeros(0, dtype=np.uint64), none > 0, none > 0
    return tuple(np.concatenate(x) for x in zip(*held, strict=True))


def pieces(row: np.ndarray, word: np.ndarray, first: np.ndarray, line: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """For each of the KINDS, (row, first word, end, digest) of the pieces; digests of two kinds are never equal."""
    found = []
    for kind, begins in enumerate((first, line)):
        begin = np.flatnonzero(begins)
        end = np.append(begin[1:], len(row))
        if kind == LINE:
            long = end - begin >= LINE_WORDS
            begin, end = begin[long], end[long]
        found.append((row[begin], begin, end, mix(span_hashes(word, begin, end) + np.uint64(kind))))
    begin = np.arange(max(0, len(row) - ANCHOR_WORDS + 1))
    digest = mix(span_hashes(word, begin, begin + ANCHOR_WORDS) + np.uint64(ANCHOR))
    picked = np.zeros(len(begin), dtype=bool)
    n = len(begin) - WINDOW + 1
    if n > 0:
        least = digest[:n].copy()
        for k in range(1, WINDOW):
            np.minimum(least, digest[k : k + n], out=least)
        whole = row[:n] == row[WINDOW + ANCHOR_WORDS - 2 :]
        for k in range(WINDOW):
            picked[k : k + n] |= whole & (digest[k : k + n] == least)
    begin = begin[picked]
    found.append((row[begin], begin, begin + ANCHOR_WORDS, digest[picked]))
    return found


def first_places(row: np.ndarray, digest: np.ndarray) -> np.ndarray:
    """For each piece, the index of the first of that digest in the same row."""
    order = np.lexsort((np.arange(len(row)), digest, row))
    r, d = row[order], digest[order]
    fresh = np.ones(len(row), dtype=bool)
    fresh[1:] = (r[1:] != r[:-1]) | (d[1:] != d[:-1])
    out = np.zeros(len(row), dtype=np.int64)
    out[order] = order[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]] if len(row) else order
    return out


def _hash_units(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces of each text, each once; and a row of kind WITHIN for a text in which some piece recurs."""
    for batch in found:
        docs, raws = (np.array(batch[c].to_pylist(), dtype=np.int64) for c in ("doc", "raw"))
        for start, end, texts in slices(batch["text"]):
            row, _, _, word, first, line = split(texts)
            base, recurs = np.searchsorted(row, np.arange(end - start)), np.zeros(end - start, dtype=bool)
            held = []
            for kind, (of, begin, _, digest) in enumerate(pieces(row, word, first, line)):
                again = first_places(of, digest) != np.arange(len(of))
                recurs[of[again]] = True
                of, at, digest = of[~again], (begin - base[of])[~again], digest[~again]
                held.append((digest.view(np.int64), of, np.full(len(of), kind, dtype=np.int8), at.astype(np.int32)))
            of = np.flatnonzero(recurs)
            held.append((np.zeros(len(of), dtype=np.int64), of, np.full(len(of), WITHIN, dtype=np.int8), np.zeros(len(of), dtype=np.int32)))
            digest, of, kind, at = (np.concatenate(x) for x in zip(*held, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (digest, docs[start:end][of], raws[start:end][of], kind, at)], ["digest", "doc", "raw", "kind", "at"])


def _contexts(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words before each anchor, the nearest first, and those after it, as far as a passage can go on."""
    for batch in found:
        docs, raws, wanted = (batch[c].to_pylist() for c in ("doc", "raw", "ats"))
        for start, end, texts in slices(batch["text"]):
            row, _, _, word, _, _ = split(texts)
            base = np.searchsorted(row, np.arange(end - start + 1))
            held = []
            for i in range(end - start):
                mine = word[base[i] : base[i + 1]].view(np.int64)
                held += [(docs[start + i], raws[start + i], at, *around(mine, at)) for at in wanted[start + i]]
            yield pa.RecordBatch.from_arrays([pa.array([h[k] for h in held], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32(), *[pa.list_(pa.int64())] * 2))], ["s", "t", "at", "before", "after"])


def around(words: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray]:
    return words[max(0, at - WINDOW + 1) : at][::-1], words[at + ANCHOR_WORDS : at + ANCHOR_WORDS + WINDOW - 1]


def common(a: np.ndarray, b: np.ndarray) -> int:
    """How many words are equal from the start on."""
    n = min(len(a), len(b))
    other = np.flatnonzero(a[:n] != b[:n])
    return int(other[0]) if len(other) else n


def cut(texts: list[str | None], flagged: list[list[np.ndarray]], edges: list[list[dict]], least: int) -> list[tuple[str | None, list[dict]]]:
    """Each text without its repeated lines and its runs of repeated words, and the spans removed; `flagged` has, for each
    text and each of the KINDS, the first words of the pieces that an earlier document has, `edges` what is around the
    kept occurrences of anchors."""
    row, left, right, word, first, line = split(texts)
    words, base = word.view(np.int64), np.searchsorted(row, np.arange(len(texts) + 1))
    ends = [(base[i], base[i + 1]) for i in range(len(texts))]
    marks, bad = [], []
    for kind in KINDS:
        sizes = [len(f[kind]) for f in flagged]
        marks.append(np.concatenate([f[kind] for f in flagged] or [np.zeros(0, np.int64)]).astype(np.int64) + np.repeat(base[:-1], sizes))
    for at, (of, begin, end, digest) in zip(marks, pieces(row, word, first, line), strict=True):
        known = np.zeros(len(row) + 1, dtype=bool)
        known[at] = True
        place = first_places(of, digest)
        within = place != np.arange(len(of))
        again = within | known[begin]
        bad.append(np.cumsum(np.bincount(begin[again], minlength=len(row) + 1) - np.bincount(end[again], minlength=len(row) + 1))[:-1] > 0)
    repeated = bad[UNIT] | bad[ANCHOR]

    def extend(i: int, at: int, before: np.ndarray, after: np.ndarray) -> None:
        """Passages go on around the anchor at a word of text i as far as its words are those around the kept occurrence."""
        a, b = ends[i]
        mine, other = around(words[a:b], at - a)
        repeated[at - common(mine, before) : at] = True
        repeated[at + ANCHOR_WORDS : at + ANCHOR_WORDS + common(other, after)] = True

    # The anchors are the last of the pieces; those that a text itself has earlier are compared with that place.
    for k in np.flatnonzero(within).tolist():
        i = int(of[k])
        extend(i, int(begin[k]), *around(words[ends[i][0] : ends[i][1]], int(begin[place[k]] - ends[i][0])))
    for i, some in enumerate(edges):
        for e in some:
            extend(i, int(ends[i][0]) + e["at"], *(np.asarray(e[c], dtype=np.int64) for c in ("before", "after")))
    gone = bad[LINE]
    for a, b in runs(repeated, row):
        if b - a >= least:
            gone[a:b] = True
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    for a, b in runs(gone, row):
        spans[row[a]].append((int(left[a]), int(right[b - 1])))
    out = []
    for text, mine in zip(texts, spans, strict=True):
        kept, at = [], 0
        for start, end in mine:
            kept.append(text[at:start])
            at = end
        out.append(("".join([*kept, text[at:]]) if mine else text, [{"start": s, "end": e} for s, e in mine]))
    return out


def runs(mask: np.ndarray, row: np.ndarray) -> list[tuple[int, int]]:
    """Start and end of each run of true values within a row."""
    if not len(mask):
        return []
    fresh = np.concatenate([[True], row[1:] != row[:-1]])
    starts = np.flatnonzero(mask & (fresh | ~np.concatenate([[False], mask[:-1]])))
    ends = np.flatnonzero(mask & np.append(fresh[1:] | ~mask[1:], True)) + 1
    return list(zip(starts.tolist(), ends.tolist(), strict=True))


def dedup(docs: DataFrame, least: int = RUN_WORDS) -> DataFrame:
    """Replace `text` by what is left of it and add removed_spans, the spans removed as offsets in the original.

    Null texts stay null, texts without words stay as they are. Rows of one doc_id count as one document when
    occurrences are ranked, and a piece is cut only from the rows whose text has it; null ids rank first. Other columns are kept; one named removed_spans is replaced.
    Digests have 64 bits. An empty table gives no rows.
    """
    spark, columns = docs.sparkSession, [c for c in docs.columns if c != "removed_spans"]
    # A row is known by its id and its text: rows of one id may have different texts.
    doc, raw = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc"), F.xxhash64("text").alias("raw")
    keyed = docs.select(doc, raw, "text")
    found = materialise(keyed.mapInArrow(_hash_units, "digest long, doc long, raw long, kind byte, at int"))
    anchor = F.col("kind") == ANCHOR
    parted = found.where(F.col("kind") != WITHIN)
    shared = parted.groupBy("digest").agg(F.min("doc").alias("s"), F.max("doc").alias("last")).where("s < last")
    shared = materialise(shared.select("digest", "s"))
    # A digest may be in a third of all documents: both sides are written tables, so that adaptive execution, which must
    # be on, splits the join there.
    later = parted.join(shared, "digest").where((F.col("doc") > F.col("s")) | anchor).select("digest", "doc", "raw", "kind", "at", "s")
    met = materialise(later.unionByName(found.where(F.col("kind") == WITHIN).withColumn("s", F.lit(None).cast("long"))))
    later = met.where(F.col("s").isNull() | (F.col("doc") > F.col("s")))
    pieces_of = F.array(*(F.collect_list(F.when(F.col("kind") == k, F.col("at"))) for k in KINDS))
    flags = later.groupBy("doc", "raw").agg(pieces_of.alias("pieces"))

    # Anchors with no other anchor touching them on one side, and what is around their kept occurrences.
    of_row = Window.partitionBy("doc", "raw").orderBy("at")
    touching = (F.col("at") - F.lag("at").over(of_row) <= ANCHOR_WORDS) & (F.lead("at").over(of_row) - F.col("at") <= ANCHOR_WORDS)
    ends = later.where(anchor).withColumn("inner", F.coalesce(touching, F.lit(False))).where("not inner")
    places = met.where(anchor & (F.col("doc") == F.col("s"))).groupBy("digest").agg(F.min(F.struct("raw", "at")).alias("place"))
    ends = ends.select("doc", "raw", F.col("at").alias("here"), "s", "digest").join(places, "digest")
    ends = materialise(ends.select("doc", "raw", "here", "s", F.col("place.raw").alias("t"), F.col("place.at").alias("at")))
    wanted = ends.groupBy("s", "t").agg(F.collect_set("at").alias("ats"))
    sources = keyed.join(wanted, (F.col("doc") == F.col("s")) & (F.col("raw") == F.col("t"))).select("doc", "raw", "text", "ats")
    contexts = materialise(sources.mapInArrow(_contexts, "s long, t long, at int, before array<long>, after array<long>").dropDuplicates(["s", "t", "at"]))
    edge = F.struct(F.col("here").alias("at"), "before", "after")
    edges = ends.join(contexts, ["s", "t", "at"]).groupBy("doc", "raw").agg(F.collect_list(edge).alias("edges"))
    flags = materialise(flags.join(edges, ["doc", "raw"], "left").select("doc", "raw", F.struct("pieces", "edges").alias("found")))
    release(spark, found, shared, met, ends, contexts)

    @F.arrow_udf("text string, removed_spans array<struct<start: long, end: long>>")
    def remove(texts: pa.Array, found: pa.Array) -> pa.Array:
        # A text in which nothing recurs, here or elsewhere, is not looked at again.
        some = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
        new: list[str | None] = []
        spans: list[list[dict]] = [[] for _ in range(len(texts))]
        for start, end, mine in slices(texts.take(pa.array(some))):
            flags = found.take(pa.array(some[start:end])).to_pylist()
            at = [[np.asarray(x, dtype=np.int64) for x in f["pieces"]] for f in flags]
            for i, (text, removed) in zip(some[start:end].tolist(), cut(mine, at, [f["edges"] or [] for f in flags], least), strict=True):
                new.append(text)
                spans[i] = removed
        mask = np.zeros(len(texts), dtype=bool)
        mask[some] = True
        kept = pc.replace_with_mask(texts, pa.array(mask), pa.array(new, texts.type))
        return pa.StructArray.from_arrays([kept, pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], ["text", "removed_spans"])

    keyed = docs.select(F.struct(*columns).alias("row"), doc, raw)
    out = keyed.join(flags, ["doc", "raw"], "left").select("row", remove(F.col("row.text"), F.col("found")).alias("out"))
    kept = [F.col("out.text").alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in columns]
    return out.select(*kept, F.col("out.removed_spans").alias("removed_spans"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = F.col("removed_spans")
    return dedup(docs).select(
        "doc_id", "text", "removed_spans",
        F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("removed_chars"),
    )
