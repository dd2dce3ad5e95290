"""Near-duplicate documents by ProbMinHash, banding and verification.

Every distinct shingle of five words, weighted by how often it occurs, is a Poisson process whose arrivals fall on
registers at random; a register keeps the shingle that arrives first. Arrivals come in the order of time, and a
shingle is left as soon as it is later than all registers of its document. Two registers agree with the probability
Jaccard similarity of the weighted shingles. Bands of registers give candidate buckets. As plain Jaccard similarity
links as well, a text in which shingles recur has the bands of its shingles with weight 1 beside those; in a text
without, both are the same.

First every member of a bucket is compared with the bucket's leader, the member that shares its buckets with most
texts, and classes are joined over the links. A bucket whose members are one class is done. In the others all members of
different classes that can still be linked are compared, in blocks of bounded size that come together two by two.
Left out before are only texts that cannot have a link to another class: shingles that only texts of one class
have are missing from every text of the others, so with too many of them a text is out of reach. So every two
members of a bucket are compared, out of reach or in one class: no link that would join two classes is
lost, and no bucket is capped. Hot buckets and hot leaders are dealt out in parts by a hash of the member.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import materialise, release, table
from quern.llm.components import components
from quern.llm.text import blocks, fold, mix, shingles, slices, span_hashes, words

SHINGLE, THRESHOLD = 5, 0.8
BANDS, BAND_ROWS = 16, 4
REGISTERS = BANDS * BAND_ROWS
#: Members of a bucket or pairs of a leader that one task takes together.
SPLIT_ROWS = 1000
#: Most texts, and shingles of them, in a block, about; columns of its matrices at a time.
BLOCK_ROWS, BLOCK_SHINGLES, COLUMNS = 1000, 1_000_000, 4096
_STEP = 0x9E3779B97F4A7C15
_NONE = -(2**63)


def weighted_shingles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, weight) of the texts, and a digest of each text's words; the weight is the number of occurrences."""
    rows_of, hashes, digests = [], [], np.zeros(len(texts), dtype=np.uint64)
    for parts, rows, _ in blocks(texts):
        word, of = words([fold(p) for p in parts])
        first = np.searchsorted(of, np.arange(len(parts) + 1))
        whole = span_hashes(word, first[:-1], first[1:])
        for row, digest, n in zip(rows.tolist(), whole, np.diff(first), strict=True):
            if n:
                digests[row] = digest if not digests[row] else mix(digests[row : row + 1] * np.uint64(_STEP) + digest)[0]
        got, owner = shingles(word, of, SHINGLE)
        rows_of.append(rows[owner])
        hashes.append(got)
    row, shingle = np.concatenate(rows_of or [np.zeros(0, np.int64)]), np.concatenate(hashes or [np.zeros(0, np.uint64)])
    _, index, weight = np.unique(shingle ^ mix(row.astype(np.uint64) + np.uint64(1)), return_index=True, return_counts=True)
    for i in np.flatnonzero(digests == 0).tolist():  # no word: the characters themselves
        digests[i] = int.from_bytes(hashlib.blake2b((texts[i] or "").encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
    return row[index], shingle[index], weight.astype(np.float64), digests


def signatures(row: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """The shingle in each register of n texts: (text, register); 0 where a text has no shingle."""
    time, kept = np.full(n * REGISTERS, np.inf), np.zeros(n * REGISTERS, dtype=np.uint64)
    at, arrival = np.zeros(len(row)), 0
    while len(row):
        arrival = (arrival + _STEP) % 2**64
        drawn = mix(shingle + np.uint64(arrival))
        at = at - np.log(((drawn >> np.uint64(11)).astype(np.float64) + 0.5) / 2**53) / weight
        place = row * REGISTERS + (drawn & np.uint64(2047)).astype(np.int64) % REGISTERS
        np.minimum.at(time, place, at)
        won = at == time[place]
        kept[place[won]] = shingle[won]
        alive = at < time.reshape(n, REGISTERS).max(axis=1)[row]
        row, shingle, weight, at = row[alive], shingle[alive], weight[alive], at[alive]
    return kept.reshape(n, REGISTERS)


def bands(kept: np.ndarray) -> np.ndarray:
    """A number for each band of each signature: (text, band)."""
    out = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[None], len(kept), axis=0)
    for j in range(BAND_ROWS):
        out = mix(out * np.uint64(_STEP) + kept.reshape(-1, BANDS, BAND_ROWS)[:, :, j])
    return out.view(np.int64)


def candidates(row: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int) -> list[list[int]]:
    """The distinct bands of each of n texts, weighted and plain; none where a text has no shingle."""
    held = bands(signatures(row, shingle, weight, n)).tolist()
    some, again = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    some[row], again[row[weight > 1]] = True, True
    mine = again[row]
    place = np.cumsum(again) - 1
    plain = bands(signatures(place[row[mine]], shingle[mine], np.ones(mine.sum()), int(again.sum()))).tolist()
    return [list(dict.fromkeys(held[i] + (plain[place[i]] if again[i] else []))) if some[i] else [] for i in range(n)]


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The larger of the probability Jaccard similarity of two weighted sets and the Jaccard similarity of the sets."""
    common, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    plain = len(common) / (len(a[0]) + len(b[0]) - len(common))
    if (a[1] == 1).all() and (b[1] == 1).all():
        return plain
    x, y = a[1][i], b[1][j]
    only_a, only_b = a[1].sum() - x.sum(), b[1].sum() - y.sum()
    ratios, inverse = np.unique(x / y, return_inverse=True)
    totals = np.array([np.maximum(x, y * r).sum() + only_a + only_b * r for r in ratios])
    return max(plain, float((x / totals[inverse]).sum()))


def _sign(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in found:
        for start, end, texts in slices(batch["text"]):
            row, shingle, weight, digests = weighted_shingles(texts)
            of_texts = pa.array(candidates(row, shingle, weight, end - start), pa.list_(pa.int64()))
            columns = [batch["doc"][start:end], batch["raw"][start:end], pa.array(digests.view(np.int64)), of_texts]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "raw", "t", "bands"])


def _each_set(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The shingles of each text in order, and their weights."""
    row, shingle, weight, _ = weighted_shingles(texts)
    order = np.lexsort((shingle, row))
    bounds = np.searchsorted(row[order], np.arange(len(texts) + 1))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        yield shingle[order[a:b]], weight[order[a:b]]


def _with_leader(threshold: float):
    """Links between leaders and the texts that follow them."""

    def links(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, held = None, None
        for batch in found:
            names, leaders = batch["t"].to_pylist(), batch["l"].to_pylist()
            for start, _, texts in slices(batch["text"]):
                pairs = []
                for i, mine in enumerate(_each_set(texts), start):
                    if names[i] == leaders[i]:
                        leader, held = names[i], mine
                    elif leaders[i] == leader and similarity(held, mine) >= threshold:
                        pairs.append((names[i], leader))
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in range(2)], ["a", "b"])

    return links


def _verified(pairs: DataFrame, bodies: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) among the pairs (t, l, part) of texts and leaders; the pairs are a written table, as are the texts (t, text).

    A part of a leader's texts comes to one task, the leader first: it is read once, and no text is held longer than
    its turn.
    """
    members = pairs.join(bodies, "t").select("l", "part", "t", "text")
    leaders = pairs.select("l", "part").distinct().join(bodies.withColumnRenamed("t", "l"), "l").select("l", "part", F.col("l").alias("t"), "text")
    dealt = members.unionByName(leaders).repartition("l", "part").sortWithinPartitions("l", "part", F.col("t") != F.col("l"))
    return dealt.mapInArrow(_with_leader(threshold), "a long, b long")


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (t, label) after more links (a, b): components of the classes that the links join."""
    of = lambda c: labels.select(F.col("t").alias(c), F.col("label").alias(f"of_{c}"))
    between = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    moved = components(between).select(F.col("node").alias("label"), F.col("label").alias("to"))
    old = labels.join(moved, "label", "left").select("t", F.coalesce("to", "label").alias("label"))
    new = moved.join(labels.select(F.col("t").alias("label")), "label", "left_anti").select(F.col("label").alias("t"), F.col("to").alias("label"))
    found = materialise(old.unionByName(new), labels.count())
    release(labels.sparkSession, labels, moved, links)
    return found


def _explode(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingles of each text (t, label), each with its part of the text's weight, the number of all and whether all weights are 1."""
    for batch in found:
        names, labels = (np.array(batch[c].to_pylist(), dtype=np.int64) for c in ("t", "label"))
        for start, end, texts in slices(batch["text"]):
            row, shingle, weight, _ = weighted_shingles(texts)
            n, total = np.bincount(row, minlength=end - start), np.bincount(row, weight, minlength=end - start)
            columns = [names[start:end][row], labels[start:end][row], shingle.view(np.int64), weight / total[row], n[row].astype(np.int32), (total == n)[row]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["t", "label", "shingle", "share", "n", "flat"])


def _in_reach(rows: DataFrame, threshold: float) -> DataFrame:
    """(t, label, n, flat, set) of the texts that can have a link to a text of another class; set has those of the text's n
    shingles that some such text has too, as structs (shingle, share). `rows` is a written table of `_explode`.

    Plain similarity is at most the part of these shingles among all; probability Jaccard similarity at most their part
    of the weight, as it is a sum over shared shingles x of 1 / sum_y max(p_y / p_x, q_y / q_x) <= p_x.
    """
    shared = rows.groupBy("shingle").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least < most").select("shingle")
    sets = rows.join(shared, "shingle").groupBy("t", "label", "n", "flat").agg(F.collect_list(F.struct("shingle", "share")).alias("set"), F.sum("share").alias("all"))
    return sets.where(F.greatest(F.size("set") / F.col("n"), "all") >= threshold - 1e-9).drop("all")


def block_links(label: np.ndarray, n: np.ndarray, flat: np.ndarray, sets: list[tuple[np.ndarray, np.ndarray]], side: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Pairs of texts that join all the classes of a block that links between its two sides join (all its links, if it
    has one side): `sets` has shared shingles and their shares of the weight, n how many shingles a text has in all."""
    size = len(label)
    _, at = np.unique(np.concatenate([s for s, _ in sets]), return_inverse=True)
    share = np.concatenate([w for _, w in sets])
    row = np.repeat(np.arange(size), [len(s) for s, _ in sets])
    weighted = not flat.all()
    common, part = np.zeros((size, size), dtype=np.float32), np.zeros((size, size), dtype=np.float32)
    order = np.argsort(at, kind="stable")
    row, at, share = row[order], at[order], share[order]
    for first in range(0, int(at[-1]) + 1 if len(at) else 0, COLUMNS):
        a, b = np.searchsorted(at, [first, first + COLUMNS])
        has = np.zeros((size, COLUMNS), dtype=np.float32)
        has[row[a:b], at[a:b] - first] = 1
        common += has @ has.T
        if weighted:
            of = np.zeros((size, COLUMNS), dtype=np.float32)
            of[row[a:b], at[a:b] - first] = share[a:b]
            part += of @ has.T
    meant = (label[:, None] != label[None]) & ((side[:, None] != side[None]) | (side == side[0]).all())
    linked = meant & (common >= (threshold - 1e-12) * (n[:, None] + n[None] - common.astype(np.float64)))
    if weighted:
        # With p and q in common of the weights, probability Jaccard similarity is at most p q / (p + q - p q).
        bound = part * part.T >= (threshold - 1e-4) * (part + part.T - part * part.T)
        for i, j in np.argwhere(np.triu(meant & ~linked & bound & ~(flat[:, None] & flat[None]))).tolist():
            linked[i, j] = linked[j, i] = shares_similarity(sets[i], sets[j]) >= threshold - 1e-12
    pairs, seen = [], np.zeros(size, dtype=bool)
    for i in range(size):
        if seen[i]:
            continue
        seen[i], new = True, linked[i] & ~seen
        while new.any():
            seen |= new
            pairs += [(i, j) for j in np.flatnonzero(new).tolist()]
            new = linked[new].any(axis=0) & ~seen
    return pairs


def shares_similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard similarity of two texts, each known by shingles and their shares of its whole weight; a shingle
    that both have must be among them, of the others what is left of 1 is known."""
    common, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    x, y = a[1][i], b[1][j]
    only_a, only_b = max(0.0, 1 - x.sum()), max(0.0, 1 - y.sum())
    ratios, inverse = np.unique(x / y, return_inverse=True)
    totals = np.array([np.maximum(x, y * r).sum() + only_a + only_b * r for r in ratios])
    return float((x / totals[inverse]).sum())


def _in_blocks(threshold: float):
    """Links within the groups (key, low, high) that come one after another."""

    def links(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            t, label, n, flat, side = (np.array(table[c].to_pylist()) for c in ("t", "label", "n", "flat", "side"))
            sets = []
            for chunk in table["set"].chunks:
                for x in chunk:
                    sets.append((x.values.field("shingle").to_numpy(), x.values.field("share").to_numpy()))
            pairs = block_links(label, n, flat, sets, side, threshold) if len(np.unique(label)) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array(t[[p[k] for p in pairs]] if pairs else [], pa.int64()) for k in range(2)], ["a", "b"])

        last = None
        for batch in found:
            keys = [batch[c].to_numpy() for c in ("key", "low", "high")]
            starts = np.flatnonzero(np.any([np.diff(k, prepend=k[:1] - 1) != 0 for k in keys], axis=0)).tolist()
            for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                group = tuple(int(k[a]) for k in keys)
                if group != last and held:
                    yield done()
                    held = []
                last = group
                held.append(batch.slice(a, b - a))
        if held:
            yield done()

    return links


def _part(n: Column | str) -> Column:
    """Which part of SPLIT_ROWS members about of a bucket of n a text t is in."""
    return F.pmod(F.xxhash64("t"), F.ceil(F.col(n) / SPLIT_ROWS)).cast("int").alias("part")


def _all_parts(n: str) -> Column:
    return F.explode(F.sequence(F.lit(0), (F.ceil(F.col(n) / SPLIT_ROWS) - 1).cast("int"))).alias("part")


def _rest(buckets: DataFrame, bodies: DataFrame, threshold: float) -> DataFrame | None:
    """Links (a, b) between members of different classes of the buckets (key, t, n, label), a written table."""
    mixed = buckets.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.max("n").alias("n")).where("least < most")
    mixed = buckets.withColumn("part", _part("n")).join(mixed.select("key", _all_parts("n")), ["key", "part"])
    mixed = materialise(mixed.select("key", "t", "n", "label"), buckets.count())
    if mixed.isEmpty():
        return None
    exploded = materialise(bodies.join(mixed.select("t", "label").distinct(), "t").mapInArrow(_explode, "t long, label long, shingle long, share double, n int, flat boolean"))
    sets = materialise(_in_reach(exploded, threshold))
    near = materialise(mixed.join(sets.select("t", F.size("set").alias("size")), "t"), mixed.count())
    same = [F.bit_xor(F.xxhash64("t", F.lit(k))).alias(f"of{k}") for k in range(2)]
    # Buckets of the same texts are one; blocks are so many that each is of bounded size.
    wide = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_ROWS, F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("blocks")
    live = near.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.max("n").alias("n"), wide, *same).where("least < most")
    live = live.groupBy("of0", "of1").agg(F.min(F.struct("key", "n", "blocks")).alias("b")).select("b.*").select("key", "blocks", _all_parts("n"))
    members = near.withColumn("part", _part("n")).join(live, ["key", "part"]).select("key", "t", "blocks")
    side = F.pmod(F.xxhash64("t", F.lit("block")), F.col("blocks")).cast("int")
    both = members.select("key", "t", side.alias("side"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    both = both.select("key", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"), "side", "t").join(sets, "t")
    dealt = both.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    links = materialise(dealt.mapInArrow(_in_blocks(threshold), "a long, b long").distinct(), mixed.count())
    release(buckets.sparkSession, mixed, exploded, sets, near)
    return links


def _rows(docs: DataFrame, *columns: str) -> DataFrame:
    """Rows with keys that are never null: doc for the id, raw for the text."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NONE)).alias("doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("raw"), *columns)


def _labelled(docs: DataFrame, threshold: float) -> DataFrame:
    """(doc, raw, label, class) of each row: its component and the component's smallest doc."""
    spark = docs.sparkSession
    signed = materialise(_rows(docs, "text").mapInArrow(_sign, "doc long, raw long, t long, bands array<long>"))
    rows = signed.count()
    texts = signed.groupBy("t").agg(F.min(F.struct("doc", "raw")).alias("at"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"))
    texts = materialise(texts.select("t", "at.doc", "at.raw", "copies", "bands"), rows)
    buckets = texts.select("t", F.explode("bands").alias("key"))
    shared = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    found = materialise(buckets.join(shared, "key"), rows * BANDS)
    members = found.count()
    # The leader is the member in the largest buckets: the middle of a group of copies.
    size = found.groupBy("t").agg(F.sum("n").alias("size"))
    active = materialise(found.join(size, "t"), members)
    leaders = active.groupBy("key").agg(F.max(F.struct("size", "t")).alias("l"), F.max("n").alias("n")).select("key", F.col("l.t").alias("l"), _all_parts("n"))
    pairs = active.withColumn("part", _part("n")).join(leaders, ["key", "part"]).where("t <> l")
    # In how many parts a leader's texts come is that of the largest bucket in which each meets it.
    pairs = materialise(pairs.groupBy("t", "l").agg(F.max("n").alias("n")).select("t", "l", _part("n")), members)
    wanted = active.select("t").distinct().join(texts.select("t", "doc", "raw"), "t")
    bodies = materialise(_rows(docs, "text").join(wanted, ["doc", "raw"]).select("t", "text").dropDuplicates(["t"]))
    links = materialise(_verified(pairs, bodies, threshold), members)
    labels = components(links).select(F.col("node").alias("t"), "label")
    open_ = materialise(active.join(labels, "t", "left").select("key", "t", "n", F.coalesce("label", "t").alias("label")), members)
    release(spark, found, active, pairs, links)
    more = _rest(open_, bodies, threshold)
    if more is not None and not more.isEmpty():
        labels = _joined(labels, more)
    named = texts.select("t", "doc", "copies").join(labels, "t", "left").select("t", "doc", "copies", F.coalesce("label", "t").alias("label"))
    named = materialise(named, rows)
    release(spark, texts, bodies, open_, labels)
    first = named.groupBy("label").agg(F.min("doc").alias("class"), F.sum("copies").alias("n")).where("n > 1").select("label", "class")
    first = materialise(first, rows)
    of_text = materialise(named.join(first, "label").select("t", "label", "class"), rows)
    release(spark, named, first)
    # A text may be that of a third of all rows, a label that of as many texts: both joins are of written tables, of
    # which adaptive execution splits the hot parts.
    label = F.coalesce("label", "t").alias("label")
    return signed.select("doc", "raw", "t").join(of_text, "t", "left").select("doc", "raw", label, F.coalesce("class", "doc").alias("class"))


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id) of each row: the class's smallest doc_id, over links of similarity `threshold` or more.

    Texts of equal words are one class. Null texts count as empty; texts without words are alike only if equal; a
    text of fewer than five words is one shingle. Rows that share a doc_id may be in different classes. Null ids are
    kept and come first. Only doc_id and text are read. An empty table gives no rows.
    """
    null = lambda c: F.when(F.col(c) != _NONE, F.col(c))
    return _labelled(docs, threshold).select(null("doc").alias("doc_id"), null("class").alias("class_id"))


def keep_first(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class of `classes`, that of its smallest doc_id, with the columns of `docs`.

    Of rows with that doc_id the one whose text hashes lowest is kept, of those the first by the JSON of the others columns.
    """
    found = _labelled(docs, threshold).where("doc = class").groupBy("label", "doc").agg(F.min("raw").alias("raw"))
    keyed = _rows(docs, F.struct(*docs.columns).alias("row"))
    others = F.to_json(F.struct(*[F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("doc_id", "text")], F.lit(0).alias("-")))
    one = keyed.withColumn("place", F.row_number().over(Window.partitionBy("doc", "raw").orderBy(others))).where("place = 1")
    return one.join(found.select("doc", "raw"), ["doc", "raw"]).select("row.*")


def op2_prob_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))
