"""Near duplicates against all pairs compared, and texts whose blocks hold few words."""

from collections import defaultdict

import numpy as np
import pytest

from quern.llm import near_dedup
from quern.llm.text import BLOCK, shingles, words


def by_all_pairs(rows: list[tuple[int, str | None]]) -> dict[int, int]:
    """The smallest id of each id's class, from every pair of texts."""
    texts = [t for _, t in rows]
    digests = near_dedup.weighted_shingles(texts)[3]
    sets = list(near_dedup._each_set(texts))
    parent = list(range(len(rows)))

    def find(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if find(i) != find(j) and (digests[i] == digests[j] or near_dedup.similarity(sets[i], sets[j]) >= near_dedup.THRESHOLD):
                parent[find(i)] = find(j)
    least: dict[int, int] = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(doc, least.get(find(i), doc))
    return {doc: least[find(i)] for i, (doc, _) in enumerate(rows)}


def classes(df) -> dict[int, int]:
    return {r["doc_id"]: r["class_id"] for r in near_dedup.classes(df).collect()}


def test_documents_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert classes(docs) == by_all_pairs([tuple(r) for r in docs.collect()])


@pytest.mark.parametrize("again", [1, 3])
def test_a_group_without_its_original(spark, monkeypatch, again):
    # Copies with some words changed: some are linked, some are just out of reach, the text they are copies of is absent.
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 7)
    monkeypatch.setattr(near_dedup, "SPLIT_ROWS", 5)
    rng = np.random.default_rng(4)
    rows = []
    for i in range(60):
        text = [f"w{j}" for j in range(300)]
        for k in rng.choice(300, size=int(rng.integers(2, 9)), replace=False):
            text[k] = f"x{i}y{k}"
        rows.append((i, " ".join([*text, *[f"w{j}" for j in range(100, 100 + 20 * (i % 2))] * again])))
    want = by_all_pairs(rows)
    got = classes(spark.createDataFrame(rows, "doc_id long, text string"))
    # Banding finds a pair only in a shared bucket: classes may be finer, never wrong, and here hardly ever are.
    assert 1 < len(set(want.values())) < 60 and all(want[d] == want[c] for d, c in got.items())
    assert len(set(got.values())) <= len(set(want.values())) + 2


def test_block_links_join_what_all_pairs_join():
    rng = np.random.default_rng(8)
    size = 40
    base = rng.integers(0, 2**63, 50).astype(np.uint64)
    full = []
    for i in range(size):
        kept = base[rng.random(50) < 0.95]
        weight = rng.integers(1, 3, len(kept)).astype(float) if i % 3 else np.ones(len(kept))
        full.append((np.sort(kept), weight))
    n, flat = np.array([len(s) for s, _ in full]), np.array([bool((w == 1).all()) for _, w in full])
    sets = [(s.view(np.int64), w / w.sum()) for s, w in full]
    label = np.arange(size) // 2
    links = near_dedup.block_links(label, n, flat, sets, np.zeros(size, dtype=int), near_dedup.THRESHOLD)
    want = {(i, j) for i in range(size) for j in range(i) if label[i] != label[j] and near_dedup.similarity(full[i], full[j]) >= near_dedup.THRESHOLD}

    def joined(pairs):
        of = list(range(size))
        for a, b in pairs:
            of = [of[b] if x == of[a] else x for x in of]
        return {frozenset(i for i in range(size) if of[i] == x) for x in of}

    assert joined(links) == joined(want)
    sides = np.arange(size) % 2
    over = near_dedup.block_links(label, n, flat, sets, sides, near_dedup.THRESHOLD)
    assert joined(over) == joined({(i, j) for i, j in want if sides[i] != sides[j]})


@pytest.mark.parametrize("texts", [["one two"], ["a", "b c"], [None, "hi there"], [""], [], ["x"], ["a b c d"], ["a b c d e"], ["one two", "w " * (BLOCK // 2)], ["w" * (BLOCK - 10), "one two"], ["w " * (BLOCK // 2 + 1) + "tail"]])
def test_blocks_of_few_words(texts):
    row, _, weight, digests = near_dedup.weighted_shingles(texts)
    assert len(digests) == len(texts) and (weight > 0).all()
    assert set(row.tolist()) == {i for i, t in enumerate(texts) if t and t.strip()}


def test_shingles_are_the_plain_ones():
    parts = ["a b c d e f", "a b", "", "b c d e f g h"]
    word, of = words(parts)
    got, owner = shingles(word, of)
    assert [int((owner == i).sum()) for i in range(4)] == [2, 1, 0, 3]
    assert set(got[owner == 0][1:].tolist()) <= set(got[owner == 3].tolist()) and not set(got[owner == 1].tolist()) & set(got[owner == 0].tolist())


def test_one_row_of_two_words(spark):
    assert classes(spark.createDataFrame([(1, "hello world")], "doc_id long, text string")) == {1: 1}


def test_private_names_do_not_clash(spark):
    df = spark.createDataFrame([(1, "some few words to keep here", "mine", 5, "b"), (1, "some few words to keep here", "mine", 5, "a")], "doc_id long, text string, row string, place int, doc string")
    got = near_dedup.keep_first(df)
    assert got.columns == df.columns and [tuple(r) for r in got.collect()] == [(1, "some few words to keep here", "mine", 5, "a")]
