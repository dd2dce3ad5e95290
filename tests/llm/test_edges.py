"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm import ball_tree, language, lsh, mixing, near_dedup, packing, quality, sharding, substring, warc
from quern.llm.tokens import default_tokenizer

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LINE = "the quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak tree near the quiet river bank at dawn every single day of summer"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (1, f"{LINE}\nA first text.", "en", "a", 10), (2, f"Other words before.\n{LINE}", "en", "a", 10), (3, None, "en", "a", None), (4, "", None, None, 0),
        (5, "12 34 !!", "en", "b", 8), (6, "Same text here and there.", "en", "b", 25), (7, "Same text here and there.", "fr", "b", 25), (7, "Same text here and there.", "fr", "b", 25),
        (None, "A text without an id.", "en", "b", 21), (9, "été " * 60_000, "fr", None, 240_000), (10, "x" * 300_000, "de", "c", 300_000),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def clashing(docs):
    names = ("shard", "slot", "length", "rank", "t", "key", "label", "tokens", "rate", "copies", "posterior", "removed_spans", "__key", "doc", "raw", "score", "class")
    return docs.withColumns({n: F.lit("mine") for n in names if n not in docs.columns})


def test_sharding(docs, clashing):
    rows = sharding.shard_documents(clashing).collect()
    assert len(rows) == 11
    by = {(r["doc_id"], r["size"]): r for r in rows}
    assert by[(3, 1)]["text_crc32"] == 0 and by[(4, 1)]["size"] == 1
    for shard in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in rows)))
    assert all(r["grown_shard"] in (r["shard"], 16) for r in rows)
    assert len({r["shard"] for r in rows if r["doc_id"] == 7}) == 1 and sharding.shard_documents(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        sharding.assign(docs, "doc_id", 0)


def test_jump_moves_only_into_the_new_shard():
    keys = np.random.default_rng(1).integers(0, 2**63, 20_000).astype(np.uint64)
    for n in (1, 2, 16, 99):
        a, b = sharding.jump(keys.copy(), n), sharding.jump(keys.copy(), n + 1)
        assert ((a == b) | (b == n)).all() and abs((a != b).mean() - 1 / (n + 1)) < 0.02
        assert np.bincount(a, minlength=n).std() < 0.1 * len(keys) / n + 40


def test_packing(docs, clashing):
    rows = packing.pack_documents(clashing).collect()
    assert {(r["doc_id"], r["length"]) for r in rows if r["doc_id"] in (3, 4)} == {(3, 1), (4, 1)}
    used: dict[int, list] = {}
    for r in rows:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert sum(r["doc_id"] == 7 for r in rows) == 2 and packing.pack_documents(docs.limit(0)).count() == 0
    assert max(r["piece"] for r in rows if r["doc_id"] == 9) >= 1


@pytest.mark.parametrize("lengths", [[], [4096], [1] * 5000, [2049] * 7, [1365] * 9, list(range(1, 4097, 7)) * 3])
def test_plan_places_all_and_wastes_little(lengths):
    counts = dict(zip(*(x.tolist() for x in np.unique(np.array(lengths, dtype=int), return_counts=True)), strict=True)) if lengths else {}
    runs = packing.plan(counts)
    fill: dict[int, int] = {}
    for r in runs.itertuples():
        for k in range(r.n):
            fill[r.sequence + k // r.per] = fill.get(r.sequence + k // r.per, 0) + r.length
    assert sum(fill.values()) == sum(lengths) and max(fill.values(), default=0) <= packing.CAPACITY
    best = max(-(-sum(lengths) // packing.CAPACITY), sum(x > packing.CAPACITY // 2 for x in lengths))
    assert len(fill) <= best * 1.03 + 1


def test_token_ids_are_the_tokenizers(docs):
    from tokenizers import Tokenizer

    from quern.llm.tokens import WordEncoder

    plain, fast = Tokenizer.from_file(default_tokenizer()), WordEncoder(default_tokenizer())
    for text in ("", " ", "It's  Foo, bar!!.\n\tb.a 12x y \x1cq é İ ΣΑΣ. 한국어, 日本。", LINE * 20, "a" * 3000, "​ , . ,,", "don't we'll 'tis"):
        assert np.frombuffer(fast(text), dtype="<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def test_words_are_encoded_once(monkeypatch):
    from tokenizers import Tokenizer

    from quern.llm import tokens

    class Counted:
        def __init__(self, held):
            self.held, self.words = held, []

        def encode_batch_fast(self, texts, **options):
            self.words += [w for t in texts for w in t.split(" ")]
            return self.held.encode_batch_fast(texts, **options)

    plain, fast = Tokenizer.from_file(default_tokenizer()), tokens.WordEncoder(default_tokenizer())
    words: list[str] = []
    for name in {"tokenizer", "folded"} & set(vars(fast)):
        counted = Counted(getattr(fast, name))
        counted.words = words
        setattr(fast, name, counted)
    # Case and any marks after a word make no new word.
    text = " ".join(w + m for w in ("house", "House", "HOUSE", "größe", "Größe", "дом", "Дом") for m in ("", ".", "***", ".%%%", ",", "!?", ")"))
    assert np.frombuffer(fast(text), dtype="<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
    assert sorted(words) == sorted(["house", "größe", "дом", ".", "***", ".%%%", ",", "!?", ")"])
    # Words met again and again stay held when the cache is full.
    monkeypatch.setattr(tokens, "CACHE_WORDS", 100)
    for n in range(400):
        fast("often met " + "".join(chr(97 + int(d)) for d in str(n)))
    assert words.count("often") == words.count("met") == 1 and len(fast.cache) < 200


def test_token_ids_of_many_texts_and_letters():
    from tokenizers import Tokenizer

    from quern.llm import tokens

    plain, fast = Tokenizer.from_file(default_tokenizer()), tokens.WordEncoder(default_tokenizer())
    letters = [f"{c}a{c}{m} a{c}" for c in map(chr, (*range(1, 0x590), *range(0x1E00, 0x2100))) for m in ("", "*'", "\u0308.", "(_")]
    texts = [None, "", *letters, "a <|endoftext|>. b<|endoftext|>", *("A̧ͅ", "T̈ ẗ", "İ", "x\u00a0y"), "", " \n "]
    assert [np.frombuffer(x, dtype="<u4").tolist() for x in fast.many(texts)] == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert fast.many([]) == []
    # A text of more than a block, among others.
    long = "Some words, in a row. " * (tokens.BLOCK // 22 + 5)
    assert [len(x) for x in fast.many(["one", long, "two"])] == [4, 4 * 7 * (tokens.BLOCK // 22 + 5), 4]


def test_language(docs, clashing):
    model = language.learn(docs)
    assert model.languages == ["de", "en", "fr"]
    got = {(r["doc_id"], r["text"]): r["p"] for r in clashing.withColumn("p", language.identify(clashing, model)).select("doc_id", F.substring("text", 1, 5).alias("text"), "p").collect()}
    assert got[(3, None)]["lang_pred"] == "und" and got[(4, "")]["lang_pred"] == "und" and got[(5, "12 34")]["lang_pred"] == "und"
    assert all(0 <= p["score"] <= 1 for p in got.values()) and got[(10, "xxxxx")]["lang_pred"] == "de"
    assert language.learn(docs.limit(0)).languages == [] and docs.limit(0).select(language.identify(docs, model)).count() == 0
    assert language.LanguageFilter([], [], np.zeros(0)).predict(["abc", None])[0] == ["und", "und"]


def test_language_filter_has_every_gram(spark):
    model = language.learn(spark.createDataFrame([("abcd " * 5, "x"), ("wxyz " * 5, "y")], "text string, lang string"))
    found, total = model.counts(["abcd abcd", "wxyz"])
    assert found[0, 0] == total[0] and found[1, 1] == total[1] and found[0, 1] == 0


def test_quality(docs, clashing):
    machine = quality.learn(docs.select("doc_id", "text").withColumn("label", (F.col("doc_id") % 2).cast("int")))
    rows = clashing.withColumn("p", quality.score(clashing, machine)).select("p").collect()
    assert len(rows) == 11 and all(0 <= r["p"] <= 1 for r in rows)
    empty = quality.learn(docs.limit(0).withColumn("label", F.lit(1)))
    assert empty.score(["", None, LINE]) == pytest.approx([0.5] * 3, abs=0.05) and quality.score(docs, empty) is not None


def test_quality_held_out(spark):
    rows = quality.op5_factorisation_machine(spark, "/root/testdata/sf0.01").where("held_out").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").collect()
    good, poor = ([r for r in rows if r["quality"] == q] for q in (1, 0))
    assert len(good) > 20 and len(poor) > 3
    assert np.mean([a["score"] > b["score"] for a in good for b in poor]) > 0.95
    assert np.mean([r["predicted"] == 1 for r in good]) > 0.9 and np.mean([r["predicted"] == 0 for r in poor]) > 0.7


def test_calibration():
    rng = np.random.default_rng(6)
    margins = rng.normal(size=4000) * 2
    labels = (rng.random(4000) < 1 / (1 + np.exp(-(3 * margins - 1)))).astype(float)
    assert quality.calibrate(margins, labels) == pytest.approx((3, -1), abs=0.3)
    assert quality.calibrate(margins, np.ones(4000)) == (1.0, 0.0) and quality.calibrate(-margins, (margins > 0).astype(float)) == (1.0, 0.0)
    slope, shift = quality.calibrate(np.array([1.0, 2.0, 3.0, 4.0]), np.array([0.0, 0.0, 1.0, 1.0]))
    assert slope > 0 and 2 < -shift / slope < 3


def test_language_held_out(spark):
    rows = language.op4_language_bitmask(spark, "/root/testdata/sf0.01").where("held_out").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) > 100 and np.mean([r["lang_pred"] == r["lang"] for r in rows]) > 0.98


def test_jump_is_the_plain_loop():
    def plain(key: int, buckets: int) -> int:
        b, j = -1, 0
        while j < buckets:
            b = j
            key = (key * 2862933555777941757 + 1) % 2**64
            j = int((b + 1) * (2**31 / ((key >> 33) + 1)))
        return b

    keys = np.random.default_rng(2).integers(0, 2**64, 500, dtype=np.uint64)
    for n in (1, 2, 16, 1000):
        assert sharding.jump(keys.copy(), n).tolist() == [plain(int(k), n) for k in keys]


def test_sum_of_squares_identity():
    rng = np.random.default_rng(3)
    m = quality.Machine(0.3, rng.normal(size=quality.INPUTS).astype(np.float32), rng.normal(size=(quality.INPUTS, quality.RANK)).astype(np.float32))
    row, at, value = quality.inputs([LINE])
    pairs = sum(float(value[i] * value[j] * (m.vectors[at[i]].astype(float) @ m.vectors[at[j]])) for i in range(len(at)) for j in range(i + 1, len(at)))
    assert m.margins(row, at, value, 1)[0] == pytest.approx(0.3 + float(m.weights[at] @ value) + pairs, rel=1e-3)


def test_near_dedup(docs, clashing):
    got = sorted((str(r["doc_id"]), str(r["class_id"])) for r in near_dedup.classes(clashing).collect())
    assert got.count(("7", "6")) == 2 and ("3", "3") in got and ("4", "3") in got and ("None", "None") in got and len(got) == 11
    kept = near_dedup.keep_first(clashing)
    assert kept.columns == clashing.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "3", "5", "6", "None", "9", "10"])  # 26 of 32 shingles of 1 and 2 are the same
    assert near_dedup.classes(docs.limit(0)).count() == 0 and near_dedup.keep_first(docs.limit(0)).count() == 0


def test_plain_similarity_of_texts_that_differ_in_repeats(spark):
    rows = []
    for i in range(8):
        text = " ".join(f"w{i}x{j}" for j in range(500))
        line = " ".join(f"w{i}x{j}" for j in range(10, 24))
        rows += [(2 * i, text), (2 * i + 1, "\n".join([text, *[line] * 100]))]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: d - d % 2 for d, _ in rows}


def test_repeated_ids_with_other_texts(spark):
    df = spark.createDataFrame([(5, LINE), (5, "Nothing of the sort, something else entirely."), (5, LINE), (3, LINE)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["text"][:3]) for r in near_dedup.keep_first(df).collect()) == [(3, "the"), (5, "Not")]


def test_substring(docs, clashing):
    rows = {r["doc_id"]: r for r in substring.dedup(clashing).where("doc_id is not null").collect()}
    assert rows[2]["text"] == "Other words before.\n" and rows[1]["removed_spans"] == [] and rows[1]["text"].startswith("the quick")
    span = rows[2]["removed_spans"][0]
    assert (span["start"], span["end"]) == (20, 20 + len(LINE))
    assert rows[3]["text"] is None and rows[4]["text"] == "" and rows[5]["text"] == "12 34 !!" and rows[6]["text"] == "Same text here and there."
    assert substring.dedup(clashing).count() == 11 and substring.dedup(docs.limit(0)).count() == 0
    assert {r["__key"] for r in substring.dedup(clashing).collect()} == {"mine"} and {r["raw"] for r in substring.dedup(clashing).collect()} == {"mine"}


def test_passage_inside_a_line(spark):
    passage = "Zebra one two three four five six. Seven eight nine ten eleven twelve. " * 5
    df = spark.createDataFrame([(1, f"alpha beta {passage}gamma delta"), (2, f"some other words come first {passage}and then more of them")], "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in substring.dedup(df).collect()}
    assert "Zebra" not in out[2] and out[2].startswith("some other words") and out[1].count("Zebra") == 1


def test_whole_lines_that_recur(spark):
    line = "Home, about us, contact and terms of use"
    df = spark.createDataFrame([(i, f"Story {i} begins here alone.\n{line}\nStory {i} ends. Yes") for i in range(3)] + [(9, f"Inside a {line} of another line\nYes")], "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in substring.dedup(df).collect()}
    assert line in out[0] and [out[i] for i in (1, 2)] == [f"Story {i} begins here alone.\nStory {i} ends. Yes" for i in (1, 2)]
    assert line in out[9] and out[9].endswith("Yes")


@pytest.mark.parametrize("n", [30, 55])
def test_passages_without_sentences(spark, n):
    fresh = iter(range(10**6))
    words = lambda k: " ".join(f"word{next(fresh)}" for _ in range(k))
    passage = words(n)
    rows = [(1, f"{words(40)} {passage} {words(40)}"), (2, f"{words(23)} {passage} {words(31)}"), (3, f"{words(20)} {passage[: passage.index(' ')]} {words(20)}")]
    rows += [(4, f"{words(25)} {(twice := words(n))} {words(9)} {twice} {words(25)}")]
    out = {r["doc_id"]: r["text"] for r in substring.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1] == rows[0][1] and out[2] == rows[1][1].replace(f"{passage} ", "") and out[3] == rows[2][1]
    start, end = rows[3][1].index(twice), rows[3][1].rindex(twice)
    assert start != end and out[4] == rows[3][1][:end] + rows[3][1][end + len(twice) + 1 :]


def test_lines_against_a_plain_loop(spark):
    """Whole lines alone: the first document that has a line keeps its first occurrence, all others go."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows, seen, want = sorted(tuple(r) for r in docs.collect()), {}, {}
    for doc, text in rows:
        kept, here = [], set()
        for line in text.split("\n"):
            words = tuple("".join(c.lower() if c.isalnum() else " " for c in line).split())
            if len(words) >= substring.LINE_WORDS and (words in here or seen.setdefault(words, doc) != doc):
                continue
            here.add(words)
            kept.append(words)
        want[doc] = [w for line in kept for w in line]
    got = {r["doc_id"]: "".join(c.lower() if c.isalnum() else " " for c in r["text"]).split() for r in substring.dedup(docs, least=10**9).collect()}
    assert got == want


def test_flags_reach_only_their_text(spark):
    own = "one quiet lake lies under a grey sky while many birds fly over the hills and nobody in the small village by the road knows where they will land tonight or tomorrow morning"
    df = spark.createDataFrame([(1, LINE), (2, f"{LINE}"), (2, own)], "doc_id long, text string")
    assert sorted(r["text"] for r in substring.dedup(df).collect()) == sorted([LINE, "", own])


def test_mixing(docs, clashing):
    labels = docs.select("doc_id", F.when(F.col("doc_id") < 6, "good").otherwise("poor").alias("domain"))
    mixed = mixing.mix(clashing, labels, {"good": 0.5, "poor": 0.5}).collect()
    assert len(mixed) == 11 and all(r["rate"] >= 0 and r["copies"] >= 0 and abs(sum(r["posterior"]) - 1) < 1e-9 for r in mixed)
    assert mixing.mix(docs.limit(0), labels, {"good": 0.5, "poor": 0.5}).count() == 0
    assert all(abs(p - 0.5) < 1e-6 for r in mixing.mix(docs, labels.limit(0), {"good": 1, "poor": 1}).collect() for p in r["posterior"])


@pytest.mark.parametrize("shares", [(0.6, 0.3, 0.1), (0.98, 0.01, 0.01), (0.02, 0.02, 0.96), (1 / 3, 1 / 3, 1 / 3)])
def test_rates_are_projected_least_squares(spark, shares):
    rng = np.random.default_rng(5)
    p, t = rng.dirichlet((0.2, 0.2, 0.2), 300), rng.integers(1, 500, 300)
    rows = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(t, p, strict=True)], "tokens long, posterior array<double>")
    targets = np.array(shares) * t.sum()
    got, reached = mixing.fit_rates(rows, list(targets))
    assert reached == pytest.approx(targets.tolist(), rel=1e-3)
    held = [(np.array(r["posterior"]) * r["tokens"] * r["rate"], r["rate"]) for r in got.collect()]
    assert sum(x for x, _ in held).tolist() == pytest.approx(reached, rel=1e-9) and min(r for _, r in held) >= 0


def test_rates_that_cannot_meet_targets(spark):
    # Both documents are half and half: the least squares of (90 - x)^2 / 90^2 + (10 - x)^2 / 10^2 lie between.
    rows = spark.createDataFrame([(50, [0.5, 0.5]), (50, [0.5, 0.5])], "tokens long, posterior array<double>")
    got, reached = mixing.fit_rates(rows, [90.0, 10.0])
    assert reached[0] == pytest.approx(reached[1]) and 5 <= reached[0] <= 95 and all(r["rate"] >= 0 for r in got.collect())
    got, reached = mixing.fit_rates(rows, [0.0, 0.0])
    assert reached == pytest.approx([0, 0], abs=1e-3)
    assert mixing.fit_rates(rows.limit(0), [1.0, 1.0])[1] == [0, 0]


def test_targets_are_met_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = mixing.label_domains(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    rows = mixing.mix(docs, labels, mixing.TARGETS).select("tokens", "posterior", "rate").collect()
    total, reached = sum(r["tokens"] for r in rows), np.sum([np.array(r["posterior"]) * r["tokens"] * r["rate"] for r in rows], axis=0)
    assert (reached / total).tolist() == pytest.approx([mixing.TARGETS[d] for d in sorted(mixing.TARGETS)], rel=1e-3)


def test_posteriors_are_naive_bayes(spark):
    """The posteriors against the plain formula in Python."""
    rows = [(i, t) for i, t in enumerate(["one fine day", "YOU ARE A MORON", "buy $$$ now!!", "", None, "moron moron day"])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = mixing.DomainModel(["a", "b"], [math.log(0.7), math.log(0.3)], [["day", "fine"], ["moron"]], [[[math.log(0.1 + 0.01 * i + 0.02 * k), math.log(0.2 + 0.03 * i)] for i in range(mixing.RANGES)] for k in range(4)])
    for r in mixing.posteriors(df, model).collect():
        text = r["text"] or ""
        words = set(filter(None, "".join(c if c.isalnum() else " " for c in text.lower()).split()))
        shares = [sum(c in s for c in text) / max(len(text), 1) for s in (mixing._CAPITALS, mixing._SYMBOLS)]
        at = [min(int(x * 2 * mixing.RANGES), mixing.RANGES - 1) for x in shares] + [len(words & set(x)) for x in model.lexicons]
        score = [model.prior[d] + (sum(model.ranges[k][i][d] for k, i in enumerate(at)) if words else 0) for d in range(2)]
        want = np.exp(score) / np.exp(score).sum()
        assert r["posterior"] == pytest.approx(want.tolist(), rel=1e-9), text


VECTORS = "vec_id long, embedding array<float>"


def test_ball_tree(spark):
    rows = [(0, [0.5, -0.25]), (50, [0.5, -0.25]), (3, None), (4, [None, 1.0]), (5, [math.nan, 0.0]), (6, [math.inf, 0.0]), (7, [0.0, 0.0]), (8, [1.0]), (9, [0.5, -0.25]), (9, [0.5, -0.25]), (100, [])]
    df = spark.createDataFrame(rows, VECTORS).withColumn("rank", F.lit("mine")).withColumn("shard", F.lit(1))
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ball_tree.top_k(df, df.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect()]
    assert got[:5] == [(0, 1, 8, 32768), (0, 2, 9, 20480), (0, 3, 9, 20480), (0, 4, 50, 20480), (0, 5, 7, 0)]
    assert {q for q, *_ in got} == {0, 50} and ball_tree.top_k(df.limit(0), df).count() == 0 and ball_tree.top_k(df, df.limit(0)).count() == 0


def test_ball_tree_is_exact(monkeypatch):
    rng = np.random.default_rng(9)
    points = np.floor(256 * rng.normal(size=(700, 8)))
    points[100:160] = points[0]
    ids = rng.permutation(700)
    queries = points[:40]
    got: dict[int, list] = {}
    for own, other, score in ball_tree.search(points, ids, queries, ids[:40], np.full(40, -np.inf), 5):
        got.setdefault(own, []).append((-score, other))
    for q, own in zip(queries, ids[:40].tolist(), strict=True):
        best = sorted((-int(s), int(i)) for s, i in zip(points @ q, ids, strict=True) if i != own)[:5]
        assert sorted(got[own]) == best
    big = np.array([[2.0**40, 1.0]])
    assert ball_tree.exact(big, np.array([[2.0**20, 3.0]]))[0, 0] == 2**60 + 3


def test_lsh(spark):
    rows = [(0, [0.6, 0.8]), (20, [0.6, 0.8]), (3, None), (4, [None, 1.0]), (5, [math.nan, 0.0]), (7, [0.0, 0.0]), (8, [3.0, 0.0]), (9, [0.6, 0.8]), (10, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, VECTORS).withColumn("score", F.lit("mine"))
    got = [(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 5)) for r in lsh.search(df, df.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect()]
    assert got[:4] == [(0, 1, 8, 1.8), (0, 2, 9, 1.0), (0, 3, 20, 1.0), (0, 4, 10, -0.6)] and len(got) == 8
    assert lsh.search(df.limit(0), df).count() == 0 and lsh.search(df, df.limit(0)).count() == 0


def test_empty_vectors_take_no_part(spark):
    df = spark.createDataFrame([(0, []), (20, []), (100, [1.0, 2.0]), (3, []), (4, [2.0, 1.0]), (5, [1.0])], VECTORS)
    asked = df.where("vec_id % 20 = 0")
    for found in (lsh.search(df, asked), ball_tree.top_k(df, asked)):
        assert [(r["query_id"], r["rank"], r["vec_id"]) for r in found.orderBy("rank").collect()] == [(100, 1, 4), (100, 2, 5)]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_lsh_repeated_rows_and_one_id_with_two_vectors(spark, kind):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (7, [0.5, 0.5]), (8, [0.25, 0.0])] + [(9, [0.75, 0.0])] * 3 + [(8, [0.0, 1.0]), (11, [])]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    asks = df.where("vec_id = 0")
    got = lambda k: [(r["rank"], r["vec_id"], r["score"]) for r in lsh.search(df, asks, k=k).orderBy("rank").collect()]
    assert got(20) == [(1, 9, 0.75), (2, 9, 0.75), (3, 9, 0.75), (4, 7, 0.5), (5, 8, 0.25), (6, 8, 0.0)]
    assert got(2) == [(1, 9, 0.75), (2, 9, 0.75)]


def test_lsh_probes_come_in_order():
    places = np.random.default_rng(2).normal(size=(50, 6)) * 3
    steps = lsh.sequence(6, 60)
    assert len({tuple(s) for s in steps.tolist()}) == 60 and steps[0].sum() == 0
    assert lsh.probes(places, 60).shape == (50, 60) and (lsh.probes(places, 60)[:, 0] == lsh.bucket(np.floor(places))).all()
    assert all(len(set(r)) == 60 for r in lsh.probes(places, 60).tolist())


def test_lsh_recall(spark):
    v = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = {r["vec_id"]: np.array(r["embedding"], dtype=float) for r in v.collect()}
    ids = np.array(sorted(rows))
    m = np.stack([rows[i] for i in ids])
    got: dict[int, set] = {}
    for r in lsh.search(v, v.where("vec_id % 20 = 0")).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hit = [len(got[q] & {int(i) for i in ids[np.argsort(-(m @ rows[q]))] if i != q}.intersection([int(i) for i in ids[np.argsort(-(m @ rows[q]))] if i != q][:20])) / 20 for q in got]
    assert np.mean(hit) >= 0.9


RECORDS = "record_id long, url string, captured_at long, kind string, etag string, last_modified string, digest string, headers map<string,string>, body string, canonical string"


def test_warc(spark):
    rows = [
        (1, "http://www.A.com:80/x/?b=2&a=1#f", 10, "response", "e1", None, None, {"date": "d1", "content-type": "t"}, "one", "mine"),
        (2, "https://a.com/x?a=1&b=2&utm_source=q", 20, "revisit", "e1", None, None, {"date": "d2", "content-type": "z"}, None, "mine"),
        (3, "http://a.com/x?a=1&b=2", 30, "response", "e2", "m", None, None, "two", "mine"), (4, "http://a.com/x?a=1&b=2", 40, "revisit", "e1", None, None, None, None, "mine"),
        (5, "http://a.com/x?a=1&b=2", 5, "revisit", "e1", None, None, None, None, "mine"), (6, None, 50, "revisit", "e1", None, None, None, None, "mine"),
        (7, "http://a.com/x?a=1&b=2", 30, "revisit", None, "m", None, {"etag": "new"}, None, "mine"), (8, "nonsense", 1, "request", None, None, None, None, None, "mine"),
        (9, "http://a.com/x?a=1&b=2", 60, "revisit", None, None, None, None, None, "mine"), (2, "https://a.com/x?a=1&b=2&utm_source=q", 20, "revisit", "e1", None, None, {"date": "d2", "content-type": "z"}, None, "mine"),
    ]
    df = spark.createDataFrame(rows, RECORDS)
    got = [r for r in warc.resolve(df).orderBy("record_id").collect()]
    assert len(got) == 10
    by = {r["record_id"]: r for r in got}
    assert by[1]["canonical"] == "a.com/x?a=1&b=2" and by[1]["outcome"] == "response"
    assert (by[2]["outcome"], by[2]["source_id"], by[2]["body"], by[2]["headers"]) == ("resolved", 1, "one", {"date": "d2", "content-type": "t"})
    assert (by[4]["outcome"], by[4]["source_id"], by[4]["body"]) == ("mismatch", 3, None) and by[5]["outcome"] == "orphan" and by[6]["outcome"] == "orphan"
    assert (by[7]["outcome"], by[7]["source_id"]) == ("resolved", 3) and by[8]["outcome"] == "request" and by[9]["outcome"] == "mismatch"
    assert warc.resolve(df.limit(0)).count() == 0


def test_warc_empty_and_very_long_bodies(spark):
    long = "été " * 100_000
    rows = [(1, "http://a.com/e", 1, "response", "e", None, None, {}, "", None), (2, "http://a.com/e", 2, "revisit", "e", None, None, None, None, None)]
    rows += [(3, "http://a.com/l", 1, "response", "l", None, None, {}, long, None), (4, "http://a.com/l", 2, "revisit", "l", None, None, None, None, None)]
    rows += [(5, "http://a.com/n", 1, "response", "n", None, None, {}, None, None), (6, "http://a.com/n", 2, "revisit", "n", None, None, None, None, None)]
    by = {r["record_id"]: r for r in warc.resolve(spark.createDataFrame(rows, RECORDS)).collect()}
    assert [by[k]["outcome"] for k in (2, 4, 6)] == ["resolved"] * 3
    assert [by[k]["body"] for k in (2, 4, 6)] == ["", long, None]


def test_warc_slices_of_a_hot_url(spark, monkeypatch):
    rows = [(i, "http://a.com/", i, "response" if i % 5 == 0 else "revisit", str(i // 5), None, None, None, str(i), "") for i in range(400)]
    df = spark.createDataFrame(rows, RECORDS)
    monkeypatch.setattr(warc, "SLICES", (1,))
    whole = sorted(map(str, warc.resolve(df).collect()))
    monkeypatch.setattr(warc, "SLICES", (23,))
    assert sorted(map(str, warc.resolve(df).collect())) == whole
    assert warc.resolve(df).where("outcome = 'resolved'").count() == 320


@pytest.mark.parametrize("times", [lambda i: 7, lambda i: i if i < 200 else 5 * 10**9 + i])
def test_warc_slices_of_equal_and_far_times(spark, monkeypatch, times):
    monkeypatch.setattr(warc, "SLICES", (9,))
    rows = [(i, "http://a.com/", times(i), "response" if i % 50 == 0 else "revisit", "e", None, None, None, str(i), "") for i in range(400)]
    got = {r["record_id"]: (r["outcome"], r["source_id"]) for r in warc.resolve(spark.createDataFrame(rows, RECORDS)).collect()}
    assert got == {i: ("response", None) if i % 50 == 0 else ("resolved", i // 50 * 50) for i in range(400)}


def test_warc_records_that_share_an_id(spark):
    body = "b" * 300_000
    rows = [(1, "http://a.com/", 1, "response", "e", None, None, None, body, ""), (1, "http://b.com/", 1, "response", "f", None, None, None, "", ""), (2, "http://a.com/", 5, "revisit", "e", None, None, None, None, ""), (2, "http://b.com/", 9, "revisit", "e", None, None, None, None, "")]
    got = {(r["canonical"], r["record_id"]): (r["outcome"], r["body"]) for r in warc.resolve(spark.createDataFrame(rows, RECORDS)).collect()}
    assert got[("a.com/", 2)] == ("resolved", body) and got[("b.com/", 2)] == ("mismatch", None) and got[("b.com/", 1)] == ("response", "")


def test_pipeline_rejects_unknown_languages(spark):
    rows = [(i, LINE, "en") for i in range(4)] + [(8, "ждщ фыв ъэюя жжщщ", None), (9, LINE, None)]
    kept = corpus_pipeline.keep_known_languages(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 2, 3, 9]


def test_pipeline_stages_keep_the_columns(spark, docs):
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert docs.where("doc_id in (3, 4, 5)").count() == 0 and docs.where("doc_id in (6, 7)").count() == 1


def test_pipeline_stages_take_edge_rows_and_none(spark, docs):
    """Nulls, empty and long texts and repeated rows go through the last two stages; no rows go through all of them."""
    data = "/root/testdata/sf0.001"
    stages = dict(corpus_pipeline.STAGES)
    mixed = stages["mixing"](spark, docs, data)
    assert mixed.columns == docs.columns and mixed.count() >= 1
    packed = stages["packing"](spark, docs, data).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in docs.select("doc_id").distinct().collect()}
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, data).count() == 0
