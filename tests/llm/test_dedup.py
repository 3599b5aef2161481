import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parapet.llm import exact_dedup, near_dedup, shared

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


def test_exact_groups(spark):
    texts = ["Same", "sAME", "É", "é", None, "", "x", "Ünï", "ünï", "x"] + ["hot"] * 40
    rows = exact_dedup.mark_duplicates(docs_of(spark, texts)).collect()
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(lowered(t), []).append(i)
    assert len(rows) == len(texts)
    for r in rows:
        own = groups[lowered(texts[r["doc_id"]])]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (max(own), len(own), r["doc_id"] == max(own))
        assert r["text_sha256"] == hashlib.sha256(lowered(texts[r["doc_id"]]).encode()).hexdigest()


def test_exact_odd_rows(spark):
    """Null ids, repeated rows, an empty table, and columns named like the operator's own."""
    rows = spark.createDataFrame([(None, "a"), (None, "b"), (1, "A"), (1, "a")], "doc_id long, text string")
    rows = rows.withColumn("hash", F.lit("x")).withColumn("keep_id", F.lit(7)).withColumn("_hash", F.lit(1))
    got = exact_dedup.mark_duplicates(rows).collect()
    assert sorted((r["doc_id"] or 0, r["keep_id"] or 0, r["kept"]) for r in got) == [
        (0, 0, True), (0, 1, False), (1, 1, True), (1, 1, True)]
    kept = exact_dedup.drop_duplicates(rows)
    assert kept.columns == ["doc_id", "text", "hash", "keep_id", "_hash"] and kept.count() == 2
    assert exact_dedup.mark_duplicates(rows.limit(0)).count() == 0


def test_directory_splits_overfull_buckets(spark):
    docs = spark.range(2_000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    index = exact_dedup.build_index(docs, capacity=100)
    sizes = [r["count"] for r in index.entries.groupBy("bucket").count().collect()]
    assert sum(sizes) == 2_000 and max(sizes) <= 100
    # a bucket is a range of the hash
    spans = index.entries.groupBy("bucket").agg(
        F.min(F.shiftrightunsigned("hash", 1)).alias("a"), F.max(F.shiftrightunsigned("hash", 1)).alias("b")
    ).orderBy("a").collect()
    assert all(x["b"] < y["a"] for x, y in zip(spans, spans[1:]))


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return words


def brute_components(texts, words, percent):
    sets = []
    for t in texts:
        w = [x for x in "".join(" " if c in " \t\n\v\f\r" else c for c in lowered(t)).split(" ") if x]
        sets.append({tuple(w[i:i + words]) for i in range(len(w) - words + 1)} if len(w) >= words
                    else ({tuple(w)} if w else set()))
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    return sets, [root(i) for i in range(len(texts))]


@pytest.mark.parametrize("words,percent", [(3, 85), (5, 80)])
def test_near_components_equal_brute_force(spark, words, percent):
    rng = random.Random(words)
    texts = [None, "", " \t\n", "one", "One", "one two", "ONE\x0btwo", "nbsp word a b c", "É a b c", "é a b c"]
    for _ in range(12):  # families whose members are some edits apart, around the threshold
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([12, 40, 120]))]
        texts += [" ".join(edited(rng, base, rng.randrange(0, 5))) for _ in range(rng.choice([2, 6, 14]))]
    chain = [f"w{rng.randrange(10**6)}" for _ in range(60)]  # linked only through one another
    for _ in range(12):
        texts.append(" ".join(chain))
        chain = edited(rng, chain, 1)
    passage = " ".join(f"p{i}" for i in range(40))  # shared, but not enough to link
    texts += [passage + " " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(30)]
    order = list(range(len(texts)))
    rng.shuffle(order)
    texts = [texts[i] for i in order]
    sets, want = brute_components(texts, words, percent)
    rows = docs_of(spark, texts).withColumn("rep", F.lit("clash")).withColumn("key", F.lit(1))
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(rows, near_dedup.Rule(words, percent)).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == dict(enumerate(want))
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(s) for i, s in enumerate(sets)}
    kept = near_dedup.drop_near_duplicates(rows, near_dedup.Rule(words, percent))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({*want})


def test_new_hubs_in_one_large_group(spark, monkeypatch):
    """Hundreds of near copies, many of them apart from the first hub, in small blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    turns = []
    monkeypatch.setattr(near_dedup, "_new_hubs", lambda *a, real=near_dedup._new_hubs: turns.append(a[1]) or real(*a))
    rng = random.Random(6)
    base = [f"w{rng.randrange(10**6)}" for _ in range(90)]
    texts = [" ".join(edited(rng, base, rng.randrange(0, 4))) for _ in range(400)]
    rng.shuffle(texts)
    _, want = brute_components(texts, 5, 80)
    got = near_dedup.near_duplicates(docs_of(spark, texts), near_dedup.Rule(5, 80)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == dict(enumerate(want))
    assert turns and turns == list(range(1, len(turns) + 1))


def test_near_odd_rows(spark):
    rows = spark.createDataFrame([(None, "a b c d"), (1, "a b c d"), (1, "a b c d"), (2, "a b c d")], "doc_id long, text string")
    got = near_dedup.near_duplicates(rows).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in got) == [
        (0, 0, True), (1, 1, True), (1, 1, True), (2, 1, False)]
    assert near_dedup.near_duplicates(rows.limit(0)).count() == 0


def test_registers_estimate_similarity():
    rng = np.random.default_rng(1)
    shared_part, own = rng.integers(0, 2**63, 900).astype(np.uint64), rng.integers(0, 2**63, 100).astype(np.uint64)
    a, b = shared_part, np.concatenate([shared_part[:800], own])
    whole = np.concatenate([a, b])
    sketches = near_dedup.registers(whole, np.array([0, len(a), len(whole)]))
    j = 800 / 1000
    assert abs((sketches[0] == sketches[1]).mean() - j) < 0.12
    union = near_dedup.registers(np.unique(whole), np.array([0, len(np.unique(whole))]))
    assert (np.maximum(sketches[0], sketches[1]) == union[0]).mean() > 0.99  # mergeable
    sizes = np.array([900.0])
    assert near_dedup.may_link(sketches[:1], sketches[1:], sizes, sizes, 80)[0]
    assert not near_dedup.may_link(sketches[:1], near_dedup.registers(own, np.array([0, 100])), sizes, np.array([100.0]), 80)[0]


def test_word_hashes_tell_words_apart():
    texts = pa.array(["ab c", None, "", "x" * 10_000 + " " + "x" * 9_999 + "y", "c ab"])
    (_, _, data, offsets), = shared.chunks(texts)
    blank = np.zeros(256, bool)
    blank[list(shared.BLANKS)] = True
    starts, ends, of = shared.find_words(data, offsets, blank)
    hashes = shared.hash_words(data, starts, ends)
    assert of.tolist() == [0, 0, 3, 3, 4, 4]
    assert hashes[0] == hashes[5] and hashes[1] == hashes[4] and len(set(hashes.tolist())) == 4
