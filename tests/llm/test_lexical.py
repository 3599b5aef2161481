import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks.compare import compare, connect
from parapet.llm import lexical
from parapet.llm.queries import QUERIES, SQL

DOCS = "doc_id long, text string, lang string"


def terms(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute(docs, items, k=10):
    """item, rank, doc, score by the contract, over all documents."""
    bags = [(i, terms(t)) for i, t in docs]
    n_docs, n_terms = sum(bool(b) for _, b in bags), sum(len(b) for _, b in bags)
    out = []
    for item, text in items:
        found = []
        weights = {}
        for t in set(terms(text)):
            df = sum(t in b for _, b in bags)
            weights[t] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
        for doc, bag in bags:
            if bag:
                m = 100 - 90 + (90 * len(bag) * n_docs) // n_terms
                score = sum(w * ((10**9 * bag.count(t)) // (1000 * bag.count(t) + 8 * m)) for t, w in weights.items() if t in bag)
                if score > 0:
                    found.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, f[3], -f[0]) for rank, f in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def ours(spark, docs, items, parts=3, **sizes):
    limits = {k: sizes.pop(k) for k in ("shards_a_task", "query_bytes", "k") if k in sizes}
    table = spark.createDataFrame([(i, t, "en") for i, t in docs], DOCS).withColumn("term", F.lit(1)).withColumn("shard", F.lit("x"))
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit(0)).withColumn("doc_id", F.lit(0))
    got = lexical.search(lexical.build_index(table.repartition(parts), **sizes), asked, **limits).collect()
    return sorted((tuple(r) for r in got), key=str)


def corpus(n, seed=3):
    pick = random.Random(seed)
    words = [f"w{i}" for i in range(150)] + ["É", "naïve", "x9", "中文"]
    weight = [1 / (i + 1) for i in range(len(words))]
    return [(i, " ".join(pick.choices(words, weight, k=pick.randint(1, 60)))) for i in range(n)]


@pytest.mark.parametrize("sizes", [{}, {"shard_docs": 7}, {"shard_bytes": 600, "shards_a_task": 1}, {"query_bytes": 40}], ids=str)
def test_equals_brute_force(spark, sizes):
    docs = corpus(700)
    items = [(1, "w0 w1 w2 w40"), (2, "W149, w0!"), (3, "naïve É 中文 w3"), (4, "none here"), (5, "w5"), (6, "w0"),
             (7, " ".join(f"w{i}" for i in range(60)))]
    assert ours(spark, docs, items, **sizes) == brute(docs, items)


def test_odd_rows_and_ties(spark):
    docs = [(None, "alpha beta"), (3, "alpha beta"), (1, "Alpha-BETA"), (1, "alpha beta"), (2, None), (5, ""), (6, " .,- "),
            (-4, "alpha beta"), (9, "gamma " * 5)] + [(100 + i, "tie tie") for i in range(30)] + [(7, "long " * 300_000 + "gamma")]
    items = [(1, "alpha"), (1, "alpha"), (2, None), (3, ""), (None, "tie"), (4, "gamma long"), (5, "alpha gamma tie beta")]
    assert ours(spark, docs, items) == brute(docs, items)
    assert ours(spark, docs, items, shard_docs=3, k=2) == brute(docs, items, 2)


def test_empty_tables(spark):
    assert ours(spark, [], [(1, "a")]) == []
    assert ours(spark, [(1, "a")], []) == []
    assert ours(spark, [(1, None), (2, "?")], [(1, "a")]) == []


def test_words_that_share_a_hash(monkeypatch):
    data = np.frombuffer(b"ab cd ab ef", np.uint8)
    starts, ends = np.array([0, 3, 6, 9]), np.array([2, 5, 8, 11])
    number, found = lexical._term_numbers(data, starts, ends)
    assert number[0] == number[2] and len(found) == 3
    monkeypatch.setattr(lexical, "hash_words", lambda d, s, e: np.zeros(len(s), np.uint64))
    number, found = lexical._term_numbers(data, starts, ends)
    assert number.tolist() == [0, 1, 0, 2] and found == [b"ab", b"cd", b"ef"]


def shard_of(docs):
    import pyarrow as pa

    data = [t.encode() for _, t in docs]
    offsets = np.r_[0, np.cumsum([len(d) for d in data])]
    rows = []
    for batch in lexical._shard(5, pa.array([i for i, _ in docs], pa.int64()), np.frombuffer(b"".join(data), np.uint8), offsets):
        rows += batch.to_pylist()
    return rows


def test_bounds_hold_and_blocks_stay_packed():
    # rare strong terms decide; the common list is asked for few documents
    docs = [(i, "common " * (1 + i % 5) + ("rare " * 3 if i % 400 == 0 else "") + "filler " * (i % 11)) for i in range(6000)]
    rows = shard_of(docs)
    lengths = [len(terms(t)) for _, t in docs]
    counts = lexical.Counts(6000, sum(lengths))
    seen = dict.fromkeys(("blocks", "unpacked", "skipped", "candidates"), 0)
    ids, known, lists = lexical._open_shard(rows, counts, seen)
    for own in lists.values():
        top = own.block_most.copy()
        doc, impact = own.all()
        # a block's bound is its largest impact, exactly
        assert (np.maximum.reduceat(impact, own.starts) == top).all()
        assert (np.diff(doc) > 0).all()
    seen = dict.fromkeys(("blocks", "unpacked", "skipped", "candidates"), 0)
    ids, known, lists = lexical._open_shard(rows, counts, seen)
    best = lexical.Best(10)
    df = {t: own.docs for t, own in lists.items()}
    query = [(lists[t], counts.weight(df[t])) for t in ("rare", "common")]
    lexical.search_shard(query, best, ids, known, seen)
    got = sorted((-s, d) for s, _, d in [(x[0], x[1], -x[2]) for x in best.heap])
    want = [(-r[3], r[2]) for r in sorted(brute(docs, [(1, "rare common")]), key=lambda r: r[1])]
    assert got == want
    assert seen["candidates"] < 100 and seen["unpacked"] < seen["blocks"] / 2
    # a list that can't reach the tenth score isn't opened at all
    again = dict(seen)
    lexical.search_shard([(lists["filler"], 1)], best, ids, known, seen)
    assert seen["skipped"] == again["skipped"] + 1 and seen["unpacked"] == again["unpacked"]


def test_large_counts_stay_whole():
    counts = lexical.Counts(10**11, 10**14)
    n = np.array([10**9, 5], np.int64)
    assert counts.norms(n).tolist() == [10 + 90 * 10**9 * 10**11 // 10**14, 10 + 90 * 5 * 10**11 // 10**14]


def test_query_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    good, note = compare(spark, connect(folder), "op11_lexical", folder, QUERIES, SQL)
    assert good, note
