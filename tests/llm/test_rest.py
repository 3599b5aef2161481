import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from parapet.llm import mixing, neighbours
from parapet.llm.queries import QUERIES, SQL
from parapet.llm.shared import WORD_PATTERN

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_targets_by_hand():
    assert mixing.targets({"a": 100, "b": 100, None: 100}) == {
        "a": pytest.approx(200), "b": pytest.approx(250 / 3), None: pytest.approx(500 / 3)}
    # 450 by 3:1:2 gives 225, 75, 150; a stops at 200; 250 by 1:2 gives 83.3, 166.7
    assert mixing.targets({"a": 0, "b": 10}) == {"a": 0, "b": 15}
    assert mixing.targets({}) == {}


def test_permutation_is_one():
    for n in (1, 2, 3, 7, 64, 1000):
        got = mixing._permuted(np.arange(n), np.full(n, n), np.full(n, 99, np.uint64))
        assert sorted(got.tolist()) == list(range(n))
    assert mixing._permuted(np.arange(1000), np.full(1000, 1000), np.full(1000, 5, np.uint64)).tolist() != list(range(1000))


def test_shards_share_out_the_totals():
    totals = np.array([70_000, 1, 30_000, 0])
    slots = 1_000
    shards = -(-int(totals.sum()) // slots)
    seen = np.zeros(4, np.int64)
    for shard in range(shards):
        counts, before = mixing._shard_counts(totals, shard, shards, slots, 3)
        assert (before == seen).all() and counts.sum() == min(slots, totals.sum() - shard * slots)
        seen += counts
    assert (seen == totals).all()


def mix_rows(spark):
    rows = [(i, " ".join(f"w{i}_{k}" for k in range(40 + i % 90)), "en", ["a", "b", "c", None][i % 4 if i % 3 else 0], 1)
            for i in range(600)]
    rows += [(700, None, "en", "a", 0), (701, "  ", "en", "b", 2), (5, "again and again", "en", "c", 3), (5, "again and again", "en", "c", 3),
             (None, "no id at all", None, None, None)]
    return spark.createDataFrame(rows, DOCS)


def test_mix_takes_what_targets_say(spark):
    docs = mix_rows(spark).withColumn("block", F.lit("clash"))
    plan = mixing.mix(docs)
    rows = mixing.taken(plan).collect()
    assert len(rows) == docs.count()
    by = {}
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by[r["source"]] = by.get(r["source"], 0) + r["taken"]
    for x in plan.sources:
        assert by[x["source"]] == pytest.approx(x["target"], rel=0.03)
    again = {(r["doc_id"], r["first"], r["source"]): r["taken"] for r in mixing.taken(mixing.mix(docs.repartition(5))).collect()}
    assert again == {(r["doc_id"], r["first"], r["source"]): r["taken"] for r in rows}
    assert mixing.taken(mixing.mix(docs.limit(0))).count() == 0


def test_mixed_documents_hold_the_words_taken(spark):
    docs = mix_rows(spark).withColumn("_mark", F.lit(1)).withColumn("_k0", F.lit(2))
    plan = mixing.mix(docs)
    mixed = mixing.mixed_documents(docs, plan)
    assert mixed.columns == docs.columns
    words = {}
    for r in mixed.collect():
        n = len(re.findall(WORD_PATTERN, r["text"]))
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + n
        assert r["n_chars"] == len(r["text"])
    want = {}
    for r in mixing.taken(plan).collect():
        want[r["doc_id"]] = want.get(r["doc_id"], 0) + r["taken"]
    assert words == {k: v for k, v in want.items() if v}


def test_neighbours_recall_and_odd_vectors(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(20, 32))
    x = (centres[rng.integers(0, 20, 3000)] + 0.4 * rng.normal(size=(3000, 32))).round(4)
    x[100:130] = x[100]  # copies: equal distances
    rows = [(i, [float(v) for v in x[i]]) for i in range(3000)]
    rows += [(4000, None), (4100, [0.0] * 32), (4200, [1.0, None] + [0.0] * 30), (4300, [float("nan")] * 32),
             (4400, [float("inf")] * 32), (4500, [1.0]), (None, rows[0][1])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("list", F.lit("clash"))
    got = {}
    for r in neighbours.search(vectors, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 3000, 100))
    hits = 0
    for q, own in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(3000), d))[:10]
        own.sort()
        assert [r for r, *_ in own] == list(range(1, 11))
        assert all(s == pytest.approx(d[v], abs=1e-12) for _, v, s in own)
        assert [(s, v) for _, v, s in own] == sorted((s, v) for _, v, s in own)
        hits += len({v for _, v, _ in own} & set(best.tolist()))
    assert hits >= 0.95 * 10 * len(got)
    assert [v for _, v, _ in got[100]] == list(range(101, 111))
    few = neighbours.search(vectors.where("vec_id < 4"), F.lit(True)).collect()
    assert len(few) == 4 * 3
    assert neighbours.search(vectors.limit(0), F.lit(True)).count() == 0


def test_pipeline_on_a_small_table(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(400):
        words = [f"w{rng.integers(0, 3000)}" for _ in range(60)]
        bad = i % 8 == 0
        rows.append((i, " ".join(words + ["scum"] * bad), "en", f"s{i % 3}", 1))
        labels.append((i, 1, int(bad)))
    rows += [(400, rows[1][1].upper(), "en", "s0", 1), (401, rows[2][1] + " extra", "en", "s1", 1), (402, None, None, None, None), (403, "", "", "", 0)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        seen.append(docs)
    ids = [{r["doc_id"] for r in d.collect()} for d in seen]
    assert ids[0] == {i for i in range(404) if i >= 400 or i % 8}
    assert 1 not in ids[1] and 400 in ids[1] and len(ids[1] & {402, 403}) == 1
    assert 401 not in ids[2] and 2 in ids[2]
    assert seen[3].columns == seen[2].columns
    assert {"doc_id", "sequence_id", "length"} <= set(seen[4].columns)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == seen[4].count()


def test_registered():
    assert [n for n in QUERIES if n.startswith("op")] and {f"op{k}" for k in range(1, 11)} == {
        n.split("_")[0] for n in QUERIES if n.startswith("op")}
    assert "pipeline" in QUERIES and set(SQL) <= set(QUERIES)


def test_neighbours_gives_k_rows_with_few_probes(spark, monkeypatch):
    """Where many true neighbours are outside of the probed lists, and where rows of the
    query's own id fill the nearest ones."""
    monkeypatch.setattr(neighbours, "TARGET", 0.3)
    x = np.random.default_rng(5).normal(size=(1_200, 12))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(7, (x[7] + 1e-3 * j).tolist()) for j in range(700)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    one = F.col("embedding")[0].isin([float(v[0]) for v in x[:40]])
    got = {}
    for r in neighbours.search(vectors, one).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["score"]))
    assert len(got) == 40
    for own in got.values():
        assert [r for r, _ in sorted(own)] == list(range(1, 11))
        assert [s for _, s in sorted(own)] == sorted(s for _, s in own)
