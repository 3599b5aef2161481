import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from checks.compare import compare, connect
from parapet.llm import merkle
from parapet.llm.queries import QUERIES, SQL

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, lower=False):
    text = row["text"]
    if lower and text is not None:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def up(nodes):
    """Root of a list of digests, and for each of them the siblings on its way."""
    ways, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for i, place in enumerate(at):
            run = level[place // 8 * 8:place // 8 * 8 + 8]
            ways[i].append((run[:place % 8], run[place % 8 + 1:]))
        level = [h(*level[a:a + 8]) for a in range(0, len(level), 8)]
        at = [place // 8 for place in at]
    return level[0], ways


def brute(rows):
    """The contract's columns, by lists."""
    groups = {}
    for row in rows:
        groups.setdefault(row["lang"], []).append(row)
    names = sorted(groups, key=lambda n: (n is not None, (n or "").encode()))
    out, roots, parts = [], [], []
    for name in names:
        own = sorted(groups[name], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        root, ways = up([leaf(r) for r in own])
        roots.append(root)
        parts.append((own, ways))
    if not names:
        return []
    root, tops = up(roots)
    for (own, ways), subroot, top in zip(parts, roots, tops):
        for row, way in zip(own, ways):
            tampered = row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 3 == 0
            folded = leaf(row, tampered)
            for before, after in way + top:
                folded = h(*before, folded, *after)
            proof = h(*[d for before, after in way + top for d in before + after])
            out.append((row["doc_id"], leaf(row), subroot, root, proof, folded, folded == root))
    return sorted(out, key=str)


def ours(spark, rows, tmp_path):
    docs = spark.createDataFrame(rows, DOCS) if isinstance(rows, list) else rows
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op12_manifest"](spark, str(tmp_path)).collect()
    return sorted((tuple(r) for r in got), key=str)


def rows_of(sizes):
    out = []
    for lang, n in sizes.items():
        out += [(len(out) + i * 7, f"Text {i} of {lang}", lang, "s" if i % 3 else None, i) for i in range(n)]
    return out


@pytest.mark.parametrize("sizes", [
    {}, {"a": 1}, {"a": 8}, {"a": 9}, {None: 3, "b": 65, "é": 1, "Z": 2},
    {f"l{i}": 1 + i % 3 for i in range(20)}, {"hot": 600, "b": 1},
], ids=str)
def test_small_trees(spark, sizes, tmp_path):
    rows = rows_of(sizes)
    keys = ("doc_id", "text", "lang", "source", "n_chars")
    assert ours(spark, rows, tmp_path) == brute([dict(zip(keys, r)) for r in rows])


def test_odd_rows(spark, tmp_path):
    rows = [
        (None, None, None, None, None), (None, "x", None, None, None), (1, "", "en", "", 0), (1, None, "en", None, None),
        (1, "Twice", "en", "s", 5), (1, "Twice", "en", "s", 5), (2, "É" * 700_000 + "A", "en", "ß", -3), (-5, "1:x-", "en", "-", 1),
    ] + [(10, "same", "fr", "s", 4)] * 20
    keys = ("doc_id", "text", "lang", "source", "n_chars")
    want = brute([dict(zip(keys, r)) for r in rows])
    docs = spark.createDataFrame(rows, DOCS)
    assert ours(spark, docs, tmp_path / "a") == want
    clash = docs.selectExpr("*", "1 AS tree", "'x' AS steps", "2 AS leaf", "3 AS lo", "4 AS _at")
    assert ours(spark, clash.repartition(5), tmp_path / "b") == want


def test_more_partitions_and_a_shuffled_join(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(merkle, "BROADCAST_RUNS", 0)
    rows = rows_of({"a": 300, None: 40, "b": 9})
    keys = ("doc_id", "text", "lang", "source", "n_chars")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert ours(spark, rows, tmp_path) == brute([dict(zip(keys, r)) for r in rows])
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_a_changed_row_is_found(spark):
    docs = spark.createDataFrame(rows_of({"a": 30, "b": 5}), DOCS)
    made = merkle.manifest(merkle.leaves(docs))
    again = merkle.manifest(merkle.leaves(docs.withColumn(
        "text", F.when(F.col("doc_id") == 7, "other").otherwise(F.col("text")))))
    assert made.root == merkle.manifest(merkle.leaves(docs.repartition(7))).root != again.root
    before = {r["doc_id"]: r["leaf"] for r in made.rows.collect()}
    assert [r["doc_id"] for r in again.rows.collect() if before[r["doc_id"]] != r["leaf"]] == [7]


def test_query_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    good, note = compare(spark, connect(folder), "op12_manifest", folder, QUERIES, SQL)
    assert good, note
