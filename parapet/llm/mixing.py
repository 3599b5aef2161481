"""Mixing sources to target weights, in blocks of words.

The words of a source, in a fixed order of its documents, are cut into blocks of
fixed length.  The mix is a row of slots, split into output shards.  Each shard
draws how many of its slots each source gets, from a multinomial law conditioned
on the sources' totals; the slots of a source then run through a pseudorandom
permutation of its block numbers, once per pass, and blocks join by number.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from parapet.llm.shared import WORD_PATTERN, stored, unused

SHARE = 1.5  # of all sizes, in the mix
REPEAT = 2.0  # a source is repeated so often at most
SHARD_SLOTS = 1 << 15
GROUP_SHARDS = 1 << 13  # shards of a group share a tree of draws; totals per group are exact


@dataclass
class Mix:
    """sources: source, weight, source_size, target, blocks, slots (plain rows).
    documents: doc_id, source, size, first (its place among its source's words).
    pieces: source, block, doc_id, first, start, length; the words of a block.
    slots: shard, slot, source, block, pass.  A few shards make many slots, so joins
    with them are told to merge: planned sizes are far too small."""

    sources: list[dict]
    documents: DataFrame
    pieces: DataFrame
    slots: DataFrame


def targets(sizes: dict[str | None, int], weights=(3.0, 1.0, 2.0), share: float = SHARE,
            repeat: float = REPEAT) -> dict[str | None, float]:
    """Words wanted of each source: by weight, no more than ``repeat`` times its size.

    Sources in code point order, null last, take the weights in turn.  What is
    over a source's limit goes to the others by weight, until none is over.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), list(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > repeat * sizes[s]]
        if not over:
            out |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            out[s] = repeat * sizes[s]
        left -= sum(out[s] for s in over)
        open_ = [s for s in open_ if s not in out]
    return {s: out[s] for s in order}


def _permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """index below size through a permutation of 0..size-1 that the key picks.

    Four Feistel rounds on the least even number of bits; numbers that leave the
    range walk on until they are back in it.
    """
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)

    def once(x, half, mask, key):
        left, right = x >> half, x & mask
        for r in range(4):
            f = (right + key + np.uint64(r * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
            f ^= f >> np.uint64(29)
            f *= np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((f >> np.uint64(32)) & mask)
        return (left << half) | right

    with np.errstate(over="ignore"):
        out = once(index.astype(np.uint64), half, mask, key)
        while len(rest := np.flatnonzero(out >= size.astype(np.uint64))):
            out[rest] = once(out[rest], half[rest], mask[rest], key[rest])
    return out.astype(np.int64)


def _shard_counts(totals: np.ndarray, shard: int, shards: int, slots: int, seed: int):
    """Slots of each source in this shard and in those before it.

    Shards halve down a tree, each half drawing its part of what the sources have
    there; every shard repeats the same draws and needs no other shard.
    """
    groups = -(-shards // GROUP_SHARDS)
    group = shard // GROUP_SHARDS
    total = int(totals.sum())
    low, high = group * GROUP_SHARDS, min(shards, (group + 1) * GROUP_SHARDS)
    # cuts of the merged row of sources at group borders, in proportion; exact in whole
    before = _proportional(totals, min(low * slots, total), total)
    counts = _proportional(totals, min(high * slots, total), total) - before
    while high - low > 1:
        middle = (low + high) // 2
        n = min(middle * slots, total) - min(low * slots, total)
        rng = np.random.default_rng([seed, groups, low, high])
        left = rng.multivariate_hypergeometric(counts, n)
        if shard < middle:
            counts, high = left, middle
        else:
            before, counts, low = before + left, counts - left, middle
    return counts, before


def _proportional(totals: np.ndarray, n: int, total: int) -> np.ndarray:
    """Whole numbers that sum to n, near totals * n / total and rising with n."""
    if not total:
        return np.zeros_like(totals)
    ends = np.cumsum(totals)
    at = [int(e) * n // total for e in ends]
    return np.diff([0, *at])


def mix(docs: DataFrame, weights=(3.0, 1.0, 2.0), share: float = SHARE, repeat: float = REPEAT,
        block: int = 64, seed: int = 17, rows_per_bucket: int = 100_000) -> Mix:
    """Plan the mix of ``docs`` (doc_id, text, source).

    A document's size is its number of words; a null or blank text has none and
    no piece.  A null source is a source of its own, the last.  Repeated rows are
    separate documents.  An empty table gives an empty mix.  The sources
    themselves (name and size) pass through the driver: their number is that of a
    catalogue.
    """
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
    sized = stored(docs.select("doc_id", "source", size.alias("size"), _mark(docs).alias("mark")), "mix-sizes")
    found = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    sizes = {r["source"]: int(r["size"]) for r in found}
    rows = sum(r["n"] for r in found)
    wanted = targets(sizes, weights, share, repeat)
    sources = []
    for i, s in enumerate(wanted):
        blocks = -(-sizes[s] // block)
        slots = round(wanted[s] * blocks / sizes[s]) if sizes[s] else 0
        sources.append({"number": i, "source": s, "source_size": sizes[s], "target": wanted[s],
                        "blocks": blocks, "slots": min(slots, int(repeat * blocks))})

    # places of documents among their source's words: order by bucket, then id, size and text
    buckets = max(1, -(-rows // rows_per_bucket))
    placed = sized.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(buckets)))
    inside = Window.partitionBy("source", "_bucket").orderBy("doc_id", "size", "mark").rowsBetween(
        Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("source", "_bucket").agg(F.sum("size").alias("_size")).select(
        F.col("source").alias("_source"), F.col("_bucket").alias("_b"),
        F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset"))
    documents = placed.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(
        offsets, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_bucket") == F.col("_b"))
    ).withColumn("copy", _copy()).select("doc_id", "mark", "copy", "source", "size", (F.col("_inside") + F.col("_offset")).alias("first"))
    documents = stored(documents, "mix-documents")

    number = F.coalesce(*[F.when(F.col("source").eqNullSafe(F.lit(x["source"])), x["number"])
                          for x in sources], F.lit(None).cast("int")) if sources else F.lit(None).cast("int")
    last = F.col("first") + F.col("size")
    pieces = (
        documents.where("size > 0").withColumn("number", number)
        .withColumn("block", F.explode(F.sequence(F.expr(f"first div {block}"), F.expr(f"(first + size - 1) div {block}"))))
        .withColumn("_from", F.greatest(F.col("first"), F.col("block") * block))
        .withColumn("length", F.least(last, (F.col("block") + 1) * block) - F.col("_from"))
        .select("number", "block", "doc_id", "mark", "copy", "source", "first", "size",
                (F.col("_from") - F.col("first")).alias("start"), "length")
    )
    return Mix(sources, documents, pieces, _draw(spark, sources, seed))


def _mark(docs: DataFrame):
    """Tells rows that share an id apart, with ``_copy`` also equal ones."""
    return F.xxhash64("text", "source")


def _copy():
    return F.row_number().over(Window.partitionBy("doc_id", "mark").orderBy("source"))


def _draw(spark, sources: list[dict], seed: int) -> DataFrame:
    totals = np.array([x["slots"] for x in sources], np.int64)
    blocks = np.array([x["blocks"] for x in sources], np.int64)
    shards = int(-(-totals.sum() // SHARD_SLOTS)) if len(totals) else 0

    def draw(batches):
        for batch in batches:
            for shard in batch["id"]:
                counts, before = _shard_counts(totals, int(shard), shards, SHARD_SLOTS, seed)
                of = np.repeat(np.arange(len(counts)), counts)
                index = np.concatenate([b + np.arange(c) for b, c in zip(before, counts)])
                turn = index // blocks[of]
                key = (of * 1_000_003 + turn * 7_919 + seed).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                at = _permuted(index % blocks[of], blocks[of], key)
                shuffled = np.random.default_rng([seed, 1, int(shard)]).permutation(len(of))
                yield pd.DataFrame({
                    "shard": np.int64(shard), "slot": np.arange(len(of)), "number": of[shuffled].astype(np.int32),
                    "block": at[shuffled], "pass": turn[shuffled].astype(np.int32)})

    return spark.range(0, shards, 1, max(1, shards)).mapInPandas(
        draw, "shard long, slot long, number int, block long, pass int")


def taken(plan: Mix) -> DataFrame:
    """Words the mix takes of each document: doc_id, source, first, size, taken.

    Repeats count.  Blocks are counted before they meet the pieces.
    """
    times = plan.slots.groupBy("number", "block").agg(F.count("*").alias("times"))
    got = plan.pieces.join(times.hint("merge"), ["number", "block"]).groupBy("number", "first").agg(
        F.sum(F.col("length") * F.col("times")).alias("taken"))
    number = {x["source"]: x["number"] for x in plan.sources}
    docs = plan.documents.withColumn("number", F.coalesce(
        *[F.when(F.col("source").eqNullSafe(F.lit(s)), i) for s, i in number.items()],
        F.lit(None).cast("int")))
    # a place is one document's alone, but for empty ones
    mine = (docs["number"] == got["number"]) & (docs["first"] == got["first"]) & (docs["size"] > 0)
    return docs.join(got, mine, "left").select(
        "doc_id", "source", docs["number"], docs["first"], "size", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_pieces(plan: Mix) -> DataFrame:
    """The mix itself: shard, slot, source, block, pass, doc_id, start, length."""
    return plan.slots.hint("merge").join(plan.pieces, ["number", "block"]).select(
        "shard", "slot", "source", "block", "pass", "doc_id", "mark", "copy", "start", "length")


def mixed_documents(docs: DataFrame, plan: Mix) -> DataFrame:
    """The mix as documents: for each document and pass a row with the words taken.

    Words of neighbouring blocks stay as they were in the text; parts that were
    not next to each other join by a line break.  Other columns are kept; a
    document of which nothing is taken has no row.  doc_id repeats where a
    document is taken twice.
    """
    columns = docs.columns
    keys = ["doc_id", "mark", "copy"]
    mark, copy, own, *theirs = (unused(name, docs) for name in ("_mark", "_copy", "_spans", "_k0", "_k1", "_k2"))
    spans = mixed_pieces(plan).groupBy(*keys, "pass").agg(
        F.sort_array(F.collect_list(F.struct("start", "length"))).alias(own))  # bounded by the text
    spans = spans.select(*[F.col(k).alias(t) for k, t in zip(keys, theirs)], own)
    rows = docs.withColumn(mark, _mark(docs))
    rows = rows.withColumn(copy, F.row_number().over(Window.partitionBy("doc_id", mark).orderBy("source")))
    rows = rows.join(spans, F.col("doc_id").eqNullSafe(F.col(theirs[0])) & (F.col(mark) == F.col(theirs[1]))
                     & (F.col(copy) == F.col(theirs[2]))).select(*columns, own)

    schema = docs.schema
    at = {c: i for i, c in enumerate(columns)}

    def cut(batches):
        import pyarrow as pa

        for batch in (b.slice(k, 200) for b in batches for k in range(0, b.num_rows, 200)):
            spans = batch.column(batch.num_columns - 1)
            ends = np.cumsum(spans.value_lengths().to_numpy())
            flat = spans.flatten()
            start, length = (flat.field(k).to_numpy() for k in range(2))
            texts = [_cut(text, start[e - n:e], length[e - n:e]) for text, e, n in zip(
                batch.column(at["text"]).to_pylist(), ends, spans.value_lengths().to_numpy())]
            out = list(batch.columns[:-1])
            out[at["text"]] = pa.array(texts, pa.string())
            if "n_chars" in at:
                kind = batch.schema.field("n_chars").type
                out[at["n_chars"]] = pa.array([len(t) for t in texts]).cast(kind)
            yield pa.RecordBatch.from_arrays(out, batch.schema.names[:-1])

    return rows.mapInArrow(cut, schema)


def _cut(text: str, start: np.ndarray, length: np.ndarray) -> str:
    """The words of the spans, which rise; neighbouring spans are one part."""
    words = [m.span() for m in re.finditer(WORD_PATTERN, text)]
    parts: list[list[int]] = []
    for a, n in zip(start.tolist(), length.tolist()):
        if parts and parts[-1][1] == a:
            parts[-1][1] = a + n
        else:
            parts.append([a, a + n])
    return "\n".join(text[words[a][0]:words[b - 1][1]] for a, b in parts)
