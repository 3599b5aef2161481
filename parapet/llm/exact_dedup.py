"""Exact duplicates by an extendible-hash index on shared files.

Texts are equal when they are identical after lower-casing A-Z only.  The index
has one entry per distinct text.  Entries of a hash value form a chain, told
apart by the bytes of their texts.  A directory over the leading bits of the hash
says which bucket holds an entry: it starts with one bucket and doubles as long
as a bucket is overfull, and each bucket is a range of hash values, owned by one
task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from parapet.llm.shared import lower_ascii, stored, unused

#: The directory has at most 2 ** MAX_DEPTH cells, which bounds what is broadcast (1 MB).
#: At that depth buckets only get larger; nothing is left out.
MAX_DEPTH = 16


@dataclass
class Index:
    """entries: bucket, hash, chain, text_sha256, keep_id, group_size; one row a text.
    directory: cell, bucket, depth; 2 ** MAX_DEPTH rows at most."""

    entries: DataFrame
    directory: DataFrame


def normalised(text: Column) -> Column:
    return lower_ascii(F.coalesce(text, F.lit("")))


def _cell(hashed: Column) -> Column:
    return F.shiftrightunsigned(hashed, 64 - MAX_DEPTH).cast("int")


def build_directory(entries: DataFrame, capacity: int) -> DataFrame:
    """Split the hash range into buckets of at most ``capacity`` entries.

    A bucket of depth d holds the hashes with its d leading bits.  Doubling stops
    for a cell at the first depth at which its bucket isn't overfull.
    """
    cells = entries.groupBy(_cell(F.col("hash")).alias("cell")).agg(F.count("*").alias("n"))
    depth = F.lit(MAX_DEPTH)
    for d in range(MAX_DEPTH - 1, -1, -1):
        same = Window.partitionBy(F.shiftright("cell", MAX_DEPTH - d))
        cells = cells.withColumn(f"n{d}", F.sum("n").over(same))
        depth = F.when(F.col(f"n{d}") <= capacity, d).otherwise(depth)
    # the smallest depth that fits: the conditions are nested from the deepest to depth 0
    return cells.select("cell", depth.alias("depth")).withColumn(
        "bucket", F.expr(f"shiftleft(shiftright(cell, {MAX_DEPTH} - depth), {MAX_DEPTH} - depth)")
    )


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                capacity: int = 250_000) -> Index:
    """Index of the distinct texts of ``docs``.

    Texts are pre-aggregated before the only shuffle of texts, so a text with a
    third of all rows reaches its owner as one row per task.
    """
    text = normalised(docs[text_col])
    one_text = (
        docs.select(F.xxhash64(text).alias("hash"), text.alias("text"), docs[id_col].alias("id"))
        .groupBy("hash", "text")  # the bytes decide, not the hash
        .agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
        .select("hash", F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size")
    )
    one_text = stored(one_text, "dedup-entries")
    directory = build_directory(one_text, capacity)
    placed = one_text.join(
        F.broadcast(directory.select("cell", "bucket")), _cell(F.col("hash")) == F.col("cell")
    ).drop("cell")
    owned = placed.repartition("bucket").withColumn(
        "chain", F.row_number().over(Window.partitionBy("bucket", "hash").orderBy("text_sha256"))
    )
    return Index(stored(owned, "dedup-index"), directory)


def mark_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    capacity: int = 250_000) -> DataFrame:
    """Every row of ``docs`` with keep_id, group_size, kept and text_sha256.

    Of equal texts the row with the largest id stays.  A null text counts as
    empty.  A null id stays only in a group without other ids; rows that repeat
    the kept id are kept alike (they are the same row).  An empty table gives none.
    Other columns play no part; the result has the id and the four named ones.
    """
    index = build_index(docs, id_col, text_col, capacity)
    text = normalised(docs[text_col])
    probes = docs.select(
        docs[id_col].alias("_id"), F.xxhash64(text).alias("hash"), F.sha2(text, 256).alias("text_sha256")
    )
    entries = index.entries.select("hash", "text_sha256", "keep_id", "group_size")
    return probes.join(entries, ["hash", "text_sha256"]).select(
        F.col("_id").alias(id_col), "keep_id", "group_size",
        F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256",
    )


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    capacity: int = 250_000) -> DataFrame:
    """The kept rows of ``docs``, all columns; one row where a kept row is repeated."""
    columns = docs.columns
    text = normalised(docs[text_col])
    hashed, sha, keep = (unused(name, docs) for name in ("_hash", "_sha", "_keep"))
    kept = build_index(docs, id_col, text_col, capacity).entries.select(
        F.col("hash").alias(hashed), F.col("text_sha256").alias(sha), F.col("keep_id").alias(keep))
    rows = docs.select("*", F.xxhash64(text).alias(hashed), F.sha2(text, 256).alias(sha))
    found = rows.join(
        kept,
        (rows[hashed] == kept[hashed]) & (rows[sha] == kept[sha])
        & rows[id_col].eqNullSafe(kept[keep]),
    ).select(*[rows[c] for c in columns], rows[sha])
    return found.dropDuplicates([id_col, sha]).select(*columns)
