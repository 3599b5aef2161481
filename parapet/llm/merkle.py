"""A Merkle manifest of a dataset, with a proof for every row.

Rows are leaves.  In each language they are ordered by id; eight neighbours at a
time become a node, level by level, until one is left, the language's root.  The
languages' roots, in order of their names, become one root in the same way.

Nodes are labelled with the interval of leaf ranks they cover.  A node on level k
starts in the bucket ``lo div 8^k``, so a node finds its parent by an equality join
on (tree, bucket) and containment of its interval; parents come with what leads on
to the root, from the top down, so each level is joined once and a leaf takes part
in one join.  What a parent's interval holds beside the node's own are its siblings.

Everything is DataFrame functions.  Leaves are ranked in range partitions with
offsets; nothing of a language meets in one task but the counts of partitions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from parapet.llm.shared import lower_ascii, stored

FAN = 8
#: Runs (partitions and languages) up to which their offsets are broadcast.
BROADCAST_RUNS = 100_000
STEPS = "array<struct<before:string,after:string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the strings, one after another."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf_digest(*values: Column) -> Column:
    """Digest of a row: each value with its length in bytes, ``-`` for null."""
    own = [v.cast("string") for v in values]
    return digest(*[
        F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in own])


def fold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf's digest and the siblings on its way lead to."""
    return F.aggregate(steps, leaf, lambda own, s: digest(s["before"], own, s["after"]))


def proof_digest(steps: Column) -> Column:
    """Digest of all siblings, from the leaf's level to the root's, left to right."""
    return digest(F.array_join(F.transform(steps, lambda s: F.concat(s["before"], s["after"])), ""))


def leaves(docs: DataFrame, changed: Column | None = None) -> DataFrame:
    """doc_id, lang, leaf of each row, and ``other``: its leaf where ``changed`` says so
    with the text's A-Z in lower case, else the same.

    Only doc_id, source, lang, n_chars and text are read; other columns, whatever
    their names, take no part.  Nulls count as such (an empty text differs from null);
    texts are hashed whole.
    """
    first, last = [docs[c] for c in ("doc_id", "source", "lang", "n_chars")], docs["text"].cast("string")
    leaf = leaf_digest(*first, last)
    if changed is None:
        other = leaf
    else:
        other = F.when(F.coalesce(changed, F.lit(False)), leaf_digest(*first, lower_ascii(last))).otherwise(leaf)
    return docs.select(docs["doc_id"], docs["lang"].cast("string").alias("lang"), leaf.alias("leaf"), other.alias("other"))


def _ranked(rows: DataFrame, group: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """The stored rows in range partitions by group and order, with their place, and the
    runs: one row for each group in each partition, with the rank of its first row."""
    keys = [F.col(c).asc_nulls_first() for c in (group, *order)]
    placed = stored(
        rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()),
        "manifest-ranks")
    part = F.shiftright("_at", 33)
    runs = placed.groupBy(part.alias("_part"), F.col(group).alias("_group")).agg(
        F.min("_at").alias("_first"), F.count("*").alias("_n"))
    whole = Window.partitionBy("_group")  # of as many rows as partitions
    earlier = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return placed, runs.select(
        "_part", "_group", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_n").over(whole).alias("size"))


def _with_runs(placed: DataFrame, runs: DataFrame, group: str) -> DataFrame:
    """The rows with ``lo``, their rank, and what else the runs hold."""
    if runs.count() <= BROADCAST_RUNS:
        runs = F.broadcast(runs)
    same = (F.shiftright(placed["_at"], 33) == runs["_part"]) & placed[group].eqNullSafe(runs["_group"])
    return placed.join(runs, same).withColumn("lo", F.col("_at") + F.col("_shift")).drop(
        "_at", "_part", "_group", "_shift")


@dataclass
class Tree:
    """Leaves (tree, size, lo, digest and more) and the nodes of level 1 and up
    (tree, size, lo, hi, digest, children) of one or many trees."""

    leaves: DataFrame
    levels: list[DataFrame]

    def roots(self) -> DataFrame:
        """tree, size, root: a lone leaf is its tree's root."""
        found = self.leaves.where("size = 1").select("tree", "size", F.col("digest").alias("root"))
        for k, nodes in enumerate(self.levels, 1):
            top = nodes.where((F.col("size") <= FAN**k) & (F.col("size") > FAN ** (k - 1)))
            found = found.unionByName(top.select("tree", "size", F.col("digest").alias("root")))
        return found


def build(ranked: DataFrame) -> Tree:
    """All levels over leaves with tree, size (of the tree), lo and digest."""
    largest = ranked.agg(F.max("size")).first()[0] or 0
    below, levels = ranked.select("tree", "size", "lo", (F.col("lo") + 1).alias("hi"), "digest"), []
    while largest > FAN ** len(levels):
        k = len(levels) + 1
        child = F.struct("lo", "hi", "digest")
        nodes = below.where(F.col("size") > FAN ** (k - 1)).groupBy(
            "tree", "size", F.expr(f"lo div {FAN**k}").alias("_bucket")
        ).agg(F.sort_array(F.collect_list(child)).alias("children"))  # at most FAN of them
        nodes = nodes.select(
            "tree", "size", F.array_min("children.lo").alias("lo"), F.array_max("children.hi").alias("hi"),
            digest(F.array_join("children.digest", "")).alias("digest"), "children")
        levels.append(stored(nodes, f"manifest-level-{k}"))
        below = levels[-1].drop("children")
    return Tree(ranked, levels)


def with_steps(tree: Tree, tops: DataFrame) -> DataFrame:
    """The leaves with ``steps``, the siblings before and after on each level to the root.

    ``tops`` has a row for each tree: size, the steps from its root on, and columns
    that its leaves get as they are.
    """
    more = [c for c in tops.columns if c not in ("tree", "size", "steps")]

    def entering(k: int) -> DataFrame:
        """Trees whose root is on level k, as the parents of that root."""
        least = FAN ** (k - 1) if k else 0
        return tops.where((F.col("size") <= FAN**k) & (F.col("size") > least)).select(
            "tree", F.lit(0).cast("long").alias("lo"), F.col("size").alias("hi"),
            F.lit(None).cast("array<struct<lo:long,hi:long,digest:string>>").alias("children"), "steps", *more)

    def attached(nodes: DataFrame, parents: DataFrame, k: int) -> DataFrame:
        """Nodes of level k with the steps from them on."""
        bucket = F.expr(f"lo div {FAN ** (k + 1)}")
        up = parents.select(
            F.col("tree").alias("_tree"), bucket.alias("_up"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"),
            F.col("children").alias("_children"), F.col("steps").alias("_steps"), *more)
        own = nodes.withColumn("_bucket", bucket)
        inside = (F.col("lo") >= F.col("_lo")) & (F.col("hi") <= F.col("_hi"))
        joined = own.join(up, (F.col("tree") == F.col("_tree")) & (F.col("_bucket") == F.col("_up")) & inside)
        left = F.expr("array_join(transform(filter(_children, c -> c.hi <= lo), c -> c.digest), '')")
        right = F.expr("array_join(transform(filter(_children, c -> c.lo >= hi), c -> c.digest), '')")
        step = F.array(F.struct(left.alias("before"), right.alias("after"))).cast(STEPS)
        steps = F.when(F.col("_children").isNull(), F.col("_steps")).otherwise(F.concat(step, F.col("_steps")))
        return joined.withColumn("steps", steps).drop("_tree", "_up", "_bucket", "_lo", "_hi", "_children", "_steps")

    parents = entering(len(tree.levels))
    for k in range(len(tree.levels), 0, -1):
        below = attached(tree.levels[k - 1], parents, k)
        parents = stored(
            below.select("tree", "lo", "hi", "children", "steps", *more).unionByName(entering(k - 1)), f"manifest-steps-{k}")
    return attached(tree.leaves.withColumn("hi", F.col("lo") + 1), parents, 0).drop("hi")


@dataclass
class Manifest:
    """The root of a dataset (None without rows), and its rows with their proofs:
    those of ``leaves``, subroot, and ``steps``."""

    root: str | None
    rows: DataFrame


def manifest(own: DataFrame) -> Manifest:
    """The manifest over rows with doc_id, lang and leaf (see ``leaves``).

    Within a language rows go by doc_id, null first; rows with the same id by their
    digest, so that the order is total but for rows that are alike.  A null language
    is one of its own, the first.  Repeated rows are leaves of their own.  Columns that
    the rows have beside are handed on.
    """
    rest = [c for c in own.columns if c not in ("doc_id", "lang", "leaf")]
    placed, runs = _ranked(own, "lang", ["doc_id", "leaf", *rest])
    runs = stored(runs, "manifest-runs")
    names = runs.select(F.col("_group").alias("lang"), F.lit(0).alias("_all")).distinct()
    languages = _with_runs(*_ranked(names, "_all", ["lang"]), "_all")
    numbered = languages.select(F.col("lang").alias("_lang"), F.col("lo").alias("tree"))
    runs = runs.join(numbered, runs["_group"].eqNullSafe(numbered["_lang"])).drop("_lang")
    ranked = _with_runs(placed, runs, "lang").withColumnRenamed("leaf", "digest")
    tree = build(stored(ranked, "manifest-leaves"))
    # the languages' roots are the leaves of one more tree, in which they keep their numbers
    subroots = stored(tree.roots(), "manifest-subroots")
    top = build(stored(subroots.select(
        F.lit(0).cast("long").alias("tree"), F.lit(subroots.count()).cast("long").alias("size"),
        F.col("tree").alias("lo"), F.col("root").alias("digest"), F.col("size").alias("_size")), "manifest-top"))
    root = top.roots().first()
    start = top.roots().select("tree", "size", F.array().cast(STEPS).alias("steps"))
    tops = with_steps(top, start).select(
        F.col("lo").alias("tree"), F.col("_size").alias("size"), "steps", F.col("digest").alias("subroot"))
    rows = with_steps(tree, stored(tops, "manifest-tops"))
    return Manifest(root and root["root"], rows.select(
        "doc_id", "lang", F.col("digest").alias("leaf"), *rest, "subroot", "steps"))
