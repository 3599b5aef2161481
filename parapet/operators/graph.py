"""The agent graph: edges, who can be reached, and since when."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from parapet.operators.lineage import cut_lineage


def edge_aggregate(
    messages: DataFrame,
    source: str = "from_agent",
    target: str = "to_agent",
    suspicion: str | None = None,
    order: str = "seq",
) -> DataFrame:
    """One row per (from, to): message count, summed suspicion, first order value.

    Counts are built up before the shuffle, so a pair that holds a third of
    all messages sends one row per task.
    """
    suspicion_sum = F.sum(suspicion) if suspicion else F.lit(0.0)
    return messages.groupBy(F.col(source).alias("src"), F.col(target).alias("dst")).agg(
        F.count("*").alias("cnt"),
        suspicion_sum.alias("suspicion_total"),
        F.min(order).alias("first_seen"),
    )


def agents_of(edges: DataFrame) -> DataFrame:
    """Every agent with the order value at which it first appears."""
    ends = edges.select(
        F.explode(F.array(F.col("src"), F.col("dst"))).alias("agent"), "first_seen"
    )
    return ends.groupBy("agent").agg(F.min("first_seen").alias("first_seen"))


def reachable_pairs(edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """All (src, dst) with a path from src to dst, src itself left out.

    ``first_seen`` is the order value from which on the path exists: over all
    paths, the smallest of their latest edges.  Each round joins the pairs found
    or improved in the round before with all pairs, on either side, so paths
    double in length and the rounds grow with the logarithm of the longest.
    ``known`` holds pairs of an earlier, smaller graph; only what new edges add
    is followed.
    """
    steps = (
        edges.where(F.col("src") != F.col("dst"))
        .groupBy("src", "dst").agg(F.min("first_seen").alias("first_seen"))
    )
    if known is None:
        pairs = steps.select("src", "dst", "first_seen", F.lit(True).alias("changed"))
    else:
        pairs = _merge(known.select("src", "dst", "first_seen"), steps)
    pairs = cut_lineage(pairs)
    while not pairs.where("changed").isEmpty():
        pairs = cut_lineage(_merge(pairs, _longer(pairs)))
    return pairs.drop("changed")


def _longer(pairs: DataFrame) -> DataFrame:
    """Pairs by way of a third agent, where at least one half has changed."""
    head = pairs.select("src", F.col("dst").alias("mid"), "first_seen", "changed")
    tail = pairs.select(
        F.col("src").alias("mid"), "dst", F.col("first_seen").alias("tail_seen"),
        F.col("changed").alias("tail_changed"),
    )
    joined = head.where("changed").join(tail, "mid").unionByName(
        head.where("NOT changed").join(tail.where("tail_changed"), "mid")
    )
    return joined.where(F.col("src") != F.col("dst")).groupBy("src", "dst").agg(
        F.min(F.greatest("first_seen", "tail_seen")).alias("first_seen")
    )


def _merge(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Keep the smallest order value per pair and note which pairs changed."""
    both = pairs.select("src", "dst", "first_seen", F.lit(True).alias("old")).unionByName(
        found.select("src", "dst", "first_seen", F.lit(False).alias("old"))
    )
    merged = both.groupBy("src", "dst").agg(
        F.min("first_seen").alias("first_seen"),
        F.min(F.when(F.col("old"), F.col("first_seen"))).alias("before"),
    )
    changed = F.col("before").isNull() | (F.col("first_seen") < F.col("before"))
    return merged.select("src", "dst", "first_seen", changed.alias("changed"))


def potential(reached: Column, agents: Column) -> Column:
    """Share of the other agents that can be reached."""
    return F.when(agents > 1, F.coalesce(reached, F.lit(0)) / (agents - 1)).otherwise(F.lit(0.0))


def cascade_potential(edges: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Per agent: how many agents it reaches and which share of the others."""
    pairs = reachable_pairs(edges) if pairs is None else pairs
    agents = agents_of(edges)
    reached = pairs.groupBy(F.col("src").alias("agent")).agg(F.count("*").alias("reached"))
    total = agents.agg(F.count("*").alias("n")).scalar()
    joined = agents.join(reached, "agent", "left").withColumn("agents", total)
    return joined.select(
        "agent", F.coalesce("reached", F.lit(0)).alias("reached"),
        potential(F.col("reached"), F.col("agents")).alias("cascade_potential"),
    )


def downstream_list(pairs: DataFrame) -> DataFrame:
    """Per agent the sorted list of agents it reaches (at most all agents)."""
    return pairs.groupBy(F.col("src").alias("agent")).agg(
        F.sort_array(F.collect_list("dst")).alias("downstream_agents")
    )
