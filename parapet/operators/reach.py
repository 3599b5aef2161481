"""How many agents each agent reaches, without listing pairs.

Agents that reach each other form a component, and reach the same agents.  The
graph of components has no cycles.  Every component keeps a counting sketch of the
agents in and below it (HyperLogLog: per register the largest rank of a hashed
agent), as rows of (component, register, rank).  Sketches are merged by a maximum, so
they go along the edges in rounds, and only ranks that grew in the last round are
sent on.  All is grouped by component and register with sums built up before the
shuffle: a hub with a third of all edges is spread over its registers, and the
largest table has at most ``registers`` rows a component.

Rounds go on until nothing changes, that is as many as the longest of the shortest
ways; each round reads and writes what changed, not the whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from parapet.functions.picks import shuffle_key
from parapet.operators.graph import agents_of, cascade_potential, potential
from parapet.operators.lineage import cut_lineage

#: Registers of a sketch, a power of two.  The relative standard error is about
#: 1.04 / sqrt(registers): 3.3 % with 1,024.  A small reach is exact but for agents that share a register.
REGISTERS = 1024
_SEED = "reach"


def _plain_edges(edges: DataFrame) -> DataFrame:
    """Each (src, dst) once, without those from an agent to itself; null is no agent."""
    return edges.where(F.col("src") != F.col("dst")).select("src", "dst").distinct()


def _between(edges: DataFrame, inner: DataFrame) -> DataFrame:
    """Edges whose two ends are both among ``inner`` (a column agent, each once)."""
    near = edges.join(inner.select(F.col("agent").alias("src")), "src", "left_semi")
    return near.join(inner.select(F.col("agent").alias("dst")), "dst", "left_semi").select("src", "dst")


def _core(edges: DataFrame) -> DataFrame:
    """The edges among agents that have edges in and out, and so on: what may lie on
    a cycle, or between two."""
    count = edges.count()
    while True:
        inner = edges.select(F.col("src").alias("agent")).intersect(edges.select(F.col("dst").alias("agent")))
        edges = cut_lineage(_between(edges, inner))
        left = edges.count()
        if left == count:
            return edges
        count = left


def _colours(edges: DataFrame) -> DataFrame:
    """(agent, colour): the least agent that reaches it, itself included."""
    agents = edges.select(F.explode(F.array("src", "dst")).alias("agent")).distinct()
    state = cut_lineage(agents.select("agent", F.col("agent").alias("colour"), F.lit(True).alias("new")))
    while not state.where("new").isEmpty():
        sent = state.where("new").join(edges, F.col("agent") == F.col("src")).groupBy(
            F.col("dst").alias("agent")).agg(F.min("colour").alias("_sent"))
        joined = state.join(sent, "agent", "left")
        less = F.coalesce(F.col("_sent") < F.col("colour"), F.lit(False))
        state = cut_lineage(joined.select(
            "agent", F.when(less, F.col("_sent")).otherwise(F.col("colour")).alias("colour"), less.alias("new")))
    return state.select("agent", "colour")


def components(edges: DataFrame) -> DataFrame:
    """(agent, component) of all agents: who reach each other share a component, which
    is named by its least agent.

    Agents that can't lie on a cycle are trimmed first.  Then colours spread forward,
    and the component of a colour's first agent is what reaches it within the colour.
    """
    every = edges.select(F.explode(F.array("src", "dst")).alias("agent")).where("agent IS NOT NULL").distinct()
    rest = _core(cut_lineage(_plain_edges(edges)))
    found = None
    while not rest.isEmpty():
        colours = _colours(rest)
        of_src = colours.withColumnsRenamed({"agent": "src", "colour": "_src"})
        of_dst = colours.withColumnsRenamed({"agent": "dst", "colour": "_dst"})
        inside = cut_lineage(rest.join(of_src, "src").join(of_dst, "dst").where("_src = _dst").select("src", "dst"))
        reached = cut_lineage(colours.where("agent = colour").select("agent", F.col("colour").alias("component")))
        last = reached
        while True:  # backwards from the first agents, inside their colours
            step = inside.join(last, F.col("dst") == F.col("agent")).select(F.col("src").alias("agent"), "component")
            last = cut_lineage(step.distinct().join(reached.select("agent"), "agent", "left_anti"))
            if last.isEmpty():
                break
            reached = cut_lineage(reached.unionByName(last))
        found = reached if found is None else cut_lineage(found.unionByName(reached))
        left = colours.join(reached.select("agent"), "agent", "left_anti")
        rest = _core(cut_lineage(_between(rest, left)))
    if found is None:
        return every.select("agent", F.col("agent").alias("component"))
    return every.join(found, "agent", "left").select("agent", F.coalesce("component", "agent").alias("component"))


def _sketch(agent: Column, registers: int) -> list[Column]:
    """Register and rank of an agent: two parts of its hash."""
    digits = shuffle_key(agent, _SEED)
    register = F.conv(F.substring(digits, 1, 12), 16, 10).cast("bigint") % F.lit(registers)
    rest = F.conv(F.substring(digits, 13, 12), 16, 10).cast("bigint")  # 48 bits
    rank = F.when(rest == 0, 49).otherwise(49 - F.length(F.bin(rest)))
    return [register.cast("int").alias("register"), rank.cast("int").alias("rank")]


def sketch_estimate(powers: Column, filled: Column, registers: int) -> Column:
    """The number of agents in a sketch, from the sum of 2^-rank over its filled
    registers and their number.

    The estimator needs no correction by ranges: empty registers enter by the series
    x + sum of x^(2^k) 2^(k-1), with x their share.
    """
    empty = 1 - filled / F.lit(float(registers))
    series = empty
    for k in range(1, int(math.log2(registers)) + 7):
        series = series + F.pow(empty, F.lit(float(2**k))) * F.lit(2.0 ** (k - 1))
    top = registers * registers / (2 * math.log(2))
    return F.lit(top) / (powers + registers * series)


def reach_sketches(edges: DataFrame, found: DataFrame, registers: int = REGISTERS) -> DataFrame:
    """(component, register, rank) of all agents in and below every component."""
    if registers < 16 or registers & (registers - 1):
        raise ValueError("registers must be a power of two, 16 at least")
    of_src = found.withColumnsRenamed({"agent": "src", "component": "above"})
    of_dst = found.withColumnsRenamed({"agent": "dst", "component": "below"})
    links = cut_lineage(
        _plain_edges(edges).join(of_src, "src").join(of_dst, "dst").where("above <> below").select("above", "below").distinct())
    own = found.select("component", *_sketch(F.col("agent"), registers))
    state = cut_lineage(own.groupBy("component", "register").agg(
        F.max("rank").alias("rank")).withColumn("new", F.lit(True)))
    while not state.where("new").isEmpty():
        sent = state.where("new").join(links, F.col("component") == F.col("below")).select(
            F.col("above").alias("component"), "register", "rank", F.lit(False).alias("known"))
        both = state.select("component", "register", "rank", F.lit(True).alias("known")).unionByName(sent)
        merged = both.groupBy("component", "register").agg(
            F.max("rank").alias("rank"), F.max(F.when(F.col("known"), F.col("rank"))).alias("_before"))
        grew = F.col("_before").isNull() | (F.col("rank") > F.col("_before"))
        state = cut_lineage(merged.select("component", "register", "rank", grew.alias("new")))
    return state.select("component", "register", "rank")


def reach_estimates(
    edges: DataFrame, registers: int = REGISTERS, exact_below: int = 0, found: DataFrame | None = None,
) -> DataFrame:
    """agent, reached, cascade_potential: as ``cascade_potential``, ``reached`` estimated.

    ``reached`` leaves the agent itself out and is at most all others.  Agents that
    reach nobody get 0, exactly, and agents that reach each other the same.  A missing
    agent has no row, but counts as one of the others.  A graph of at most ``exact_below`` agents is counted by its pairs instead, exactly,
    at the cost of up to agents^2 rows.  Memory is linear in agents and edges.
    """
    total = agents_of(edges).count()
    if total <= exact_below:
        exact = cascade_potential(edges).where("agent IS NOT NULL")
        return exact.select("agent", F.col("reached").cast("double").alias("reached"), "cascade_potential")
    found = cut_lineage(components(edges) if found is None else found)
    counted = reach_sketches(edges, found, registers).groupBy("component").agg(
        F.sum(F.pow(F.lit(2.0), -F.col("rank"))).alias("_powers"), F.count("*").alias("_filled"))
    sends = _plain_edges(edges).select(F.col("src").alias("agent"), F.lit(True).alias("_sends")).distinct()
    known = found.join(sends, "agent", "left").groupBy("component").agg(
        F.count("*").alias("_size"), F.max("_sends").alias("_sends"))
    # who sends to nobody else reaches none; no other estimate is below what is known
    least = F.greatest(F.col("_size") - 1, F.lit(1)).cast("double")
    estimate = sketch_estimate(F.col("_powers"), F.col("_filled"), registers) - 1
    reached = F.when(F.col("_sends"), F.least(F.greatest(estimate, least), F.lit(float(max(total - 1, 0))))).otherwise(0.0)
    by_component = counted.join(known, "component").select("component", reached.alias("reached"))
    return found.join(by_component, "component").select(
        "agent", "reached", potential(F.col("reached"), F.lit(total)).alias("cascade_potential"))
