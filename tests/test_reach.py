"""Components and reach estimates next to plain graph walks."""

import random

import pytest
from pyspark.sql import functions as F

from parapet.operators import graph, reach, senders


def walk(edges):
    """agent -> the agents it reaches, itself left out."""
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
        out.setdefault(b, set())
    found = {}
    for start in out:
        seen, todo = set(), [start]
        while todo:
            for b in out[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        found[start] = seen - {start}
    return found


def table(spark, edges):
    return spark.createDataFrame([(a, b, 1) for a, b in edges], "src string, dst string, first_seen long")


def graphs():
    pick = random.Random(5)
    ring = [(f"r{i}", f"r{(i + 1) % 30}") for i in range(30)]
    yield "empty", []
    yield "self only", [("a", "a")]
    yield "chain into ring into leaf", [("c1", "c2"), ("c2", "r3"), ("r7", "x"), ("x", "y"), *ring]
    yield "two rings, one way", [*ring, *[(f"s{i}", f"s{(i + 1) % 9}") for i in range(9)], ("r1", "s1"), ("s0", "z")]
    yield "random", [(f"n{pick.randrange(60)}", f"n{pick.randrange(60)}") for _ in range(75)]
    yield "repeats", [("a", "b"), ("a", "b"), ("b", "a"), ("b", "c")]


@pytest.mark.parametrize("name, edges", list(graphs()), ids=[n for n, _ in graphs()])
def test_components(spark, name, edges):
    found = walk(edges)
    want = {a: min([a, *(b for b in found[a] if a in found[b])]) for a in found}
    assert {r["agent"]: r["component"] for r in reach.components(table(spark, edges)).collect()} == want


def test_estimates_next_to_exact_counts(spark):
    pick = random.Random(8)
    edges = [(f"n{i}", f"n{pick.randrange(i + 1, min(i + 400, 1500))}") for i in range(1450) for _ in range(2)]
    edges += [(f"n{i + 20}", f"n{i}") for i in range(200, 230)] + [("n5", "n5")]
    exact = {a: len(b) for a, b in walk(edges).items()}
    rows = reach.reach_estimates(table(spark, edges), registers=1024).collect()
    assert {r["agent"] for r in rows} == set(exact)
    errors = []
    for r in rows:
        want = exact[r["agent"]]
        assert 0 <= r["cascade_potential"] <= 1
        if not want:
            assert r["reached"] == 0
        else:
            errors.append((r["reached"] - want) / (want + 1))
            # four times the stated standard error, or an agent more or less in a small reach
            assert abs(r["reached"] - want) < max(1.5, 0.14 * (want + 1))
    assert (sum(e * e for e in errors) / len(errors)) ** 0.5 < 0.04
    by_pairs = {r["agent"]: r["reached"] for r in reach.reach_estimates(table(spark, edges[:40]), exact_below=100).collect()}
    assert by_pairs == {a: len(b) for a, b in walk(edges[:40]).items()}


def test_sketch_of_many_agents(spark):
    """A hub that reaches 200,000 agents, a third of all edges at one end."""
    leaves = spark.range(200_000).select(F.lit("hub").alias("src"), F.concat(F.lit("a"), "id").alias("dst"), F.lit(1).alias("first_seen"))
    more = spark.range(3).select(F.concat(F.lit("top"), "id").alias("src"), F.lit("hub").alias("dst"), F.lit(1).alias("first_seen"))
    got = {r["agent"]: r["reached"] for r in reach.reach_estimates(leaves.unionByName(more)).where("reached > 0").collect()}
    assert set(got) == {"hub", "top0", "top1", "top2"}
    assert got["hub"] == pytest.approx(200_000, rel=0.13) and got["top0"] == pytest.approx(got["hub"], rel=0.01)


def test_static_risk_from_estimates(spark):
    rows = spark.createDataFrame(
        [(i, f"n{i % 9}", f"n{i % 9 + 1}" if i % 9 < 8 else "n8", 0.5) for i in range(40)] + [(50, None, "n1", 0.9)],
        "seq long, from_agent string, to_agent string, base_suspicion double")
    got = {r["seq"]: r for r in senders.cascade_context(rows, as_of=False, estimated=True).collect()}
    exact = {r["seq"]: r for r in senders.cascade_context(rows, as_of=False).collect()}
    assert set(got) == set(exact) == {*range(40), 50}
    for k in got:
        assert got[k]["cascade_risk"] == pytest.approx(exact[k]["cascade_risk"], abs=0.03)
    with pytest.raises(ValueError):
        senders.cascade_context(rows, estimated=True)
