import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from parapet.config import Scale, ScreeningConfig
from parapet.operators import graph, senders
from parapet.operators.ordered import sums_before
from parapet.streaming.screen import StreamScreening, start_screening

SMALL_BUCKETS = ScreeningConfig(scale=Scale(rows_per_bucket=17))


def messages(spark, rows):
    return spark.createDataFrame(
        rows, "seq bigint, from_agent string, to_agent string, base_suspicion double"
    ).withColumn("message_id", F.col("seq").cast("string"))


def random_messages(seed, count, agents):
    """A third of all messages come from one agent; order values are uneven."""
    rng, rows, seq = random.Random(seed), [], 0
    for _ in range(count):
        seq += rng.choice([1, 1, 2, 50])
        sender = 0 if rng.random() < 0.33 else rng.randrange(agents)
        receiver = min(agents - 1, sender + rng.randint(0, 2)) if rng.random() < 0.9 else rng.randrange(agents)
        rows.append((seq, f"a{sender}", f"a{receiver}", round(rng.random(), 3)))
    return rows


def brute_force(rows):
    edges, nodes, history, result = defaultdict(set), set(), defaultdict(list), {}
    for seq, sender, receiver, suspicion in rows:
        edges[sender].add(receiver)
        nodes |= {sender, receiver}
        history[sender].append(suspicion)
        seen, stack = set(), [sender]
        while stack:
            for step in edges[stack.pop()]:
                if step not in seen:
                    seen.add(step)
                    stack.append(step)
        seen.discard(sender)
        recent = history[sender][-10:]
        mean = sum(recent) / len(recent)
        share = len(seen) / (len(nodes) - 1) if len(nodes) > 1 else 0.0
        result[seq] = (mean, share, (0.7 * suspicion + 0.3 * mean) * share)
    return result


def check(rows, frame):
    wanted = brute_force(rows)
    got = {r["seq"]: (r["suspicion_history"], r["cascade_potential"], r["cascade_risk"]) for r in frame.collect()}
    assert got.keys() == wanted.keys()
    for seq, values in wanted.items():
        assert got[seq] == pytest.approx(values, abs=1e-12), seq


@pytest.mark.parametrize("config", [ScreeningConfig(), SMALL_BUCKETS])
@pytest.mark.parametrize("seed", [1, 2])
def test_context_agrees_with_one_by_one(spark, config, seed):
    rows = random_messages(seed, 230, 14)
    check(rows, senders.cascade_context(messages(spark, rows).repartition(5), config=config))


def test_stream_agrees_with_one_by_one(spark, tmp_path):
    rows = random_messages(7, 120, 12)
    source = tmp_path / "in"
    for place in range(3):
        messages(spark, rows[place * 40:(place + 1) * 40]).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(messages(spark, rows[:1]).schema).option(
        "maxFilesPerTrigger", 1
    ).parquet(str(source))
    sink = StreamScreening(str(tmp_path / "out"), config=SMALL_BUCKETS)
    start_screening(stream, sink, available_now=True).awaitTermination()
    check(rows, sink.detections(spark))
    # a repeated micro-batch leaves the result as it is
    sink(messages(spark, rows[80:]), 2)
    check(rows, sink.detections(spark))


def test_cycle_and_small_graphs(spark):
    def pairs(rows):
        edges = graph.edge_aggregate(messages(spark, rows))
        found = {(r["src"], r["dst"]) for r in graph.reachable_pairs(edges).collect()}
        potentials = {r["agent"]: r["cascade_potential"] for r in graph.cascade_potential(edges).collect()}
        return found, potentials

    assert pairs([(1, "a", "b", 0.0), (2, "b", "a", 0.0)]) == ({("a", "b"), ("b", "a")}, {"a": 1.0, "b": 1.0})
    assert pairs([(1, "a", "b", 0.0)]) == ({("a", "b")}, {"a": 1.0, "b": 0.0})
    assert pairs([(1, "a", "a", 0.0)]) == (set(), {"a": 0.0})


def test_static_potential(spark):
    rows = [(1, "a", "b", 1.0), (2, "b", "c", 1.0), (3, "a", "b", 0.5)]
    got = senders.cascade_context(messages(spark, rows), as_of=False).orderBy("seq").collect()
    assert [r["cascade_potential"] for r in got] == [1.0, 0.5, 1.0]


def test_history_uses_last_ten(spark):
    rows = [(i, "a", "b", float(i)) for i in range(12)]
    for config in [ScreeningConfig(), ScreeningConfig(scale=Scale(rows_per_bucket=3))]:
        got = senders.suspicion_history(messages(spark, rows), config=config).orderBy("seq").collect()
        assert got[-1]["suspicion_history"] == pytest.approx(sum(range(2, 12)) / 10)
        assert got[0]["suspicion_history"] == 0.0
    last = senders.agent_suspicion(messages(spark, rows)).first()
    assert last["suspicion"] == pytest.approx(6.5)


def test_edges(spark):
    rows = [(1, "a", "b", 0.5), (2, "a", "b", 0.25), (3, "b", "a", 1.0)]
    edges = graph.edge_aggregate(messages(spark, rows), suspicion="base_suspicion")
    assert sorted(tuple(r) for r in edges.collect()) == [("a", "b", 2, 0.75, 1), ("b", "a", 1, 1.0, 3)]


@pytest.mark.parametrize("bucket", [4, 1000])
def test_sums_before(spark, bucket):
    rng = random.Random(4)
    rows = [(rng.choice("xy"), i * i - 50, rng.randint(0, 9)) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, o bigint, v bigint")
    got = {(r["k"], r["o"]): r["v_before"] for r in sums_before(df, ["k"], "o", ["v"], bucket).collect()}
    for k, o, _ in rows:
        assert got[(k, o)] == sum(v for kk, oo, v in rows if kk == k and oo < o)
