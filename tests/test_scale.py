"""What only shows beyond small tables: long conversations, large values, busy
agents, long chains, late messages."""

import json
import random
from datetime import datetime, timezone

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from parapet.functions.numbers import round_to
from parapet.operators import graph, ordered, senders
from parapet.sources import files
from parapet.sources.tables import conversation_messages
from parapet.streaming.history import SliceHistory, keyed_history, state_store
from parapet.streaming.screen import StreamScreening, start_screening


@pytest.fixture
def few_tasks(spark):
    """For streams of many small micro-batches."""
    own = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", own)


def test_long_conversations_keep_their_turns_apart(spark):
    turns = spark.range(1500).select(F.lit(1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"))
    turns = turns.unionByName(turns.withColumn("conv_id", F.lit(2).cast("bigint")))
    messages = conversation_messages(turns.withColumns({"role": F.lit("user"), "text": F.lit("x")}))
    found = messages.agg(F.count_distinct("message_id"), F.count_distinct("seq"), F.count("*")).first()
    assert tuple(found) == (3000, 3000, 3000)
    order = [(r["conv_id"], r["turn"]) for r in messages.orderBy("seq").collect()]
    assert order == sorted(order)
    far = turns.limit(1).withColumns({"turn": F.lit(2**33), "role": F.lit("user"), "text": F.lit("x")})
    with pytest.raises(Exception, match="32 bits"):
        conversation_messages(far).collect()


def test_large_values_survive_rounding(spark):
    values = [1e18, -5e15, 0.12345, 2.5, float("inf"), None]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in rows.select(round_to(F.col("v"), 4)).collect()] == [1e18, -5e15, 0.1235, 2.5, float("inf"), None]


def test_running_count_with_an_agent_a_message(spark):
    messages = spark.range(0, 4000, 2).select(F.col("id").alias("seq"), F.lit("x").alias("content"))
    agents = spark.range(0, 4000).select(F.col("id").cast("string").alias("agent"), F.col("id").alias("first_seen"))
    bounds = ordered.bucket_bounds(messages, "seq", 300)
    assert len(bounds) >= 6
    counted = senders.agents_so_far(messages, agents, "seq", bounds)
    assert counted.where("agents <> seq + 1").isEmpty() and counted.count() == 2000
    plan = counted._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "SinglePartition" not in plan and "collect_list" not in plan


def test_bounds_divide_beyond_the_measured_quantiles(spark, monkeypatch):
    monkeypatch.setattr(ordered, "QUANTILES", 4)
    rows = spark.range(1000).withColumnRenamed("id", "seq")
    bounds = ordered.bucket_bounds(rows, "seq", 50)
    assert len(bounds) >= 20
    placed = ordered.with_bucket(rows, "seq", bounds).groupBy(ordered.BUCKET).count()
    assert placed.agg(F.max("count")).first()[0] <= 80


def test_chain_is_closed_in_few_rounds(spark, monkeypatch):
    rounds = []
    cut = graph.cut_lineage
    monkeypatch.setattr(graph, "cut_lineage", lambda df: rounds.append(1) or cut(df))
    n = 60
    edges = spark.range(n).select(
        F.concat(F.lit("a"), "id").alias("src"), F.concat(F.lit("a"), F.col("id") + 1).alias("dst"), F.col("id").alias("first_seen"))
    pairs = graph.reachable_pairs(edges)
    assert pairs.count() == n * (n + 1) // 2
    assert pairs.where("src = 'a0' AND dst = 'a60'").first()["first_seen"] == n - 1
    assert len(rounds) <= 9
    more = spark.createDataFrame([("b", "a0", 100)], "src string, dst string, first_seen bigint")
    grown = graph.reachable_pairs(edges.unionByName(more), pairs)
    assert grown.where("src = 'b'").count() == n + 1


def test_audit_times_are_utc(spark, tmp_path):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        moment = datetime(2024, 1, 2, 3, 4, 5, tzinfo=timezone.utc)
        audit = spark.createDataFrame([(int(moment.timestamp()), "m", "t")], "s bigint, message_id string, attack_type string")
        files.write_audit(audit.select(F.timestamp_seconds("s").alias("ts"), "message_id", "attack_type"), f"{tmp_path}/audit")
        line = next((tmp_path / "audit").glob("*/*.json")).read_text()
        assert json.loads(line)["ts"].startswith("2024-01-02T03:04:05")
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


MESSAGES = "message_id string, seq bigint, from_agent string, to_agent string, base_suspicion double"


def by_arrival(batches):
    """History and potential of every message, one by one, batch by batch."""
    edges, agents, recent, out = {}, set(), {}, {}
    for batch in batches:
        for seq, a, b, s in sorted(batch):
            edges.setdefault(a, set()).add(b)
            agents |= {a, b}
            recent.setdefault(a, []).append(s)
            seen, todo = set(), [a]
            while todo:
                for x in edges.get(todo.pop(), set()) - seen:
                    seen.add(x)
                    todo.append(x)
            last = recent[a][-10:]
            reach = len(seen - {a}) / (len(agents) - 1) if len(agents) > 1 else 0.0
            out[f"m{seq}"] = (pytest.approx(sum(last) / len(last)), pytest.approx(reach))
    return out


def as_messages(spark, batch):
    return spark.createDataFrame([(f"m{seq}", seq, a, b, s) for seq, a, b, s in batch], MESSAGES)


def test_late_messages_are_screened_by_arrival(spark, few_tasks, tmp_path):
    rng = random.Random(11)
    rows = [(i, f"a{rng.randrange(12)}", f"a{rng.randrange(12)}", rng.random()) for i in range(150)]
    rng.shuffle(rows)  # nearly every message comes after one with a larger order value
    batches = [rows[i:i + 30] for i in range(0, 150, 30)]
    sink = StreamScreening(str(tmp_path))
    for number, batch in enumerate(batches):
        sink(as_messages(spark, batch), number)
    got = {r["message_id"]: (r["suspicion_history"], r["cascade_potential"]) for r in sink.detections(spark).collect()}
    assert got == by_arrival(batches)
    sink(as_messages(spark, batches[-1]), 4)  # a repeated micro-batch gives the same
    assert {r["message_id"]: (r["suspicion_history"], r["cascade_potential"])
            for r in sink.detections(spark).collect()} == got


def test_a_batch_reads_and_writes_its_own(spark, few_tasks, tmp_path):
    """Twenty batches of new agents: what is written doesn't grow with the state."""
    def size(path):
        return sum(f.stat().st_size for f in path.rglob("*.parquet"))

    sink, written = StreamScreening(str(tmp_path)), []
    batches = []
    for number in range(20):
        batches.append([(number * 10 + i, f"g{number}_{i}", f"g{number}_{(i + 1) % 5}", 0.5) for i in range(5)])
        sink(as_messages(spark, batches[-1]), number)
        heads = spark.read.parquet(f"{tmp_path}/state/heads/version={number}").collect()
        level = {r["name"]: r["level"] for r in heads if r["version"] == number}
        written.append((level["pairs"], size(tmp_path / "state" / "pairs" / f"version={number}")))
        live = {r["version"] for r in heads if r["name"] == "pairs"}
        held = {int(p.name.split("=")[1]) for p in (tmp_path / "state" / "pairs").iterdir() if p.name.startswith("version=")}
        assert live <= held and len(held) <= 12  # old versions are removed, few are live
    plain = [n for merged, n in written if merged == 0]
    assert max(plain) < 2 * min(plain) and len(plain) == 15  # every fourth merges
    got = {r["message_id"]: (r["suspicion_history"], r["cascade_potential"]) for r in sink.detections(spark).collect()}
    assert got == by_arrival(batches)


def test_repeats_are_dropped_late_ones_kept(spark, few_tasks, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    stream = spark.readStream.schema(MESSAGES).parquet(str(source))
    sink = StreamScreening(str(tmp_path / "out"))
    for rows in ([(5, "a", "b", 0.5), (6, "b", "c", 0.5)], [(6, "b", "c", 0.5), (2, "a", "c", 1.0)], [(5, "a", "b", 0.5), (1, "a", "b", 0.0)]):
        as_messages(spark, rows).write.mode("append").parquet(str(source))
        start_screening(stream, sink, available_now=True).awaitTermination()
    got = {r["message_id"]: (r["suspicion_history"], r["cascade_potential"]) for r in sink.detections(spark).collect()}
    assert got == by_arrival([[(5, "a", "b", 0.5), (6, "b", "c", 0.5)], [(2, "a", "c", 1.0)], [(1, "a", "b", 0.0)]])
    assert sink.detections(spark).count() == 4


def test_keyed_history(spark, few_tasks, tmp_path):
    rng = random.Random(4)
    rows = [(i, rng.choice(["busy", "busy", "b", None]), "x", None if i % 17 == 5 else rng.random()) for i in range(200)]
    rng.shuffle(rows)
    batches = [rows[:90], rows[90:150], rows[150:]]
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    stream = keyed_history(spark.readStream.schema(MESSAGES).parquet(str(source)), slice_width=25)

    for batch in batches:  # stopped and started again for each
        as_messages(spark, batch).write.mode("append").parquet(str(source))
        with state_store(spark):
            query = stream.writeStream.format("parquet").option("path", str(out)).option(
                "checkpointLocation", f"{tmp_path}/progress").trigger(availableNow=True).start()
        query.awaitTermination()
    got = {r["message_id"]: r["suspicion_history"] for r in spark.read.parquet(str(out)).collect()}
    recent, want = {}, {}
    for batch in batches:
        for seq, a, _, s in sorted(batch, key=lambda r: r[0]):
            last = [v for v in recent.setdefault(a, [])[-9:] + [s] if v is not None]
            recent[a].append(s)
            want[f"m{seq}"] = pytest.approx(sum(last) / len(last)) if last else None
    assert got == want


def test_a_slice_is_one_call_for_all_its_senders():
    rng = random.Random(5)
    rows = pd.DataFrame({"slice": 3, "message_id": [f"m{i}" for i in range(400)], "seq": rng.sample(range(3000, 4000), 400),
                         "from_agent": [rng.choice(["busy"] * 20 + ["a", "b", None]) for _ in range(400)],
                         "base_suspicion": [rng.random() for _ in range(400)], "arrived": pd.Timestamp(0), "at": 0})
    out, = SliceHistory(10).handleInputRows((3,), iter([rows[:150], rows[150:]]), None)
    done, kept = out[out["part"] == 7], out[out["part"] == 0]
    assert len(done) + kept["head"].sum() == 400 and done["sender"].isna().all()
    for name, own in rows.fillna({"from_agent": "none"}).sort_values("seq").groupby("from_agent"):
        means = own["base_suspicion"].rolling(10).mean().to_numpy()
        found = done[done["from_agent"].fillna("none") == name].set_index("message_id")["suspicion_history"]
        assert np.allclose(found.reindex(own["message_id"][9:]), means[9:])
        assert len(kept[kept["from_agent"].fillna("none") == name]) == min(len(own), 18)


OPERATOR = 0  # the one with state comes first


def test_idle_senders_are_forgotten(spark, few_tasks, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    schema = f"{MESSAGES}, at timestamp"
    stream = keyed_history(spark.readStream.schema(schema).parquet(str(source)), idle_seconds=3600, time="at")

    def send(*rows):
        made = spark.createDataFrame([(f"m{q}", q, a, "x", s, h) for q, a, s, h in rows], f"{MESSAGES}, h int")
        made.select("message_id", "seq", "from_agent", "to_agent", "base_suspicion",
                    F.timestamp_seconds((F.col("h") + 1000) * 3600).alias("at")).write.mode("append").parquet(str(source))
        with state_store(spark):
            query = stream.writeStream.format("parquet").option("path", str(out)).option(
                "checkpointLocation", f"{tmp_path}/progress").trigger(availableNow=True).start()
        query.awaitTermination()

    def held():
        state = spark.read.format("statestore").option("operatorId", OPERATOR).option("stateVarName", "recent")
        return {r["sender"] for r in state.load(f"{tmp_path}/progress").select("key.sender").collect()}

    send((1, "a", 1.0, 0), (2, "b", 1.0, 0))
    assert held() == {"a", "b"}
    send((3, "b", 0.0, 1))
    send((4, "b", 0.0, 5), (5, "c", 0.5, 5))  # a has been idle for more than an hour
    assert "a" not in held()
    send((6, "a", 0.0, 6))
    got = {r["message_id"]: r["suspicion_history"] for r in spark.read.parquet(str(out)).collect()}
    assert got["m3"] == 0.5 and got["m6"] == 0.0
