"""Screening a stream of messages.

Layers that look at one message run as plain streaming columns.  What needs
earlier messages (sender history, agent graph) is state: small tables of what each
micro-batch added, in the shared folder (``parapet.streaming.deltas``).  A batch reads
what concerns its own senders, and writes what is new.

Messages are registered in order of arrival: micro-batch by micro-batch, and by
``seq`` within one.  So a message that comes late is screened when it comes, with all
that has been seen by then.  A message delivered again within a time is dropped by
the running stream.

Per-key state operators would send all messages of a busy sender through one task;
here each micro-batch is spread by (sender, bucket) as in a batch job.  Where state
operators are wanted, ``parapet.streaming.history`` keeps histories in one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from parapet.config import DEFAULT, ScreeningConfig
from parapet.functions.numbers import round_to
from parapet.operators.fusion import fuse
from parapet.operators.graph import agents_of, edge_aggregate, potential, reachable_pairs
from parapet.operators.lineage import cut_lineage
from parapet.operators.ordered import bucket_bounds, match_nulls
from parapet.operators.routing import STATS, audit_entries, observed_stats, stats_row
from parapet.operators.senders import (
    agents_so_far, recent_suspicions, sender_context, with_risk,
)
from parapet.plans.detect import score_texts
from parapet.plans.layers import Layers
from parapet.streaming.deltas import DeltaState
from parapet.streaming.history import state_store


_BEFORE = -(2**62)  # an order value before those of a batch


def stream_score(
    messages: DataFrame, layers: Layers | None = None, keep: list[str] | None = None
) -> DataFrame:
    """Scores of layers 1 to 3: the same columns as in batch, no state."""
    return score_texts(messages, layers, keep)


def without_repeats(messages: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Drop messages delivered again within ``delay`` of their first arrival.

    The watermark is on the time of arrival, so no message is ever too late for it.
    """
    stamped = messages.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", delay)
    return stamped.dropDuplicatesWithinWatermark(["message_id"]).drop("_arrived")


@dataclass
class StreamScreening:
    """Sink of a screening stream, for ``start_screening`` or ``foreachBatch``.

    ``folder`` gets ``detections``, ``audit`` and ``stats``, a subfolder per micro-batch,
    and ``state``.  Every message of a batch is screened, with the messages before it,
    by arrival, and in a batch by ``seq``.  Without layers the messages bring
    ``base_suspicion`` along and end with their sender context.
    """

    folder: str
    layers: Layers | None = None
    keep: list[str] | None = None
    config: ScreeningConfig = DEFAULT

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        scored = batch if self.layers is None else score_texts(batch, self.layers, self.keep)
        scored = cut_lineage(scored)
        state = DeltaState(batch.sparkSession, f"{self.folder}/state", batch_id)
        bounds = bucket_bounds(scored, "seq", self.config.scale.rows_per_bucket)
        if batch_id > 0 and not bounds:  # nothing came: such a batch moves the watermark on
            state.commit()
            return
        edges = cut_lineage(edge_aggregate(scored).select("src", "dst", "first_seen"))
        senders = cut_lineage(edges.select(F.col("src").alias("from_agent")).distinct())
        known, added = self.update_graph(state, edges)
        earlier = state.newest("history", "from_agent", senders)
        timed = sender_context(scored, pairs=added, earlier=earlier, config=self.config, bounds=bounds)
        if known is not None:
            # pairs of earlier batches exist for every message of this one
            own = known.join(senders, known["src"] == senders["from_agent"], "left_semi")
            counts = own.groupBy("src").agg(F.count("*").alias("_known"))
            timed = timed.join(counts, F.col("from_agent") == F.col("src"), "left").withColumn(
                "reached", F.col("reached") + F.coalesce("_known", F.lit(0))).drop("src", "_known")
        placed = self.count_agents(state, edges, timed, bounds)
        risky = with_risk(
            placed.withColumn("cascade_potential", potential(F.col("reached"), F.col("agents")))
            .drop("reached", "agents"),
            config=self.config,
        )
        if self.layers is None:
            result = risky.withColumn("cascade_score", round_to(F.col("cascade_risk"), 4))
        else:
            result, counters = observed_stats(fuse(risky, self.config))
        path = f"{self.folder}/detections/batch={batch_id}"
        result.write.mode("overwrite").parquet(path)
        if self.layers is not None:
            stored = batch.sparkSession.read.schema(result.schema).parquet(path)
            audit_entries(stored).write.mode("overwrite").json(
                f"{self.folder}/audit/batch={batch_id}"
            )
            stats_row(batch.sparkSession, counters).write.mode("overwrite").parquet(
                f"{self.folder}/stats/batch={batch_id}"
            )
        self.save_history(state, scored, earlier)
        state.commit()

    def update_graph(self, state: DeltaState, found: DataFrame) -> tuple[DataFrame | None, DataFrame]:
        """Pairs of earlier batches that may matter here, and pairs that this batch adds.

        A path that is new holds a new edge (u, v): it goes to u, by known pairs, and on
        from v, by known pairs.  So only pairs into the new edges' sources and out of
        their targets are read, beside those of the batch's senders.  ``found``: its edges.
        """
        ends = found.where(F.col("src") != F.col("dst"))
        edges = state.read("edges", "src", ends.select("src"))
        new = cut_lineage(ends if edges is None else ends.join(edges.select("src", "dst"), ["src", "dst"], "left_anti"))
        starts = found.select("src")
        if new.isEmpty():
            return state.read("pairs", "src", starts), new
        asked = cut_lineage(starts.unionByName(new.select("src")).unionByName(new.select(F.col("dst").alias("src"))).distinct())
        known = state.read("pairs", "src", asked)
        if known is None:
            added = cut_lineage(reachable_pairs(new))
        else:
            known = cut_lineage(known.select("src", "dst"))
            into = state.read("pairs_by_target", "dst", new.select(F.col("src").alias("dst")))
            out = known.join(new.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
            first = F.lit(_BEFORE).alias("first_seen")
            old = out.unionByName(into.select("src", "dst")).distinct().select("src", "dst", first)
            every = reachable_pairs(new, old)
            # what two known pairs make is known, though it wasn't read
            added = cut_lineage(every.where(F.col("first_seen") > F.lit(_BEFORE)).select("src", "dst", "first_seen"))
            more = state.read("pairs", "src", added.select("src"))
            added = cut_lineage(added.join(more.select("src", "dst"), ["src", "dst"], "left_anti"))
        state.add("edges", "src", new.select("src", "dst"))
        if not added.isEmpty():
            state.add("pairs", "src", added.select("src", "dst"))
            state.add("pairs_by_target", "dst", added.select("src", "dst"))
        return known, added

    def count_agents(self, state: DeltaState, edges: DataFrame, timed: DataFrame, bounds: list[float]) -> DataFrame:
        """Add ``agents``: how many have appeared up to the message."""
        mine = agents_of(edges)
        known = state.read("agents", "agent", mine.select("agent"))
        new = mine if known is None else match_nulls(mine, known.select("agent"), ["agent"], "left_anti")
        new = cut_lineage(new)
        total = state.newest("counts", "name", state.spark.createDataFrame([("agents",)], "name string"))
        row = None if total is None else total.first()
        before = 0 if row is None else row["n"]
        more = new.count()
        if not more:
            return timed.withColumn("agents", F.lit(before).cast("bigint"))
        state.add("agents", "agent", new.select("agent"))
        state.add("counts", "name", state.spark.createDataFrame(
            [("agents", before + more)], "name string, n bigint"), replace=True)
        return agents_so_far(timed, new, "seq", bounds).withColumn("agents", F.col("agents") + F.lit(before))

    def save_history(self, state: DeltaState, scored: DataFrame, earlier: DataFrame | None) -> None:
        """The last nine suspicions of the senders of this batch."""
        count = self.config.history_length - 1
        recents = recent_suspicions(scored, ["from_agent"], "seq", "base_suspicion", count).select(
            "from_agent", F.col("_tail").alias("recent"))
        if earlier is not None:
            joined = match_nulls(recents, earlier.select("from_agent", F.col("recent").alias("old")), ["from_agent"], "left")
            both = F.concat(F.coalesce("old", F.array().cast("array<double>")), "recent")
            recents = joined.select("from_agent", F.when(
                F.size(both) > count, F.slice(both, -count, count)).otherwise(both).alias("recent"))
        state.add("history", "from_agent", recents, replace=True)

    def detections(self, spark) -> DataFrame:
        """Everything screened so far, each message once."""
        return spark.read.parquet(f"{self.folder}/detections").drop("batch")

    def stats(self, spark) -> DataFrame:
        """total, flagged and quarantined so far, counted as the detections were written."""
        return spark.read.parquet(f"{self.folder}/stats").agg(*[F.sum(c).alias(c) for c in STATS])

    def audit(self, spark) -> DataFrame:
        from parapet.schemas import AUDIT

        return spark.read.schema(AUDIT).json(f"{self.folder}/audit")


def start_screening(
    messages: DataFrame, sink: StreamScreening, available_now: bool = False,
    repeats: str | None = "1 hour", **trigger: str
) -> StreamingQuery:
    """Start the stream; ``available_now`` stops it once the input is read.

    A message delivered again within ``repeats`` is dropped (None: none is).  The ids seen
    are kept outside the heap.
    """
    if repeats is not None:
        messages = without_repeats(messages, repeats)
    writer = messages.writeStream.foreachBatch(sink).option(
        "checkpointLocation", f"{sink.folder}/progress"
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif trigger:
        writer = writer.trigger(**trigger)
    with state_store(messages.sparkSession):
        return writer.start()
