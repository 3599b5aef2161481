"""Per-message sender context: suspicion history and reach at that moment.

One narrow shuffle by (sender, bucket of order values): a sender with a third
of all messages is spread over many tasks.  What a bucket needs from earlier
ones (the last nine suspicions, the count of agents reached) is one small row.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, Window, functions as F

from parapet.config import DEFAULT, ScreeningConfig
from parapet.operators.graph import agents_of, edge_aggregate, potential, reachable_pairs
from parapet.operators.lineage import cut_lineage
from parapet.operators.reach import reach_estimates
from parapet.operators.ordered import BUCKET, bucket_bounds, match_nulls, running_count, with_bucket


def sender_context(
    messages: DataFrame,
    sender: str = "from_agent",
    order: str = "seq",
    suspicion: str = "base_suspicion",
    pairs: DataFrame | None = None,
    earlier: DataFrame | None = None,
    config: ScreeningConfig = DEFAULT,
    bounds: list[float] | None = None,
) -> DataFrame:
    """Add ``suspicion_history`` and, given reachable pairs, ``reached``.

    History is the mean of the sender's last ten suspicions including the
    current one.  ``reached`` counts the pairs of the sender that exist at the
    message's order value.  Messages without a sender share one history and reach
    nobody; a message without a suspicion doesn't count in the mean.  ``earlier`` holds (sender, recent array) of messages
    before these, for a stream.  Order values are unique.  Needs stored rows when
    they fill several buckets.
    """
    length = config.history_length
    if bounds is None:
        bounds = bucket_bounds(messages, order, config.scale.rows_per_bucket)
    rows = messages.withColumn("_message", F.lit(True))
    if pairs is not None:
        events = pairs.select(F.col("src").alias(sender), F.col("first_seen").alias(order))
        # null in every other column; same order value: the pair counts
        rows = rows.unionByName(
            events.withColumn("_message", F.lit(False)), allowMissingColumns=True
        )
    rows = with_bucket(rows, order, bounds)

    carried = _carried(rows, sender, order, suspicion, length, earlier)
    rows = match_nulls(rows, carried, [sender, BUCKET], "left")
    recent, reached_before = F.col("_recent"), F.coalesce("_reached_before", F.lit(0))

    so_far = Window.partitionBy(sender, BUCKET).orderBy(order, "_message")
    reached = F.count(F.when(~F.col("_message"), 1)).over(
        so_far.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    counted = rows.withColumn("reached", (reached + reached_before).cast("bigint"))
    only = counted.where("_message")

    last = so_far.rowsBetween(-(length - 1), Window.currentRow)
    known = only.withColumns({
        "_n": F.count(suspicion).over(last),
        "_sum": F.sum(suspicion).over(last),
        "_recent": F.coalesce(recent, F.array().cast("array<double>")),
    })
    missing = F.least(F.lit(length) - F.col("_n"), F.size("_recent")).cast("int")
    taken = F.slice("_recent", F.size("_recent") - missing + 1, missing)
    total = F.when(
        missing > 0, F.col("_sum") + F.aggregate(taken, F.lit(0.0), lambda a, x: a + x)
    ).otherwise(F.col("_sum"))
    result = known.withColumn(
        "suspicion_history", total / (F.col("_n") + F.greatest(missing, F.lit(0)))
    )
    added = ["suspicion_history", "reached"] if pairs is not None else ["suspicion_history"]
    return result.select(*messages.columns, *added)


def recent_suspicions(
    rows: DataFrame, keys: list[str], order: str, suspicion: str, count: int
) -> DataFrame:
    """Per key, the last ``count`` suspicions in order, as an array.

    The row limit per key is applied on both sides of the shuffle.
    """
    newest = Window.partitionBy(*keys).orderBy(F.desc(order))
    tail = (
        rows.select(*keys, order, suspicion)
        .withColumn("_place", F.row_number().over(newest))
        .where(F.col("_place") <= count)
    )
    return tail.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct(F.col(order), F.col(suspicion)))).alias("_tail")
    ).select(*keys, F.transform("_tail", lambda x: x[suspicion]).alias("_tail"))


def _carried(
    rows: DataFrame, sender: str, order: str, suspicion: str, length: int,
    earlier: DataFrame | None,
) -> DataFrame:
    """What each (sender, bucket) takes over from before: one row per bucket."""
    tails = recent_suspicions(
        rows.where("_message"), [sender, BUCKET], order, suspicion, length - 1
    )
    steps = rows.groupBy(sender, BUCKET).agg(
        F.count(F.when(~F.col("_message"), 1)).alias("_new")
    )
    by_bucket = Window.partitionBy(sender).orderBy(BUCKET)
    before = steps.withColumn(
        "_reached_before",
        F.coalesce(
            F.sum("_new").over(by_bucket.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ),
    ).drop("_new")
    # every bucket below holds a message, so nine of them hold nine
    window = by_bucket.rowsBetween(-(length - 1), -1)
    joined = F.flatten(F.collect_list("_tail").over(window))
    recents = tails.withColumn("_joined", joined)
    if earlier is not None:
        kept = earlier.select(F.col(sender), F.col("recent").alias("_kept"))
        recents = match_nulls(recents, kept, [sender], "left").withColumn(
            "_joined",
            F.concat(F.coalesce("_kept", F.array().cast("array<double>")), F.col("_joined")),
        )
    recents = recents.select(
        sender, BUCKET,
        F.when(F.size("_joined") > length - 1, F.slice("_joined", -(length - 1), length - 1))
        .otherwise(F.col("_joined")).alias("_recent"),
    )
    return match_nulls(before, recents, [sender, BUCKET], "left")


def suspicion_history(
    messages: DataFrame,
    sender: str = "from_agent",
    order: str = "seq",
    suspicion: str = "base_suspicion",
    config: ScreeningConfig = DEFAULT,
) -> DataFrame:
    """Add the mean of the sender's last ten suspicions."""
    messages = cut_lineage(messages)
    bounds = bucket_bounds(messages, order, config.scale.rows_per_bucket)
    return sender_context(
        messages, sender, order, suspicion, config=config, bounds=bounds
    )


def agent_suspicion(
    messages: DataFrame, sender: str = "from_agent", order: str = "seq",
    suspicion: str = "base_suspicion", config: ScreeningConfig = DEFAULT,
) -> DataFrame:
    """Per sender, the mean of its last ten suspicions at the end of the table."""
    # the last ten are picked per slice of rows first: no sender meets one task whole
    sliced = messages.select(sender, order, suspicion).withColumn(
        "_slice", F.pmod(F.xxhash64(F.col(order)), F.lit(64))
    )
    newest = Window.partitionBy(sender, "_slice").orderBy(F.desc(order))
    few = (
        sliced.withColumn("_place", F.row_number().over(newest))
        .where(F.col("_place") <= config.history_length).drop("_place", "_slice")
    )
    recent = recent_suspicions(few, [sender], order, suspicion, config.history_length)
    total = F.aggregate("_tail", F.lit(0.0), lambda a, x: a + x)
    return recent.select(
        F.col(sender).alias("agent"), (total / F.size("_tail")).alias("suspicion")
    )


def agents_so_far(
    messages: DataFrame, agents: DataFrame, order: str, bounds: list[float],
) -> DataFrame:
    """Add ``agents``: how many agents have appeared up to the message."""
    return running_count(messages, order, agents, "first_seen", "agents", bounds)


def cascade_context(
    messages: DataFrame,
    sender: str = "from_agent",
    target: str = "to_agent",
    order: str = "seq",
    suspicion: str = "base_suspicion",
    config: ScreeningConfig = DEFAULT,
    as_of: bool = True,
    estimated: bool = False,
) -> DataFrame:
    """Add history, potential, risk and the high-risk flag of every message.

    With ``as_of`` the graph a message is scored on is the graph of all
    messages up to and including it; otherwise that of the whole table.  Reach over
    the whole table can be ``estimated`` by sketches, for graphs whose pairs are too
    many to list.
    """
    if as_of and estimated:
        raise ValueError("reach as of each message is exact; estimates are of the whole table")
    messages = cut_lineage(messages)
    edges = cut_lineage(edge_aggregate(messages, sender, target, None, order))
    if estimated:
        bounds = bucket_bounds(messages, order, config.scale.rows_per_bucket)
        history = sender_context(messages, sender, order, suspicion, config=config, bounds=bounds)
        found = reach_estimates(edges).select(F.col("agent").alias(sender), "cascade_potential")
        joined = history.join(found, sender, "left").select(
            *history.columns, F.coalesce("cascade_potential", F.lit(0.0)).alias("cascade_potential"))
        return with_risk(joined, suspicion, config)
    agents = agents_of(edges)
    pairs = reachable_pairs(edges)
    bounds = bucket_bounds(messages, order, config.scale.rows_per_bucket)
    if not as_of:
        return _static_context(messages, agents, pairs, sender, order, suspicion, config, bounds)
    timed = sender_context(
        messages, sender, order, suspicion, pairs, config=config, bounds=bounds
    )
    placed = agents_so_far(timed, agents, order, bounds)
    return with_risk(
        placed.withColumn("cascade_potential", potential(F.col("reached"), F.col("agents")))
        .drop("reached", "agents"),
        suspicion, config,
    )


def _static_context(messages, agents, pairs, sender, order, suspicion, config, bounds):
    history = sender_context(messages, sender, order, suspicion, config=config, bounds=bounds)
    reached = pairs.groupBy(F.col("src").alias(sender)).agg(F.count("*").alias("_reached"))
    total = agents.agg(F.count("*")).scalar()
    joined = history.join(reached, sender, "left").withColumn(
        "cascade_potential", potential(F.col("_reached"), total)
    )
    return with_risk(joined.select(*history.columns, "cascade_potential"), suspicion, config)


def with_risk(
    df: DataFrame, suspicion: str = "base_suspicion", config: ScreeningConfig = DEFAULT
) -> DataFrame:
    """Add the unrounded ``cascade_risk`` and ``high_risk``."""
    combined = (
        F.col(suspicion) * F.lit(config.base_share)
        + F.col("suspicion_history") * F.lit(config.history_share)
    )
    risky = df.withColumn("cascade_risk", combined * F.col("cascade_potential"))
    return risky.withColumn("high_risk", F.col("cascade_risk") >= config.thresholds.cascade)
