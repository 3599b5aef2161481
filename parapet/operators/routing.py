"""What happens to screened messages: pass, quarantine, audit, alert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from parapet import fixed_values as fv
from parapet.config import DEFAULT
from parapet.functions.text import preview


def route(detections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(passed, quarantined).  Hand in stored rows if both are written."""
    return detections.where(~F.col("quarantined")), detections.where("quarantined")


def audit_entries(detections: DataFrame, time: str = "ts") -> DataFrame:
    """The audit rows of quarantined messages.

    Takes the preview a screening job made, or makes it from ``content``.
    """
    if "content_preview" in detections.columns:
        head = F.col("content_preview")
    else:
        head = preview(F.col("content"), fv.AUDIT_PREVIEW_CHARS)
    stamp = F.col(time) if time in detections.columns else F.current_timestamp()
    return detections.where("quarantined").select(
        stamp.alias("ts"), "message_id", "from_agent", "to_agent",
        F.col("predicted_type").alias("attack_type"), "confidence",
        head.alias("content_preview"),
    )


def quarantine_summary(detections: DataFrame) -> DataFrame:
    """Quarantined messages in total and per predicted type."""
    return (
        detections.where("quarantined")
        .groupingSets([[], [F.col("predicted_type")]], F.col("predicted_type"))
        .agg(F.count("*").alias("n"))
        .select(F.coalesce("predicted_type", F.lit("total")).alias("predicted_type"), "n")
    )


def recent_quarantined(
    detections: DataFrame, count: int = fv.RECENT_LENGTH,
    queue: int = DEFAULT.queue_length, order: str = "seq",
) -> DataFrame:
    """The newest quarantined messages, oldest first; the queue keeps 500."""
    newest = detections.where("quarantined").orderBy(F.desc(order)).limit(min(count, queue))
    return newest.orderBy(order)


STATS = ["total", "flagged", "quarantined"]


def _counters() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("is_injected")).alias("flagged"),
        F.count_if(F.col("quarantined")).alias("quarantined"),
    ]


def run_stats(detections: DataFrame) -> DataFrame:
    return detections.agg(*_counters())


def observed_stats(detections: DataFrame) -> tuple[DataFrame, Observation]:
    """The detections, and the counters of ``run_stats`` as they pass.

    The first action on the detections fills the counters; there is no second pass.
    A limit above would see fewer rows: act on the whole.
    """
    counters = Observation()
    return detections.observe(counters, *_counters()), counters


def watched_stream(detections: DataFrame, name: str = "screening") -> DataFrame:
    """The same for a running stream, whose progress reports the counters of each
    micro-batch under ``name`` (``query.recentProgress``, ``observedMetrics``)."""
    return detections.observe(name, *_counters())


def stats_row(spark: SparkSession, counters: Observation) -> DataFrame:
    """The counters of an action that is done, as one row."""
    found = counters.get
    return spark.createDataFrame(
        [tuple(found[c] for c in STATS)], ", ".join(f"{c} bigint" for c in STATS))


def alert_text(kind: Column, confidence: Column, reason: Column) -> Column:
    from parapet.functions.numbers import round_to

    percent = F.format_string("%.2f", round_to(confidence * 100.0, 2))
    return F.concat(
        F.lit(fv.ALERT_TYPE), kind, F.lit(fv.ALERT_CONFIDENCE), percent, F.lit(fv.ALERT_REASON), reason,
    )


def newest_messages(messages: DataFrame, conversation: str, order: str) -> DataFrame:
    """The last message of every conversation, unless it is blank: such a message
    is neither screened nor remembered.

    The newest order value is found on narrow rows; texts only meet it in the join.
    """
    newest = messages.groupBy(conversation).agg(F.max(order).alias("_newest")).withColumnRenamed(
        conversation, "_conversation"
    )
    same = F.col(conversation).eqNullSafe(F.col("_conversation")) & (F.col(order) == F.col("_newest"))
    return messages.join(newest, same).where(F.trim("content") != "").select(*messages.columns)


def guard_last_message(detections: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """Reply for the newest message of each conversation: an alert in place of
    the text if it is blocked, nothing otherwise."""
    text = "content" if "content" in detections.columns else "content_preview"
    blocked = F.col("is_injected") & (F.length(text) > 0)
    return detections.select(
        conversation, "message_id", blocked.alias("blocked"),
        F.when(
            blocked,
            alert_text(F.col("predicted_type"), F.col("confidence"), F.col("explanation")),
        ).alias("reply"),
    )


def halt_downstream(
    detections: DataFrame, conversation: str = "conv_id", order: str = "seq"
) -> DataFrame:
    """Keep each conversation up to its first blocked message, which carries
    the block marker.

    The first blocked position is a partial aggregate; the join side holds
    blocked conversations only.
    """
    stops = detections.where("is_injected").groupBy(conversation).agg(
        F.min(order).alias("_stop")
    )
    joined = detections.join(stops, conversation, "left").where(
        F.col("_stop").isNull() | (F.col(order) <= F.col("_stop"))
    )
    marker = F.struct(
        F.lit(True).alias("blocked"), F.col("predicted_type").alias("attack_type"),
        F.col("confidence"), F.col("explanation"),
    )
    return joined.withColumn("alert", F.when(F.col(order) == F.col("_stop"), marker)).drop("_stop")


def result_view(detections: DataFrame, order: str = "seq", count: int | None = None) -> DataFrame:
    """Rows for a step or log table; with ``count`` only the newest."""
    if count is not None:
        detections = detections.orderBy(F.desc(order)).limit(count)
    if "step_preview" in detections.columns:
        text = F.col("step_preview")
    elif "content" in detections.columns:
        text = preview(F.col("content"), fv.STEP_PREVIEW_CHARS)
    else:
        text = F.col("content_preview")
    return detections.select(
        F.col(order).alias("step"), F.col("from_agent").alias("sender"),
        F.col("to_agent").alias("receiver"),
        F.when(F.col("is_injected"), "BLOCKED").otherwise("PASSED").alias("status"),
        F.col("predicted_type").alias("attack_pred"), "confidence", text.alias("content"),
    )


def quarantine_rate(
    detections: DataFrame, time: str = "ts", width: str = "1 hour", watermark: str | None = None
) -> DataFrame:
    """Messages and quarantined messages per time window and predicted type."""
    rows = detections.withWatermark(time, watermark) if watermark else detections
    return rows.groupBy(
        F.window(time, width).alias("w"), "predicted_type"
    ).agg(
        F.count("*").alias("n"), F.count_if(F.col("quarantined")).alias("quarantined")
    ).select(F.col("w.start").alias("window_start"), "predicted_type", "n", "quarantined")
