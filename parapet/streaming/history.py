"""Sender history in keyed state.

Two state operators in a row.  The first gets slices of order values: the messages of a
micro-batch are spread over them, a busy sender's too.  It finishes every message with nine
others of its sender and slice before it, and hands on a sender's first and last nine
messages of the slice.  The second gets those by sender, eighteen a slice at most, keeps
the last nine suspicions as list state, and finishes the slices' first messages; finished
ones pass it by slice, without state.  A timer empties the state of a sender that sends
nothing for a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor

from parapet.config import DEFAULT, ScreeningConfig

SLICE = 100_000
SLICED = ["sender", "part", "from_agent", "slice", "message_id", "seq", "base_suspicion", "suspicion_history",
          "head", "arrived", "at"]
FINISHED = ["message_id", "from_agent", "seq", "base_suspicion", "suspicion_history"]
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _means(values: np.ndarray, front: np.ndarray, length: int) -> np.ndarray:
    """The mean of the last ``length`` values up to each one, of which ``front`` come before
    it.  A missing value takes its place but doesn't count."""
    n = len(values)
    total, known = np.zeros(n), np.zeros(n)
    for lag in range(min(length, n) - 1, -1, -1):
        counted = (front[lag:] >= lag) & ~np.isnan(values[:n - lag])
        total[lag:] += np.where(counted, values[:n - lag], 0.0)
        known[lag:] += counted
    return np.where(known > 0, total / np.maximum(known, 1), np.nan)


class SliceHistory(StatefulProcessor):
    """By slice: what the slice's own messages settle.  Keeps no state."""

    def __init__(self, length: int):
        self.length = length

    def init(self, handle) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        own = pd.concat(list(rows))
        codes = pd.factorize(own["from_agent"])[0]  # no sender is one like others
        order = np.lexsort((own["seq"].to_numpy(), codes))
        own, codes = own.iloc[order], codes[order]
        first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
        counts = np.diff(np.r_[first, len(codes)])
        front = np.arange(len(codes)) - np.repeat(first, counts)
        back = np.repeat(counts, counts) - 1 - front
        values, before = own["base_suspicion"].to_numpy(float, na_value=np.nan), self.length - 1
        head = front < before
        own = own.assign(suspicion_history=_means(values, front, self.length), head=head)
        done = own[~head].assign(sender=None, part=2 * key[0] + 1)  # odd: never that of the others
        yield pd.concat([done, own[head | (back < before)].assign(sender=lambda x: x["from_agent"], part=0)])[SLICED]


class SenderHistory(StatefulProcessor):
    """By (sender, part): part 0 has what needs the sender's state, others pass."""

    def __init__(self, length: int, idle_ms: int):
        self.length, self.idle_ms = length, idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.recent = handle.getListState("recent", "suspicion double")
        self.until = handle.getValueState("until", "at bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if key[1]:
            for own in rows:
                yield own[FINISHED]
            return
        own = pd.concat(list(rows))
        own = own.iloc[np.lexsort((own["seq"].to_numpy(), own["slice"].to_numpy()))]
        recent = np.array([np.nan if r[0] is None else r[0] for r in self.recent.get()], float)
        values = np.r_[recent, own["base_suspicion"].to_numpy(float, na_value=np.nan)]
        means = _means(values, np.arange(len(values)), self.length)[len(recent):]
        last = values[-(self.length - 1):] if self.length > 1 else values[:0]
        self.recent.put([(None if np.isnan(v) else float(v),) for v in last])
        at = int(own["at"].max()) + self.idle_ms
        if self.until.exists():
            self.handle.deleteTimer(self.until.get()[0])
        self.handle.registerTimer(at)
        self.until.update((at,))
        yield own.assign(suspicion_history=means)[own["head"].to_numpy(bool)][FINISHED]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.recent.clear()
        self.until.clear()
        return iter([])


def keyed_history(
    messages: DataFrame, idle_seconds: int = 7 * 86_400, slice_width: int = SLICE, time: str | None = None,
    delay: str = "0 seconds", config: ScreeningConfig = DEFAULT,
) -> DataFrame:
    """message_id, from_agent, seq, base_suspicion and suspicion_history of a stream.

    History is the mean of the sender's last ten suspicions including the current one,
    by arrival: micro-batch by micro-batch, and by ``seq`` within one.  Messages without a
    sender share one; a missing suspicion takes its place but doesn't count in the mean.
    ``slice_width`` order values are one slice.

    A sender that sends nothing for ``idle_seconds`` is forgotten.  Time is that of
    arrival, for which no message is late; with ``time``, a timestamp column, it is the
    messages' own, and the state operator drops what is more than ``delay`` late.
    """
    arrived = F.current_timestamp() if time is None else F.col(time).cast("timestamp")
    rows = messages.select(
        "message_id", "from_agent", F.col("seq").cast("bigint").alias("seq"),
        F.col("base_suspicion").cast("double").alias("base_suspicion"), arrived.alias("arrived"),
        F.unix_millis(arrived).alias("at"),
        F.floor(F.col("seq") / F.lit(slice_width)).cast("bigint").alias("slice"),
    ).withWatermark("arrived", delay)
    length = config.history_length
    sliced = rows.groupBy("slice").transformWithStateInPandas(
        SliceHistory(length),
        "sender string, part bigint, from_agent string, slice bigint, message_id string, seq bigint, "
        "base_suspicion double, suspicion_history double, head boolean, arrived timestamp, at bigint",
        "Append", "EventTime", eventTimeColumnName="arrived")
    merged = sliced.groupBy("sender", "part").transformWithStateInPandas(
        SenderHistory(length, 1000 * idle_seconds),
        "message_id string, from_agent string, seq bigint, base_suspicion double, suspicion_history double",
        "Append", "EventTime")
    return merged.select("message_id", "from_agent", "seq", "base_suspicion", "suspicion_history")


@contextmanager
def state_store(spark):
    """Start queries with state operators inside: sets the store they need, and puts the
    session's own setting back.  A running query keeps what it was started with."""
    own = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        if own is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, own)
