"""Sliding-window throttle: an event is accepted while fewer than `limit` accepted events
lie in the last `window` seconds.  Rejected events leave no trace."""

from __future__ import annotations

from bisect import insort
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from flowmill.streaming.time import SECOND, as_instant, micros

# Accepted events and seconds of the published limit.
LIMIT, WINDOW_SECONDS = 30, 60


def accept(times: np.ndarray, recent: deque, limit: int, window: int) -> np.ndarray:
    """Decide sorted times in turn; `recent` holds the accepted times in the window, in order, and is
    updated.  An entry exactly one window old still counts, as do accepted entries that lie ahead."""
    accepted = np.zeros(len(times), dtype=bool)
    i = 0
    while i < len(times):
        now = times[i]
        while recent and recent[0] < now - window:
            recent.popleft()
        if len(recent) < limit:
            accepted[i] = True
            insort(recent, int(now))
            i += 1
        else:
            # Nothing is accepted before the oldest entry leaves the window.
            i = max(i + 1, int(np.searchsorted(times, recent[0] + window, side="right"))) if limit else len(times)
    return accepted


def throttle(events: DataFrame, key: str, ts: str, tie: str, limit: int = LIMIT,
             window_seconds: float = WINDOW_SECONDS) -> DataFrame:
    """All events with `accepted`, in the order of (ts, tie) per key.

    Time is cut into bins one window long.  Where a bin and the one before it hold at most
    `limit` events together, all its events are accepted, with no state at all.  Only runs
    of busier bins are decided in sequence, each run starting from the (fully accepted)
    quiet bin before it; so one busy key splits into its separate bursts, and a burst
    streams through its task in sorted batches with a window of times as its only state.

    Events without key or time belong to no window: they are accepted and counted for none.
    """
    window = int(window_seconds * SECOND)
    placed = F.col(key).isNotNull() & F.col(ts).isNotNull()
    timed = events.where(placed).withColumn("_t", micros(events, ts))
    timed = timed.withColumn("_bin", F.floor(F.col("_t") / window))

    counts = timed.groupBy(key, "_bin").agg(F.count("*").alias("_n"))
    in_order = Window.partitionBy(key).orderBy("_bin")
    # lag by value, not by row: the bin before must be the adjacent one.
    adjacent = F.lag("_bin").over(in_order) == F.col("_bin") - 1
    before = F.when(adjacent, F.lag("_n").over(in_order)).otherwise(0)
    bins = counts.withColumn("_busy", F.col("_n") + before > limit)
    rank = F.row_number().over(Window.partitionBy(key, "_busy").orderBy("_bin"))
    bins = bins.withColumn("_run", F.when(F.col("_busy"), F.col("_bin") - rank))
    starts = bins.filter("_busy").groupBy(key, "_run").agg(F.min("_bin").alias("_first"))
    lead_in = starts.select(key, (F.col("_first") - 1).alias("_bin"), F.lit(True).alias("_busy"), "_run",
                            F.lit(True).alias("_lead_in"))
    plan = bins.select(key, "_bin", "_busy", "_run", F.lit(False).alias("_lead_in")).unionByName(lead_in)

    routed = timed.join(plan, [key, "_bin"]).drop("_bin")
    columns = events.columns
    quiet = routed.filter(~F.col("_busy")).select(*columns, F.lit(True).alias("accepted"))

    busy = (
        routed.filter("_busy").drop("_busy").repartition(key, "_run")
        .sortWithinPartitions(key, "_run", "_t", tie))

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, recent = None, deque()
        for batch in batches:
            keys = list(zip(batch[key], batch["_run"]))
            times = batch["_t"].to_numpy()
            accepted = np.zeros(len(batch), dtype=bool)
            edges = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if keys[a] != current:
                    current, recent = keys[a], deque()
                accepted[a:b] = accept(times[a:b], recent, limit, window)
            out = batch[columns].assign(accepted=accepted)
            yield out[~batch["_lead_in"].to_numpy(dtype=bool)]

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema)
    loose = events.where(~placed).select(*columns, F.lit(True).alias("accepted"))
    return quiet.unionByName(busy.mapInPandas(decide, f"{fields}, accepted boolean")).union(loose)


def throttle_stream(events: DataFrame, key: str, ts: str, tie: str, limit: int = LIMIT,
                    window_seconds: float = WINDOW_SECONDS, late_after: str = "1 minute",
                    idle_seconds: int | None = None) -> DataFrame:
    """The same decision on a stream, one row for every event: (key, ts, tie, accepted, late).

    State per key is the accepted times still in the window, at most `limit` of them, in order. A
    micro-batch sorts each key's new events, so its size (maxFilesPerTrigger or the like)
    bounds what a task holds.
    Events behind the watermark come out undecided: accepted is null and late is true. Events without key
    or time belong to no window: they are accepted and not late, without state. With `idle_seconds` a key that is
    quiet for so long in processing time loses its state once the watermark has left its window. That is for streams
    that run on: such a timer keeps an availableNow run from ending. Without it, keys keep their last times.
    """
    window = int(window_seconds * SECOND)
    events = as_instant(events, ts)
    types = dict(events.dtypes)
    placed = F.col(key).isNotNull() & F.col(ts).isNotNull()
    timed = events.select(key, ts, tie, micros(events, ts).alias("_t")).withWatermark(ts, late_after)

    def decide(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = state.getCurrentWatermarkMs() * 1000
        recent = deque(state.get[0]) if state.exists else deque()
        if state.hasTimedOut:
            if not recent or recent[-1] + window < mark:
                state.remove()
            else:
                state.setTimeoutDuration(1000 * idle_seconds)
            return
        rows = pd.concat(list(batches)).sort_values(["_t", tie], kind="stable")
        times = rows["_t"].to_numpy()
        late = times < mark
        decided = np.full(len(rows), None, dtype=object)
        decided[~late] = accept(times[~late], recent, limit, window)
        if recent or state.exists:
            state.update((list(recent),))
            if idle_seconds is not None:
                state.setTimeoutDuration(1000 * idle_seconds)
        yield rows[[key, ts, tie]].assign(accepted=decided, late=late)

    # These timeouts keep late rows in the group; an event-time one would drop them unseen.
    timeout = GroupStateTimeout.NoTimeout if idle_seconds is None else GroupStateTimeout.ProcessingTimeTimeout
    decided = timed.where(placed).groupBy(key).applyInPandasWithState(
        decide, f"{key} {types[key]}, {ts} {types[ts]}, {tie} {types[tie]}, accepted boolean, late boolean",
        "recent array<bigint>", "append", timeout)
    loose = events.where(~placed).select(key, ts, tie, F.lit(True).alias("accepted"), F.lit(False).alias("late"))
    return decided.unionByName(loose)
