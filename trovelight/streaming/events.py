"""Event-time operators; each works on a stream or, with the same result, on a batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def watermarked(events: DataFrame, ts: str, delay: str) -> DataFrame:
    return events.withWatermark(ts, delay) if events.isStreaming else events


def rate_limits(events: DataFrame, client: str, ts: str, limit: int = 1000, window: str = "60 seconds", slide: str = "10 seconds", delay: str = "1 minute") -> DataFrame:
    """Sliding windows per client with their requests, and whether they are over the limit."""
    out = watermarked(events, ts, delay).groupBy(F.window(ts, window, slide).alias("w"), client).agg(F.count("*").alias("n"))
    return out.select(client, F.col("w.start").alias("window_start"), "n", (F.col("n") > limit).alias("limited"))


def tumbling_counts(events: DataFrame, ts: str, width: str, *keys: str, delay: str = "10 minutes") -> DataFrame:
    out = watermarked(events, ts, delay).groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("window_start"), *keys, "n")


def first_nonces(events: DataFrame, keys: list[str], ts: str, ttl: str = "10 minutes") -> DataFrame:
    """First use of each nonce: within the watermark on a stream, over all rows on a batch."""
    if events.isStreaming:
        return events.withWatermark(ts, ttl).dropDuplicatesWithinWatermark(keys)
    from trovelight.operators.lifecycle import latest

    return latest(events, keys, F.col(ts), *[F.col(c) for c in events.columns if c != ts and c not in keys][:1])


def timely(events: DataFrame, ts: str, now: Column, minutes: int = 5) -> DataFrame:
    """Rows within so many minutes of the server's clock, either way."""
    return events.filter(F.abs(F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))) <= minutes * 60_000_000)


def sessions(events: DataFrame, key: str, ts: str, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    out = watermarked(events, ts, delay).groupBy(F.session_window(ts, gap).alias("s"), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")


#: Transitions of a task's state.
TRANSITIONS = {None: {"queued"}, "queued": {"running", "cancelled"}, "running": {"paused", "succeeded", "partial", "failed", "cancelled", "queued"}, "paused": {"queued", "running", "cancelled"}, "failed": {"queued"}}


def task_states(events: DataFrame) -> DataFrame:
    """Stateful fold of events(task_id, sequence, state) into task_id, state, n_events, rejected; illegal transitions are counted, not followed."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, n, rejected = state.get if state.exists else (None, 0, 0)
        rows = pd.concat(list(batches)).sort_values("sequence")
        for new in rows["state"]:
            n += 1
            if new in TRANSITIONS.get(now, set()):
                now = new
            else:
                rejected += 1
        state.update((now, n, rejected))
        yield pd.DataFrame({"task_id": [key[0]], "state": [now], "n_events": [n], "rejected": [rejected]})

    schema = "task_id string, state string, n_events long, rejected long"
    return events.groupBy("task_id").applyInPandasWithState(fold, schema, "state string, n_events long, rejected long", "update", GroupStateTimeout.NoTimeout)


def exact_rates(events: DataFrame, client: str, ts: str, limit: int = 1000, seconds: int = 60) -> DataFrame:
    """Batch events with ``n_recent``, the requests of their client in the last ``seconds`` up to them, and whether those are over the limit."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(client).orderBy(micros).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("n_recent", F.count("*").over(w)).withColumn("limited", F.col("n_recent") > limit)
