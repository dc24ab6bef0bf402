"""Live request limits with checkpointed state."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_sliding_limit(requests: DataFrame, limit: int = 30, seconds: int = 60, user: str = "user_id", at: str = "ts", key: str = "event_id") -> DataFrame:
    """(user, key, at, accepted) of a stream; per user, the state is at most ``limit`` accepted times.

    Within a micro-batch a user's requests are taken in time order; batches are
    taken as they come, as a live limiter does.
    """
    us = seconds * 1_000_000
    src = requests.select(F.col(user), F.col(key), F.col(at).cast("timestamp").alias(at))
    types = dict(src.dtypes)

    def step(who, frames, state):
        recent = list(state.get[0]) if state.exists else []
        f = pd.concat(list(frames), ignore_index=True).sort_values([at, key], kind="stable")
        ok = []
        for t in f[at].astype("datetime64[us]").astype("int64"):
            recent = [x for x in recent if x >= t - us]
            ok.append(len(recent) < limit)
            if ok[-1]:
                recent.append(int(t))
        state.update((recent,))
        yield pd.DataFrame({user: f[user], key: f[key], at: f[at], "accepted": ok})

    schema = f"`{user}` {types[user]}, `{key}` {types[key]}, `{at}` timestamp, accepted boolean"
    return src.groupBy(user).applyInPandasWithState(step, schema, "recent array<long>", "append", "NoTimeout")


def stream_counts(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes", at: str = "ts", by: str = "event_type") -> DataFrame:
    """Events per window and kind, with a watermark for late data; tumbling unless ``slide`` is given."""
    ts = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    w = F.window(at, width, slide) if slide else F.window(at, width)
    return ts.groupBy(w, by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), by, "n")


def stream_sessions(events: DataFrame, gap: str = "10 minutes", late: str = "10 minutes", at: str = "ts", by: str = "user_id") -> DataFrame:
    """(by, session_start, session_end, n): sessions closed by ``gap`` without events, the end lying ``gap`` after the last.

    Events that come late but above the watermark join and merge sessions; a
    session is given out once the watermark has passed its end.
    """
    ts = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    out = ts.groupBy(F.session_window(at, gap).alias("w"), by).agg(F.count("*").alias("n"))
    return out.select(by, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def stream_dedup(raw: DataFrame, at: str = "modified", late: str = "1 day") -> DataFrame:
    """Repeated deliveries of a document version are dropped within the watermark."""
    return raw.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark(["source", "external_id", "content_hash"])
