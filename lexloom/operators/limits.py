"""Request limits as folds over ordered requests.

A denied request does not count, so a plain window count would overstate; each
fold carries what was accepted. Neither a user nor a day nor a window is ever
brought into one task: see ``ordered``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ordered


def sliding_limit(requests: DataFrame, limit: int = 30, seconds: int = 60, user: str = "user_id", at: str = "ts", key: str = "event_id",
                  block_rows: int = ordered.BLOCK_ROWS) -> DataFrame:
    """(user, key, at, accepted): at most ``limit`` accepted requests in any window.

    An accepted request exactly ``seconds`` old still counts. The state is the
    times of the last accepted requests, ``limit`` at most.
    """
    us = seconds * 1_000_000

    def step(recent: list[int], t: int) -> tuple[list[int], bool]:
        recent = [x for x in recent if x >= t - us]
        ok = len(recent) < limit
        return ([*recent, int(t)] if ok else recent), ok

    rows = requests.select(user, key, F.unix_micros(F.col(at).cast("timestamp")).alias("_t"))
    out = ordered.fold(rows, user, "_t", key, step, block_rows)
    return out.select(user, key, F.timestamp_micros("_t").alias(at), "accepted")


def fixed_window_limit(requests: DataFrame, limit: int = 60, width: str = "1 minute", at: str = "ts", key: str = "event_id", by: list[str] = (),
                       block_rows: int = ordered.BLOCK_ROWS) -> DataFrame:
    """Adds window_start and accepted: the first ``limit`` requests of each window."""
    ts = F.col(at).cast("timestamp")
    placed = requests.withColumn("window_start", F.window(ts, width)["start"]).withColumn("_at", ts)
    own, order = ["window_start", *by], ["_at", key]
    counted = ordered.running(ordered.deal(placed, own, order, block_rows), own, order, F.lit(1), "_n")
    return counted.withColumn("accepted", F.col("_n") < limit).drop("_n", "_at", ordered.BLOCK)


def daily_caps(requests: DataFrame, max_chars: int, max_requests: int, max_per_user: int, chars: str = "chars", user: str = "user_id", at: str = "ts",
               key: str = "event_id", block_rows: int = ordered.BLOCK_ROWS) -> DataFrame:
    """(day, key, verdict): per UTC day, output characters, then requests, then requests per user.

    Each cap is checked on what was accepted before; a reached global cap holds
    for the rest of the day. So a user's first ``max_per_user`` requests are the
    candidates, and running sums over candidates decide the rest.
    """
    ts = F.col(at).cast("timestamp")
    rows = requests.select(F.to_date(ts).alias("day"), F.col(key), F.col(user).alias("_u"), F.col(chars).cast("long").alias("_c"), ts.alias("_t"))
    own, order = ["day", "_u"], ["_t", key]
    rows = ordered.running(ordered.deal(rows, own, order, block_rows), own, order, F.lit(1), "_n").withColumn("_k", (F.col("_n") < max_per_user).cast("int")).drop("_n", ordered.BLOCK)
    rows = ordered.deal(rows, ["day"], order, block_rows)
    rows = ordered.running(rows, ["day"], order, F.col("_k"), "_n")
    counted = F.when((F.col("_k") == 1) & (F.col("_n") < max_requests), F.coalesce("_c", F.lit(0))).otherwise(0)
    rows = ordered.running(rows, ["day"], order, counted, "_s")
    verdict = F.when(F.col("_s") >= max_chars, "chars").when(F.col("_n") >= max_requests, "requests").when(F.col("_k") == 0, "user").otherwise("ok")
    return rows.select("day", key, verdict.alias("verdict"))
