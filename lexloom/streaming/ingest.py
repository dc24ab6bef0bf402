"""Micro-batch ingest: each batch is an idempotent keyed upsert."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..operators.ingest import BREAKER, fail_streaks, tripped


def ingest_stream(raw: DataFrame, process: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame, int], None], checkpoint: str, breaker: int = BREAKER):
    """Runs ``process`` and ``write`` per batch; a tripped breaker ends the query.

    ``process`` returns one row per document with source, external_id and
    outcome; replays of a batch are harmless because writes are keyed.
    """
    def batch(df: DataFrame, number: int) -> None:
        done = process(df).persist()
        try:
            write(done, number)
            bad = tripped(fail_streaks(done), breaker).first()
            if bad is not None:
                raise RuntimeError(f"{bad['longest']} failures in a row in {bad['source']}")
        finally:
            done.unpersist()

    return raw.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
