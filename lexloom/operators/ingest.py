"""Idempotent ingest: keyed, hashed, replayable.

A batch is compared with what is stored by one join on (source, external_id);
only new and changed documents go through normalization and the models. Ids
are derived from the key, so a replay writes the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ordered
from .embedding import is_stale

KEY = ["source", "external_id"]
BREAKER = 10
ERROR_CHARS = 1000


def document_id() -> Column:
    return F.sha2(F.concat_ws("\u0000", *KEY), 256)


def chunk_id() -> Column:
    return F.sha2(F.concat_ws("\u0000", F.col("doc_id"), F.col("chunk_index").cast("string")), 256)


def stale_documents(chunks: DataFrame, model: str) -> DataFrame:
    return chunks.where(is_stale(F.col("embedded_with"), model)).select("doc_id").distinct()


def classify(raw: DataFrame, documents: DataFrame, chunks: DataFrame, model: str) -> DataFrame:
    """raw plus outcome: Inserted, Updated, ReEmbedded or Skipped.

    Skipped needs status Indexed, the same hash and no stale chunk (none at all
    counts as clean); the same hash with stale chunks is ReEmbedded.
    """
    stale = stale_documents(chunks, model).withColumn("stale", F.lit(True))
    old = documents.select(*KEY, "doc_id", F.col("content_hash").alias("old_hash"), F.col("status").alias("old_status")).join(stale, "doc_id", "left").drop("doc_id")
    joined = raw.join(old, KEY, "left")
    same = (F.col("old_status") == "Indexed") & (F.col("old_hash") == F.col("content_hash"))
    outcome = F.when(F.col("old_status").isNull(), "Inserted").when(same & F.col("stale").isNull(), "Skipped").when(same, "ReEmbedded").otherwise("Updated")
    return joined.withColumn("outcome", outcome).drop("old_hash", "old_status", "stale")


def skip_set(documents: DataFrame, chunks: DataFrame, source: str, model: str) -> DataFrame:
    """(external_id, content_hash) of clean indexed documents; vectors are never read."""
    ok = documents.where((F.col("source") == source) & (F.col("status") == "Indexed"))
    return ok.join(stale_documents(chunks, model), "doc_id", "left_anti").select("external_id", "content_hash")


def without_skipped(raw: DataFrame, skips: DataFrame, max_items: int | None = None) -> DataFrame:
    """The limit counts skipped documents too, so it comes first."""
    limited = raw if max_items is None else raw.orderBy("external_id").limit(max_items)
    return limited.join(skips, ["external_id", "content_hash"], "left_anti")


def fetch_missing(listing: DataFrame, stored: DataFrame) -> DataFrame:
    """Listed documents that the raw store lacks."""
    return listing.join(stored.select(*KEY), KEY, "left_anti")


def guarded(step: Callable[[dict], dict], stage: str) -> Callable[[dict], dict]:
    """A row function whose errors become a Failed row instead of ending the job."""
    def run(row: dict) -> dict:
        try:
            return step(row) | {"status": "Indexed", "failure_reason": None}
        except Exception as e:  # noqa: BLE001  quarantine takes any error
            return {"status": "Failed", "failure_reason": f"[{stage}] {e}"[:ERROR_CHARS]}

    return run


def quarantine(failed: DataFrame, documents: DataFrame) -> DataFrame:
    """Failed rows with their attempt count raised by one."""
    old = documents.select(*KEY, F.col("attempt_count").alias("old"))
    return failed.join(old, KEY, "left").withColumn("attempt_count", F.coalesce("old", F.lit(0)) + 1).withColumn(
        "failure_reason", F.left("failure_reason", F.lit(ERROR_CHARS))).drop("old")


def upsert_documents(documents: DataFrame, batch: DataFrame) -> DataFrame:
    """Latest row per key: batch rows replace stored ones, the rest stays."""
    return documents.join(batch.select(*KEY), KEY, "left_anti").unionByName(batch, allowMissingColumns=True)


def replace_chunks(chunks: DataFrame, batch_docs: DataFrame, batch_chunks: DataFrame) -> DataFrame:
    """All chunks of the batch's documents are replaced, so none is orphaned."""
    return chunks.join(batch_docs.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(batch_chunks, allowMissingColumns=True)


def orphans(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    return chunks.join(documents.select("doc_id"), "doc_id", "left_anti")


def fail_streaks(outcomes: DataFrame, order: str = "external_id", by: str = "source", failed: str = "outcome = 'Failed'") -> DataFrame:
    """(by, longest): the longest run of failures in order; any other outcome ends a run.

    Runs are numbered by the running count of other outcomes, block by block, so
    a source may hold any share of the rows.
    """
    rows = ordered.deal(outcomes.select(by, order, F.expr(failed).alias("_bad")), [by], [order])
    runs = ordered.running(rows, [by], [order], F.when(F.col("_bad"), 0).otherwise(1), "_island")
    lengths = runs.groupBy(by, "_island").agg(F.count_if("_bad").alias("n"), F.count("*").alias("m"))
    return lengths.groupBy(by).agg(F.max("n").alias("longest"))


def tripped(streaks: DataFrame, limit: int = BREAKER) -> DataFrame:
    """Sources whose breaker opens; a limit of 0 disables it."""
    return streaks.where((F.lit(limit) > 0) & (F.col("longest") >= limit))


def run_summary(outcomes: DataFrame, by: str = "source") -> DataFrame:
    return outcomes.groupBy(by, "outcome").agg(F.count("*").alias("n"))


def same_set(a: Column, b: Column) -> Column:
    empty = F.array().cast("array<string>")
    return F.array_sort(F.array_distinct(F.coalesce(a, empty))) == F.array_sort(F.array_distinct(F.coalesce(b, empty)))


def relink(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored metadata whose consolidated text or amendments changed, with only those two patched.

    Both have (key, consolidated, amendments array<string>).
    """
    f = fresh.select("key", F.col("consolidated").alias("new_consolidated"), F.col("amendments").alias("new_amendments"))
    both = stored.join(f, "key")
    changed = ~F.col("consolidated").eqNullSafe(F.col("new_consolidated")) | ~same_set(F.col("amendments"), F.col("new_amendments"))
    return both.where(changed).withColumns({"consolidated": F.col("new_consolidated"), "amendments": F.array_sort("new_amendments")}).drop("new_consolidated", "new_amendments")
