"""Jobs from raw documents to chunks: fetch, process, report, relink.

``process`` works on frames, ``process_into`` on a snapshot store in ordered
waves. A document that cannot be processed is quarantined: it has the outcome
Failed, its stored row gets the reason and one more attempt, its stored chunks
stay. A breaker ends a run after a number of failures in a row.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import content_hash
from ..operators import chunking, embedding, ingest, normalize
from ..operators.ingest import BREAKER, KEY
from ..sources import stores
from ..sources.snapshots import Change, SnapshotStore
from ..sources.workspace import shared_folder

#: Fixed value: title of a document that failed before it had one.
FAILED_TITLE = "(błąd ingestii)"
#: Raw documents of a wave, about.
WAVE_ROWS = 50_000
DOCUMENT = """source string, external_id string, doc_id string, doc_type string, title string, source_url string, content_hash string, court_type string,
  judgment_date date, in_force boolean, year int, quality_issues array<string>, typed_metadata string, status string, attempt_count int, failure_reason string"""
CHUNK = """doc_id string, chunk_id string, chunk_index int, text string, char_start int, char_end int, token_count int, label string, article_no string,
  paragraph string, point string, embedding array<float>, embedded_with string"""


def normalized(raw: DataFrame) -> DataFrame:
    """Judgments and acts through their own normalizers, one result schema; ``error`` for what no normalizer took."""
    j = normalize.normalize_judgments(raw.where("doc_type = 'judgment'"))
    a = normalize.normalize_acts(raw.where("doc_type = 'act'"))
    seg = "transform(segments, s -> struct(s.text AS text, s.label AS label, s.char_start AS char_start, {0} AS article, {1} AS paragraph, {2} AS point, {3} AS anchor))"
    none = ["CAST(NULL AS string)"] * 4
    j = j.withColumn("segments", F.expr(seg.format(*none)))
    a = a.withColumn("segments", F.expr(seg.format("s.article", "s.paragraph", "s.point", "s.anchor")))
    other = raw.where("doc_type IS NULL OR doc_type NOT IN ('judgment', 'act')").select(
        *KEY, "doc_type", "source_url", content_hash(F.col("raw_content")).alias("content_hash"),
        F.concat(F.lit("no normalizer for type "), F.coalesce("doc_type", F.lit("null"))).alias("error"))
    out = j.unionByName(a).unionByName(other, allowMissingColumns=True)
    return out.withColumn("doc_id", ingest.document_id()).withColumn("year", F.year("judgment_date"))


def chunked(docs: DataFrame, options: chunking.ChunkOptions | None = None, count: Callable = chunking.count_words, errors: str | None = None) -> DataFrame:
    """Chunks with their unit's locator fields."""
    s = docs.select("doc_id", F.posexplode("segments").alias("seg", "s")).select("doc_id", "seg", "s.text", "s.char_start", "s.label", "s.article", "s.paragraph", "s.point")
    out = chunking.chunk_segments(s, options, count, carry=["label", "article", "paragraph", "point"], errors=errors)
    return out.withColumn("chunk_id", ingest.chunk_id()).withColumnRenamed("article", "article_no")


def staged(df: DataFrame, name: str, *metrics) -> tuple[DataFrame, dict]:
    """``df`` written once and read again, and metrics observed while it was written."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession, name)
    seen = Observation(f"{name}-{uuid.uuid4().hex[:8]}")
    (df.observe(seen, *metrics) if metrics else df).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), dict(seen.get) if metrics else {}


@dataclass(frozen=True)
class Batch:
    """What one batch does: outcomes (key, doc_id, outcome, failure_reason), stored document rows, and chunks that replace those of ``touched`` (doc_id)."""

    outcomes: DataFrame
    documents: DataFrame
    touched: DataFrame
    chunks: DataFrame
    metrics: dict = field(default_factory=dict)


def process_batch(raw: DataFrame, documents: DataFrame, chunks: DataFrame, provider: Callable, dim: int, model: str,
                  options: chunking.ChunkOptions | None = None, count: Callable = chunking.count_words) -> Batch:
    """New and changed documents are normalized, chunked and embedded, each once; documents
    of another model only have their chunks embedded again; others are skipped."""
    hashed = raw.withColumn("content_hash", content_hash(F.col("raw_content")))
    marked = ingest.classify(hashed, documents, chunks, model).withColumn("doc_id", ingest.document_id())
    docs, parsed = staged(normalized(marked.where("outcome IN ('Inserted', 'Updated')").drop("doc_id")), "normalized", F.count("*").alias("documents"), F.count("error").alias("unparsed"))
    made = chunked(docs.where("error IS NULL"), options, count, errors="chunk_error")
    new, cut = staged(embedding.embed_passages(made, "text", provider, dim, model, errors="embed_error"), "embedded",
                      F.count("text").alias("chunks"), F.count("chunk_error").alias("uncut"), F.count("embed_error").alias("unembedded"))
    stale = marked.where("outcome = 'ReEmbedded'").select("doc_id")
    again, renewed = staged(embedding.reembed_stale(chunks.join(stale, "doc_id", "left_semi"), provider, dim, model, errors="embed_error"), "reembedded", F.count("*").alias("renewed"))
    reason = lambda stage, col: F.concat(F.lit(f"[{stage}] "), F.col(col)).alias("failure_reason")
    failed = (docs.where("error IS NOT NULL").select("doc_id", reason("normalize", "error"))
              .unionByName(new.where("chunk_error IS NOT NULL").select("doc_id", reason("chunk", "chunk_error")))
              .unionByName(new.where("embed_error IS NOT NULL").select("doc_id", reason("embed", "embed_error")))
              .unionByName(again.where("embed_error IS NOT NULL").select("doc_id", reason("re-embed", "embed_error"))))
    failed = failed.groupBy("doc_id").agg(F.left(F.min("failure_reason"), F.lit(ingest.ERROR_CHARS)).alias("failure_reason"))
    outcomes, _ = staged(marked.join(failed, "doc_id", "left").select(
        *KEY, "doc_id", "doc_type", "content_hash", F.when(F.col("failure_reason").isNotNull(), "Failed").otherwise(F.col("outcome")).alias("outcome"), "failure_reason"), "outcomes")
    bad = outcomes.where("outcome = 'Failed'")
    attempts = F.col("attempt_count") if "attempt_count" in documents.columns else F.lit(0)
    old = documents.select(*KEY, attempts.alias("attempt_count"))
    good = docs.join(bad.select("doc_id"), "doc_id", "left_anti").drop("segments", "plain_text", "error").withColumns({"status": F.lit("Indexed"), "failure_reason": F.lit(None).cast("string")})
    good = good.join(old, KEY, "left").withColumn("attempt_count", F.coalesce("attempt_count", F.lit(0)))
    known = documents.drop("status", "failure_reason", "attempt_count").join(bad.select(*KEY), KEY, "left_semi")
    fresh = bad.join(documents.select(*KEY), KEY, "left_anti").select(*KEY, "doc_id", "doc_type", "content_hash", F.lit(FAILED_TITLE).alias("title"))
    rows = known.unionByName(fresh, allowMissingColumns=True).join(bad.select(*KEY, "failure_reason"), KEY).withColumn("status", F.lit("Failed"))
    rows = ingest.quarantine(rows, old)
    touched = good.select("doc_id").unionByName(outcomes.where("outcome = 'ReEmbedded'").select("doc_id"))
    made = new.drop("chunk_error", "embed_error").unionByName(again.drop("embed_error"), allowMissingColumns=True).join(touched, "doc_id", "left_semi")
    return Batch(outcomes, good.unionByName(rows, allowMissingColumns=True), touched, made, parsed | cut | renewed)


def process(raw: DataFrame, documents: DataFrame, chunks: DataFrame, provider: Callable, dim: int, model: str, max_items: int | None = None,
            options: chunking.ChunkOptions | None = None, count: Callable = chunking.count_words) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(outcomes, documents, chunks) after one batch of raw documents."""
    raw = raw if max_items is None else raw.orderBy("external_id").limit(max_items)
    b = process_batch(raw, documents, chunks, provider, dim, model, options, count)
    return b.outcomes.select(*KEY, "outcome", "failure_reason"), ingest.upsert_documents(documents, b.documents), ingest.replace_chunks(chunks, b.touched, b.chunks)


@dataclass(frozen=True)
class Run:
    """Counts of a run's outcomes, summed metrics, the store's version, and why it was ended, if it was."""

    outcomes: dict[str, int]
    metrics: dict[str, int]
    version: int
    aborted: str | None


def document_store(spark: SparkSession, root: str, buckets: int = 64) -> SnapshotStore:
    return SnapshotStore(spark, root, {"documents": "doc_id", "chunks": "doc_id"}, buckets)


def trip_point(outcomes: DataFrame, streaks: dict[str, int], limit: int) -> tuple[DataFrame, dict[str, int]]:
    """(the row that completes ``limit`` failures in a row, if there is one; the open streaks after these rows).

    ``streaks``: failures in a row that precede these rows, by source. Rows are
    ordered by their id within a source; a wave bounds them.
    """
    over = W.partitionBy("source").orderBy("external_id")
    ok = F.when(F.col("outcome") != "Failed", 1).otherwise(0)
    carried = F.create_map(*[F.lit(v) for kv in streaks.items() for v in kv])[F.col("source")] if streaks else F.lit(None)
    runs = outcomes.withColumn("island", F.sum(ok).over(over)).withColumn("failed", (F.col("outcome") == "Failed").cast("int"))
    streak = F.sum("failed").over(W.partitionBy("source", "island").orderBy("external_id")) + F.when(F.col("island") == 0, F.coalesce(carried, F.lit(0))).otherwise(0)
    runs = runs.withColumn("streak", F.when(F.col("failed") == 1, streak).otherwise(0))
    trips = runs.where((F.lit(limit) > 0) & (F.col("streak") == limit) & (F.col("failed") == 1)).orderBy(*KEY).limit(1)
    last = runs.groupBy("source").agg(F.max_by("streak", "external_id").alias("n"))  # a row a source
    return trips, {r["source"]: int(r["n"]) for r in last.collect()}


def process_into(store: SnapshotStore, raw: DataFrame, provider: Callable, dim: int, model: str, breaker: int = BREAKER, wave_rows: int = WAVE_ROWS, max_items: int | None = None,
                 options: chunking.ChunkOptions | None = None, count: Callable = chunking.count_words, run: str | None = None) -> Run:
    """Raw documents into the store's documents and chunks, in waves ordered by key.

    Each wave is one commit of both tables. When ``breaker`` documents in a row
    have failed (0: never), the wave is cut after the last of them, what precedes
    is committed, and nothing later is processed; a run after the repair skips
    what is done and takes failed documents again.
    """
    spark, run = raw.sparkSession, run or uuid.uuid4().hex
    raw = raw if max_items is None else raw.orderBy(*KEY).limit(max_items)
    waves = max(1, -(-raw.count() // wave_rows))
    dealt = raw.repartitionByRange(waves, *KEY).withColumn("wave", F.spark_partition_id())
    path = shared_folder(spark, "waves")
    dealt.write.partitionBy("wave").option("compression", "zstd").parquet(path)
    dealt = spark.read.schema(dealt.schema).parquet(path)
    counts: dict[str, int] = {}
    metrics: dict[str, int] = {}
    streaks: dict[str, int] = {}
    version = store.manifest()["version"]
    for wave in range(waves):
        documents = store.read("documents", schema=spark.createDataFrame([], DOCUMENT).schema)
        chunks = store.read("chunks", schema=spark.createDataFrame([], CHUNK).schema)
        b = process_batch(dealt.where(F.col("wave") == wave).drop("wave"), documents, chunks, provider, dim, model, options, count)
        trips, open_ = trip_point(b.outcomes, streaks, breaker)
        trip = trips.first()
        streaks |= open_
        keep = b.outcomes
        if trip is not None:
            keep = keep.where((F.col("source") < trip["source"]) | ((F.col("source") == trip["source"]) & (F.col("external_id") <= trip["external_id"])))
        ids = keep.select("doc_id")
        only = lambda df: df if trip is None else df.join(ids, "doc_id", "left_semi")  # noqa: E731,B023
        changed = only(b.documents)
        version = store.commit(run, wave, {"documents": Change(changed.select("doc_id"), changed), "chunks": Change(only(b.touched), only(b.chunks))})
        for r in keep.groupBy("outcome").count().collect():
            counts[r["outcome"]] = counts.get(r["outcome"], 0) + r["count"]
        for k, v in b.metrics.items():
            metrics[k] = metrics.get(k, 0) + v
        if trip is not None:
            return Run(counts, metrics, version, f"{breaker} failures in a row, the last {trip['source']}/{trip['external_id']}: {trip['failure_reason']}")
    return Run(counts, metrics, version, None)


def fetch(spark: SparkSession, listing: DataFrame, root: str) -> int:
    """Stores listed documents that are missing; returns how many."""
    try:
        stored = stores.read_raw(spark, root)
        missing = ingest.fetch_missing(listing, stored)
    except Exception as e:  # noqa: BLE001  an absent store is an empty one
        if "PATH_NOT_FOUND" not in str(e):
            raise
        missing = listing
    missing = missing.persist()
    try:
        n = missing.count()
        if n:
            stores.write_raw(missing, root)
        return n
    finally:
        missing.unpersist()


def report(raw: DataFrame) -> DataFrame:
    return normalize.quality_report(normalized(raw).where("error IS NULL"))
