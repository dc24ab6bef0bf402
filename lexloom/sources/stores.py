"""Raw store, question sets, PDF files, reports and watermarks."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENVELOPE = """schemaVersion int, source string, externalId string, docType string, contentFormat string, rawContent string, payload string,
  sourceUrl string, sourceModificationDate string, fetchedAt string"""
GOLDEN = """id string, question string, category string, shouldAbstain boolean, expectedEli string, expectedArticle string, expectedCaseNumber string,
  expectedAmendmentEli string, needsLawyer boolean, note string"""
EXAM = """Name string, StanPrawnyNa string, Items array<struct<Nr:int,Pytanie:string,Odpowiedzi:map<string,string>,Prawidlowa:string,
  PodstawaPrawna:string,Zrodlo:string,NrOryginalny:int>>"""


def safe_id(external_id: Column) -> Column:
    """File-name form of an id."""
    return F.regexp_replace(external_id, r"[^\p{L}\p{N}._-]", "_")


def write_raw(df: DataFrame, root: str) -> None:
    """Appends raw documents, partitioned by source; the commit protocol makes it atomic."""
    df.withColumn("fetched_at", F.current_timestamp()).write.mode("append").partitionBy("source").parquet(root)


def read_raw(spark: SparkSession, root: str, source: str | None = None) -> DataFrame:
    """Latest version of each raw document; a source filter prunes partitions."""
    df = spark.read.parquet(root)
    df = df if source is None else df.where(F.col("source") == source)
    others = [c for c in df.columns if c not in ("source", "external_id")]
    return df.groupBy("source", "external_id").agg(F.max_by(F.struct(*others), "fetched_at").alias("v")).select("source", "external_id", "v.*")


def read_envelopes(spark: SparkSession, path: str) -> DataFrame:
    """One JSON file per document, as an older raw store has them."""
    df = spark.read.schema(ENVELOPE).option("multiLine", True).option("recursiveFileLookup", True).json(path)
    return df.select("source", F.col("externalId").alias("external_id"), F.col("docType").alias("doc_type"), F.col("rawContent").alias("raw_content"),
                     F.coalesce("contentFormat", F.lit("html")).alias("content_format"), "payload", F.col("sourceUrl").alias("source_url"),
                     F.to_utc_timestamp(F.try_to_timestamp(F.col("sourceModificationDate")), "UTC").alias("modified"))


def exists(keys: DataFrame, raw: DataFrame) -> DataFrame:
    return keys.join(raw.select("source", "external_id"), ["source", "external_id"], "left_semi")


def golden_set(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.schema(GOLDEN).option("multiLine", True).json(path)
    return df.select("id", "question", "category", F.coalesce("shouldAbstain", F.lit(False)).alias("should_abstain"), F.col("expectedEli").alias("expected_eli"),
                     F.col("expectedArticle").alias("expected_article"), F.col("expectedCaseNumber").alias("expected_case"),
                     F.col("expectedAmendmentEli").alias("expected_amendment"), F.coalesce("needsLawyer", F.lit(False)).alias("needs_lawyer"), "note")


def exam_set(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.schema(EXAM).option("multiLine", True).json(path)
    i = df.select("Name", F.explode("Items").alias("i"))
    return i.select(F.col("Name").alias("exam"), F.col("i.Nr").alias("nr"), F.col("i.Pytanie").alias("question"), F.col("i.Odpowiedzi").alias("options"),
                    F.upper("i.Prawidlowa").alias("key"), F.col("i.PodstawaPrawna").alias("basis"), F.col("i.Zrodlo").alias("origin"))


def pdf_texts(spark: SparkSession, path: str, pages: Callable[[bytes], list[str]]) -> DataFrame:
    """(path, text, error) of PDF files; ``pages`` is the injected page extractor.

    Pages are joined by line breaks; blank texts are errors. Spark's reader does
    not deliver files of no bytes, so they show as missing paths.
    """
    def run(frames):
        for f in frames:
            rows = []
            for p, raw in zip(f["path"], f["content"], strict=True):
                text, error = None, None
                try:
                    text = "\n".join(pages(bytes(raw))) if raw else None
                    error = None if text and not text.isspace() else "no text" if raw else "empty file"
                except Exception as e:  # noqa: BLE001  one bad file is a row
                    error = str(e)
                rows.append((p, None if error else text, error))
            yield pd.DataFrame(rows, columns=["path", "text", "error"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, text string, error string")


def write_failures(outcomes: DataFrame, path: str) -> None:
    """Appends one JSON line per failure; nothing is written without failures."""
    failed = outcomes.where("status = 'Failed'")
    if not failed.isEmpty():
        failed.select("source", "external_id", "failure_reason", F.current_timestamp().alias("at")).write.mode("append").json(path)


def write_exam_report(answers: DataFrame, path: str) -> None:
    answers.write.mode("append").json(path)


def write_watermark(spark: SparkSession, path: str, source: str, run_started) -> None:
    """The start of a run is its source's watermark; appended, the latest wins on reading."""
    spark.range(1).select(F.lit(source).alias("source"), F.lit(run_started).cast("timestamp").alias("watermark")).write.mode("append").parquet(path)


def read_watermarks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).groupBy("source").agg(F.max("watermark").alias("watermark"))
