"""A batch of questions from text to checked answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_refusal
from ..operators import embedding, grounding, retrieval, structural


def search(chunks: DataFrame, questions: DataFrame, provider: Callable, dim: int, acts: DataFrame | None = None, k: int = 8, per_path: int = 50,
           n_queries: int | None = None, reranker: Callable | None = None, mode: str = "and", filters: dict | None = None,
           unit_norm: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows, signals) for questions (qid, question); acts (external_id, title) enable unit lookup.

    ``filters`` (arguments of ``metadata_filter``) bind ranked chunks; cited units are looked up in all chunks.
    """
    q = embedding.embed_queries(questions, "question", provider, dim)
    units = None
    if acts is not None:
        cited = structural.cited_units(questions)
        units = structural.structural_lookup(cited, structural.resolve_acts(cited.select(F.col("act_hint").alias("hint")), acts, n_queries and n_queries * structural.CITED), chunks)
    return retrieval.hybrid(chunks, q, k, per_path, n_queries, units, reranker, mode, filters=filters, unit_norm=unit_norm)


def answer(chunks: DataFrame, questions: DataFrame, provider: Callable, dim: int, model: Callable, acts: DataFrame | None = None, history: DataFrame | None = None,
           unabsorbed: DataFrame | None = None, k: int = 8, n_queries: int | None = None, threshold: float = 0.55, margin: float = 0.02,
           reranker: Callable | None = None, filters: dict | None = None) -> DataFrame:
    """One row per question: abstained, sources, answer, check, refused.

    With a history (qid, turn, question, answer) every question is also searched
    together with its last two predecessors, and the better variant is used; the
    prompt always has the question as asked.
    """
    options = {"n_queries": n_queries, "reranker": reranker, "filters": filters}
    rows, signals = search(chunks, questions, provider, dim, acts, k, **options)
    if history is not None:
        asked = history.select("qid", F.col("turn").cast("long").alias("turn"), F.col("question").alias("text")).unionByName(
            questions.select("qid", F.lit(1 << 40).alias("turn"), F.col("question").alias("text")))
        wide = structural.followup_text(asked, "qid", "turn").where(F.col("turn") == 1 << 40).select("qid", F.col("contextual").alias("question"))
        rows2, signals2 = search(chunks, wide, provider, dim, acts, k, **options)
        pick = signals.join(signals2.select("qid", F.col("max_similarity").alias("ctx")), "qid").select(
            "qid", structural.pick_contextual(F.col("max_similarity"), F.col("ctx"), margin).alias("use_ctx"), "max_similarity", "ctx")
        rows = rows.join(pick.where("NOT use_ctx").select("qid"), "qid", "left_semi").unionByName(rows2.join(pick.where("use_ctx").select("qid"), "qid", "left_semi"))
        signals = pick.select("qid", F.when(F.col("use_ctx"), F.col("ctx")).otherwise(F.col("max_similarity")).alias("max_similarity"))
    found = rows.select("qid", "id", F.col("rank").alias("pos")).join(chunks.select("id", "external_id", "doc_type", "article_no", "label", "text"), "id")
    counts = found.groupBy("qid").agg(F.count("*").alias("n"))
    gate = questions.join(signals, "qid", "left").join(counts, "qid", "left").withColumn("abstained", grounding.abstain(F.col("max_similarity"), F.col("n"), threshold))
    kept = found.join(gate.where("NOT abstained").select("qid"), "qid", "left_semi")
    if unabsorbed is not None:
        labels = chunks.select("id", "label")
        kept = grounding.append_amendments(kept.drop("label"), structural.cited_units(questions), unabsorbed, chunks.select("id", "external_id", "text")).join(labels, "id")
    prompts = grounding.grounded_prompt(gate.where("NOT abstained").select("qid", "question"), kept, history)
    told = grounding.complete(prompts, model).join(grounding.source_block(kept), "qid")
    told = grounding.validate(told).withColumn("refused", is_refusal(F.col("answer")))
    return gate.select("qid", "question", "max_similarity", "abstained").join(told.drop("messages"), "qid", "left")
