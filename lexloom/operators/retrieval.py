"""Hybrid retrieval for whole batches of questions.

``queries`` has one row per question; every operator keeps ``qid`` as its key,
so one question is a batch of one. Scores are rounded before they are ordered,
and every order ends in the id, so results do not depend on the plan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import dedup_key, tokens
from .embedding import rerank

K_RRF = 60
OVERFETCH = 4
K1, B = 1.2, 0.75
#: Estimated bytes up to which a batch of questions is broadcast.
BROADCAST_BYTES = 64 << 20
#: Terms of a batch that become a filter of the words; a larger batch is joined.
FILTER_TERMS = 1000
STRUCTURAL_SCORE = 1.7976931348623157e308


def metadata_filter(chunks: DataFrame, court_type=None, date_from=None, date_to=None, only_in_force=False, min_tokens=0) -> DataFrame:
    """SQL semantics: null dates fail a date filter, acts of unknown force fail ``only_in_force``."""
    out = chunks
    if court_type is not None:
        out = out.where(F.col("court_type") == court_type)
    if date_from is not None:
        out = out.where(F.col("judgment_date") >= F.lit(date_from).cast("date"))
    if date_to is not None:
        out = out.where(F.col("judgment_date") <= F.lit(date_to).cast("date"))
    if only_in_force:
        out = out.where((F.col("doc_type") != "act") | F.col("in_force"))
    if min_tokens > 0:
        out = out.where(F.col("token_count") >= min_tokens)
    return out


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def top_k(df: DataFrame, k: int, key: str, *order: Column, rank: str = "rank") -> DataFrame:
    """The first k rows of each key; Catalyst limits groups before the shuffle."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col(rank) <= k)


def small_side(df: DataFrame, n_queries: int | None, bytes_per_query: int = 8192) -> DataFrame:
    """Broadcast hint only for a batch whose size is known to be small; else the optimizer decides."""
    return F.broadcast(df) if n_queries is not None and n_queries * bytes_per_query <= BROADCAST_BYTES else df


def dense_topk(chunks: DataFrame, queries: DataFrame, k: int = 50, n_queries: int | None = None, digits: int = 9, unit_norm: bool = True) -> DataFrame:
    """Exact search: (qid, id, sim, rank). chunks (id, embedding); queries (qid, query_vector).

    Every chunk meets every question of the stated batch once; the ranking keeps
    k rows per question and task before anything is shuffled.
    """
    score = dot if unit_norm else cosine
    pairs = chunks.where("embedding IS NOT NULL").select("id", "embedding").crossJoin(small_side(queries.select("qid", "query_vector"), n_queries))
    scored = pairs.select("qid", "id", F.round(score(F.col("embedding"), F.col("query_vector")), digits).alias("sim"))
    return top_k(scored, k, "qid", F.desc("sim"), F.asc("id"))


def fit_cells(chunks: DataFrame, cells: int = 64, sample: int = 20_000, rounds: int = 8, seed: int = 1) -> list[list[float]]:
    """Centres of k-means cells from a bounded sample, for optional pruning."""
    import numpy as np

    rows = chunks.where("embedding IS NOT NULL").orderBy(F.xxhash64("id", F.lit(seed))).limit(sample).select("embedding").collect()
    if not rows:
        return []
    x = np.array([r[0] for r in rows], float)
    centres = x[: min(cells, len(x))].copy()
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        for c in range(len(centres)):
            if (own == c).any():
                v = x[own == c].sum(axis=0)
                centres[c] = v / (np.linalg.norm(v) or 1)
    return centres.tolist()


def postings(chunks: DataFrame, id_col: str = "id", text_col: str = "text", terms: DataFrame | None = None) -> DataFrame:
    """(term, id, tf, dl) of all chunks, for one pass over filtered chunks; ``text_index`` stores them.

    With ``terms`` (term) only their postings; other words go before rows are made of them.
    """
    words = chunks.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("t"))
    words = words.select("id", F.size("t").alias("dl"), "t")
    if terms is not None:
        some = terms.limit(FILTER_TERMS + 1).collect()
        if len(some) <= FILTER_TERMS:
            wanted = F.array(*[F.lit(r["term"]) for r in some]).cast("array<string>")
            words = words.where(F.arrays_overlap("t", wanted)).withColumn("t", F.filter("t", lambda x: x.isin([r["term"] for r in some]))) if some else words.limit(0)
    words = words.select("id", "dl", F.explode("t").alias("term"))
    words = words if terms is None or len(some) <= FILTER_TERMS else words.join(terms, "term", "left_semi")
    return words.groupBy("term", "id").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def query_terms(queries: DataFrame, text_col: str = "question") -> DataFrame:
    terms = F.array_distinct(tokens(F.col(text_col)))
    return queries.select("qid", F.explode(terms).alias("term"), F.size(terms).alias("n_terms"))


def batch_terms(queries: DataFrame, n_queries: int | None = None, text_col: str = "question") -> DataFrame:
    """(term): the distinct terms of a batch, broadcast if the batch is known to be small."""
    return small_side(query_terms(queries, text_col).select("term").distinct(), n_queries)


def lexical_match(index: DataFrame, queries: DataFrame, mode: str = "and", text_col: str = "question", n_queries: int | None = None) -> DataFrame:
    """(qid, id, hits): chunks with all (or any) terms of the question; vectors are not needed."""
    hits = index.join(small_side(query_terms(queries, text_col), n_queries), "term").groupBy("qid", "id").agg(
        F.count("*").alias("hits"), F.first("n_terms").alias("n_terms"))
    return (hits.where("hits = n_terms") if mode == "and" else hits).drop("n_terms")


def lexical_topk(index: DataFrame, chunks_count: int, mean_length: float, queries: DataFrame, k: int = 50, mode: str = "and", digits: int = 9,
                 text_col: str = "question", n_queries: int | None = None) -> DataFrame:
    """(qid, id, score, rank) by Okapi BM25 over the matching chunks."""
    terms = query_terms(queries, text_col)
    df = index.join(batch_terms(queries, n_queries, text_col), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.lit(float(chunks_count)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(float(mean_length))))
    weighted = terms.join(df, "term").select("qid", "term", "n_terms", "df")
    hits = index.join(small_side(weighted, n_queries), "term").groupBy("qid", "id").agg(
        F.round(F.sum(part), digits).alias("score"), F.count("*").alias("hits"), F.first("n_terms").alias("n_terms"))
    hits = hits.where("hits = n_terms") if mode == "and" else hits
    return top_k(hits.select("qid", "id", "score"), k, "qid", F.desc("score"), F.asc("id"))


def corpus_stats(chunks: DataFrame, text_col: str = "text") -> tuple[int, float]:
    n, mean = chunks.agg(F.count("*"), F.avg(F.size(tokens(F.col(text_col))))).first()
    return n, mean or 1.0


def rrf(dense: DataFrame, lexical: DataFrame, digits: int = 12) -> DataFrame:
    """(qid, id, rrf, sim): reciprocal ranks of both lists, summed."""
    parts = dense.select("qid", "id", "rank", "sim").unionByName(lexical.select("qid", "id", "rank", F.lit(None).cast("double").alias("sim")))
    return parts.groupBy("qid", "id").agg(F.round(F.sum(1 / (K_RRF + F.col("rank"))), digits).alias("rrf"), F.max("sim").alias("sim"))


def signal(dense: DataFrame) -> DataFrame:
    """(qid, max_similarity) over the whole dense list."""
    return dense.groupBy("qid").agg(F.max("sim").alias("max_similarity"))


def text_dedup(candidates: DataFrame, text_col: str = "text", score: str = "rrf") -> DataFrame:
    """Per question, the best of the rows that share a text up to case and white space."""
    w = W.partitionBy("qid", dedup_key(F.col(text_col))).orderBy(F.desc(score), F.asc("id"))
    return candidates.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def dedup_corpus(rows: DataFrame, id_col: str = "id", text_col: str = "text", score: str = "score") -> DataFrame:
    """(id, key_size): the best row of each text up to case and white space, over a whole table.

    Grouped by the key's SHA-256 with partial aggregates: no text is shuffled, and
    a common text does not fill a task.
    """
    key = F.sha2(F.coalesce(dedup_key(F.col(text_col)), F.lit("")), 256)
    key = F.struct(F.col(text_col).isNull(), F.unhex(key))
    best = F.min_by(id_col, F.struct(-F.col(score), F.col(id_col)))
    return rows.groupBy(key.alias("_k")).agg(best.alias(id_col), F.count("*").alias("key_size")).drop("_k")


def assemble(structural: DataFrame, ranked: DataFrame, k: int) -> DataFrame:
    """Structural rows first, then ranked ones; an id appears once; k rows per question.

    Both have (qid, id, pos); the result adds path and rank.
    """
    both = structural.select("qid", "id", F.lit(0).alias("path"), "pos").unionByName(ranked.select("qid", "id", F.lit(1).alias("path"), "pos"))
    once = both.withColumn("_n", F.row_number().over(W.partitionBy("qid", "id").orderBy("path", "pos"))).where("_n = 1").drop("_n")
    return top_k(once, k, "qid", F.asc("path"), F.asc("pos"), F.asc("id"))


def hybrid(chunks: DataFrame, queries: DataFrame, k: int = 8, per_path: int = 50, n_queries: int | None = None, structural: DataFrame | None = None,
           reranker: Callable | None = None, mode: str = "and", structural_needs_candidates: bool = True, filters: dict | None = None,
           unit_norm: bool = True, index=None) -> tuple[DataFrame, DataFrame]:
    """(rows, signals) for queries (qid, question, query_vector) over chunks (id, text, embedding).

    rows: qid, id, rank, path (0 structural, 1 ranked), rrf, sim, rerank_score;
    signals: qid, max_similarity (the best rerank score if there is a reranker).
    ``filters`` are arguments of ``metadata_filter``; they bind both ranked paths
    but not the structural rows. Vectors of any length need ``unit_norm`` off.
    ``index`` is the chunks' stored text index; filtered chunks have their own
    statistics and do not use it.
    Questions without any candidate have no rows, also if they cite a unit,
    unless ``structural_needs_candidates`` is off.
    """
    chunks = metadata_filter(chunks, **(filters or {}))
    dense = dense_topk(chunks, queries, per_path, n_queries, unit_norm=unit_norm)
    if index is not None and not filters:
        from . import text_index

        lexical = text_index.topk(index, queries, per_path, mode, n_queries=n_queries)
    else:
        n, mean = corpus_stats(chunks)
        lexical = lexical_topk(postings(chunks, terms=batch_terms(queries, n_queries)), n, mean, queries, per_path, mode, n_queries=n_queries)
    best = top_k(rrf(dense, lexical), OVERFETCH * k, "qid", F.desc("rrf"), F.asc("id"), rank="rrf_rank")
    hydrated = chunks.select("id", "text").join(small_side(best, n_queries), "id")
    distinct = text_dedup(hydrated).join(queries.select("qid", "question"), "qid")
    scored = rerank(distinct, reranker)
    order = [F.desc("rerank_score"), F.desc("rrf"), F.asc("id")] if reranker else [F.desc("rrf"), F.asc("id")]
    ranked = scored.withColumn("pos", F.row_number().over(W.partitionBy("qid").orderBy(*order)))
    signals = queries.select("qid").join(
        ranked.groupBy("qid").agg(F.max("rerank_score").alias("max_similarity")) if reranker else signal(dense), "qid", "left").fillna(0.0, ["max_similarity"])
    if structural is None:
        rows = top_k(ranked.select("qid", "id", F.lit(1).alias("path"), "pos"), k, "qid", F.asc("pos"))
    else:
        first = structural.join(best.select("qid").distinct(), "qid", "left_semi") if structural_needs_candidates else structural
        rows = assemble(first, ranked, k)
    return rows.join(ranked.select("qid", "id", "rrf", "sim", "rerank_score"), ["qid", "id"], "left").drop("pos"), signals
