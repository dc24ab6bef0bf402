"""Model calls as injected functions, run in Arrow batches.

A provider maps a list of texts to vectors, a reranker maps (query, texts) to
scores. Both are plain callables that executors can unpickle; deterministic
stand-ins are included for tests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.workspace import short_batches

#: Fixed value: what precedes a question before it is embedded.
QUERY_PREFIX = "zapytanie: "
BATCH = 32


def hashed_embedder(dim: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """Deterministic vectors: every word adds a direction seeded by its SHA-256."""
    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = np.zeros(dim)
            for w in text.lower().split():
                seed = int.from_bytes(hashlib.sha256(w.encode()).digest()[:8], "little")
                v += np.random.default_rng(seed).standard_normal(dim)
            out.append((v / (np.linalg.norm(v) or 1.0)).tolist())
        return out

    return embed


def substring_reranker(needle: str) -> Callable[[str, list[str]], list[tuple[int, float]]]:
    """Scores texts that hold the needle above all others."""
    return lambda query, texts: [(i, 1.0 if needle in t else 0.1) for i, t in enumerate(texts)]


def unit_vectors(texts: list[str], provider: Callable, dim: int) -> list[list[float]]:
    """One call of the provider; its vectors, L2-normalised."""
    out, got = [], provider(texts)
    if len(got) != len(texts):
        raise ValueError(f"{len(got)} vectors for {len(texts)} texts")
    for v in got:
        if len(v) != dim:
            raise ValueError(f"vector of {len(v)} numbers, not {dim}")
        norm = float(np.linalg.norm(v)) or 1.0
        out.append([float(x) / norm for x in v])
    return out


def embed_passages(df: DataFrame, text_col: str, provider: Callable, dim: int, model: str, out_col: str = "embedding", errors: str | None = None) -> DataFrame:
    """Adds L2-normalised vectors and the model's name; a wrong dimension is an error.

    With ``errors``, a batch that fails is asked again text by text, and a text
    that fails alone has a null vector and the message in that column; null texts
    are not asked then.
    """
    short_batches(df.sparkSession)

    @F.pandas_udf("struct<vector:array<float>,error:string>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows: list = []
            for at in range(0, len(texts), BATCH):
                part = texts.iloc[at:at + BATCH]
                asked = part.fillna("").tolist() if errors is None else [t for t in part if t is not None]
                try:
                    got = [(v, None) for v in unit_vectors(asked, provider, dim)] if asked else []
                except Exception:  # noqa: BLE001  found out text by text
                    if errors is None:
                        raise
                    got = [alone(t) for t in asked]
                left = iter(got)
                rows += got if errors is None else [(None, None) if t is None else next(left) for t in part]
            yield pd.DataFrame(rows, columns=["vector", "error"])

    def alone(text: str) -> tuple:
        try:
            return unit_vectors([text], provider, dim)[0], None
        except Exception as e:  # noqa: BLE001  this text's error is its row's
            return None, str(e)

    out = df.withColumn("_embedded", embed(F.col(text_col))).withColumns({out_col: F.col("_embedded.vector"), "embedded_with": F.lit(model)})
    return (out if errors is None else out.withColumn(errors, F.col("_embedded.error"))).drop("_embedded")


def embed_query(question: str, provider: Callable) -> list[float]:
    return provider([QUERY_PREFIX + question])[0]


def embed_queries(queries: DataFrame, text_col: str, provider: Callable, dim: int, out_col: str = "query_vector") -> DataFrame:
    marked = queries.withColumn("_asked", F.concat(F.lit(QUERY_PREFIX), F.col(text_col)))
    return embed_passages(marked, "_asked", provider, dim, "", out_col).drop("_asked", "embedded_with")


def is_stale(embedded_with: Column, model: str) -> Column:
    """Embedded by another model or not at all."""
    return ~embedded_with.eqNullSafe(F.lit(model))


def reembed_stale(chunks: DataFrame, provider: Callable, dim: int, model: str, text_col: str = "text", errors: str | None = None) -> DataFrame:
    """Only stale chunks go through the model; ``errors`` as in ``embed_passages``."""
    fresh = chunks.where(~is_stale(F.col("embedded_with"), model))
    stale = embed_passages(chunks.where(is_stale(F.col("embedded_with"), model)).drop("embedding", "embedded_with"), text_col, provider, dim, model, errors=errors)
    more = [] if errors is None else [errors]
    return fresh.withColumns({e: F.lit(None).cast("string") for e in more}).unionByName(stale.select(*fresh.columns, *more))


def rerank(candidates: DataFrame, reranker: Callable | None, qid: str = "qid", query: str = "question", text: str = "text") -> DataFrame:
    """Adds rerank_score (0 where the reranker names no score); without one it is null.

    A question has at most a few dozen candidates, so grouping them is bounded.
    """
    if reranker is None:
        return candidates.withColumn("rerank_score", F.lit(None).cast("double"))
    schema = candidates.schema.simpleString()[len("struct<"):-1]

    def score(f: pd.DataFrame) -> pd.DataFrame:
        scores = dict(reranker(f[query].iloc[0], f[text].tolist())) if len(f) else {}
        return f.assign(rerank_score=[float(scores.get(i, 0.0)) for i in range(len(f))])

    return candidates.groupBy(qid).applyInPandas(score, schema + ",rerank_score:double")
