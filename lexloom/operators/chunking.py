"""Token-bounded chunks of segments.

Packing backs up over whole lines for the overlap and halves lines that are too
long, so it is sequential inside a segment; segments are independent rows, so
even a huge document is spread over tasks. Numbering follows as a window.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import SUBSTANTIVE
from ..sources.workspace import short_batches

WORDS = re.compile(SUBSTANTIVE)
ROUNDS = 12


@dataclass(frozen=True)
class ChunkOptions:
    target_tokens: int = 450
    max_tokens: int = 512
    overlap_tokens: int = 80
    min_words: int = 5


def count_words(texts: list[str]) -> list[int]:
    """The test tokenizer."""
    return [len(t.split()) for t in texts]


def lines_of(text: str) -> list[tuple[str, int]]:
    """Non-blank lines, trimmed, with their offsets."""
    out, at = [], 0
    for line in text.split("\n"):
        if body := line.strip():
            out.append((body, at + line.index(body)))
        at += len(line) + 1
    return out


def halves(line: tuple[str, int]) -> list[tuple[str, int]]:
    """Cut at the last blank up to the middle, or in the middle."""
    text, at = line
    mid = len(text) // 2
    cut = text.rfind(" ", 0, mid + 1)
    cut = cut if cut > 0 else mid
    right = text[cut:].lstrip()
    return [(text[:cut].rstrip(), at)] + ([(right, at + len(text) - len(right))] if right else [])


def bounded_lines(text: str, count: Callable, limit: int) -> tuple[list[tuple[str, int]], list[int]]:
    units = lines_of(text)
    sizes = count([u[0] for u in units])
    for _ in range(ROUNDS):
        if all(n <= limit for n in sizes):
            break
        units = [x for u, n in zip(units, sizes, strict=True) for x in ([u] if n <= limit else halves(u))]
        sizes = count([u[0] for u in units])
    return units, sizes


def pack_lines(units: list[tuple[str, int]], sizes: list[int], options: ChunkOptions) -> list[tuple[str, int, int]]:
    """(text, offset, tokens) of greedy chunks; each next one repeats a bounded overlap."""
    out, first = [], 0
    while first < len(units):
        end, total = first + 1, sizes[first]
        while end < len(units) and total + sizes[end] <= options.target_tokens:
            total += sizes[end]
            end += 1
        out.append(("\n".join(u[0] for u in units[first:end]), units[first][1], total))
        if end == len(units):
            break
        nxt, overlap = end, 0
        while nxt - 1 > first and overlap + sizes[nxt - 1] <= options.overlap_tokens:
            nxt -= 1
            overlap += sizes[nxt]
        first = nxt
    return out


def chunk_segments(segments: DataFrame, options: ChunkOptions | None = None, count: Callable = count_words, doc: str = "doc_id", order: str = "seg",
                   text: str = "text", start: str = "char_start", carry: list[str] = (), errors: str | None = None) -> DataFrame:
    """Rows (doc, chunk_index, text, char_start, char_end, token_count, *carry).

    Chunks with fewer than ``min_words`` words of three letters are dropped
    before numbering. ``carry`` columns (label, locator) come from the segment.
    With ``errors``, a segment that cannot be chunked is a row with null text and
    the message in that column, instead of ending the job.
    """
    short_batches(segments.sparkSession)
    options = options or ChunkOptions()
    keep = [doc, order, *carry]
    src = segments.select(*keep, F.col(text).alias("_text"), F.coalesce(F.col(start), F.lit(0)).cast("int").alias("_start"))
    types = dict(src.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in keep) + ", local int, text string, char_start int, char_end int, token_count int, error string"

    def run(frames):
        for f in frames:
            rows = []
            for r in f.itertuples(index=False, name=None):
                own, body, at = list(r[:len(keep)]), r[-2] or "", r[-1]
                try:
                    packed = pack_lines(*bounded_lines(body, count, options.max_tokens), options)
                except Exception as e:  # noqa: BLE001  the segment's error is a row
                    if errors is None:
                        raise
                    rows.append([*own, -1, None, None, None, None, str(e)])
                    continue
                for k, (t, offset, n) in enumerate(packed):
                    if len(WORDS.findall(t)) >= options.min_words:
                        rows.append([*own, k, t, at + offset, at + offset + len(t), n, None])
            yield pd.DataFrame(rows, columns=[*keep, "local", "text", "char_start", "char_end", "token_count", "error"])

    made = src.mapInPandas(run, schema)
    index = F.row_number().over(W.partitionBy(doc).orderBy(order, "local")) - 1
    last = [] if errors is None else [F.col("error").alias(errors)]
    return made.withColumn("chunk_index", index).select(doc, "chunk_index", "text", "char_start", "char_end", "token_count", *carry, *last)


def text_units(df: DataFrame, doc: str, text: str) -> DataFrame:
    """Relational form of the unit split: (doc, unit, text, offset of its line, words)."""
    line = df.select(doc, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("line", "raw"))
    at = F.coalesce(F.sum(F.length("raw") + 1).over(W.partitionBy(doc).orderBy("line").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    body = F.regexp_replace("raw", r"(?U)^\s+|\s+$", "")
    lead = F.length("raw") - F.length(F.regexp_replace("raw", r"(?U)^\s+", ""))
    rows = line.withColumn("offset", at + lead).withColumn("text", body).where(F.length("text") > 0)
    return rows.select(doc, "line", "text", "offset", F.size(F.split("text", r"(?U)\s+")).alias("words"))
