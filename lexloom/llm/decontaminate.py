"""Benchmark decontamination by Wu-Manber multi-pattern search.

Texts are lower-cased (A-Z) and cut into words; the alphabet of the search is
the benchmark's words. Patterns are the windows of ``window`` consecutive item
words (a shorter item is one window), grouped by length m. Per length:

* SHIFT, addressed by a hash of a block of B words, tells how far the search
  may move from a position ending in that block; only blocks that end a
  pattern have shift 0.
* HASH holds, for each suffix block with shift 0, the patterns ending in it.
* Candidates are confirmed by comparing all m words directly.

One scan serves many documents at once: the words of a batch form one sequence
cut into lanes which all move by their own shifts in vectorised steps.

The pattern set is a stated query set: it is processed in blocks of at most
``block_words`` benchmark words, one pass over the documents for each, so that
what a task holds has a fixed bound; usually one block is enough.

Null and empty texts have no words and no hits; items of null or empty text have
no windows; ids of documents and items may be of any type and null, and an item
without an id hits but is not listed; repeated items or ids are one item; very long texts are searched in
full; documents may repeat, each row has its own result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import ALNUM, lower_words, materialize, prepare

LANE = 512
BATCH_WORDS = 1 << 19
#: The shift table has at least so many slots for each pattern: overlapping windows share most of their blocks.
SPARSE = 8


class WuManber:
    """Search of word sequences of one length in a sequence of word numbers."""

    def __init__(self, patterns: np.ndarray):
        self.patterns, (n, self.m) = patterns, patterns.shape
        self.block = min(2, self.m)
        self.bits = max(10, (SPARSE * n).bit_length())
        self.shift = np.full(1 << self.bits, self.m - self.block + 1, np.int32)
        for j in range(self.block - 1, self.m):
            np.minimum.at(self.shift, self._hash(patterns[:, j - self.block + 1], patterns[:, j]), self.m - 1 - j)
        suffix = self._hash(patterns[:, self.m - self.block], patterns[:, self.m - 1])
        self.order = np.argsort(suffix, kind="stable")
        self.start = np.searchsorted(suffix[self.order], np.arange((1 << self.bits) + 1)).astype(np.int32)

    def _hash(self, a, b):
        mixed = (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        return ((mixed * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(last position, pattern) of every occurrence in ``text``."""
        n, m = len(text), self.m
        ends, which = [], []
        pos = np.arange(m - 1, n, LANE)
        stop = np.minimum(pos + LANE, n)
        while pos.size:
            code = self._hash(text[pos - self.block + 1], text[pos])
            jump = self.shift[code]
            for at in (np.flatnonzero(jump == 0),):
                if at.size:
                    first = self.start[code[at]]
                    count = self.start[code[at] + 1] - first
                    end = np.repeat(pos[at], count)
                    step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                    pat = self.order[np.repeat(first, count) + step]
                    same = self.patterns[pat, 0] == text[end - m + 1]
                    end, pat = end[same], pat[same]
                    same = (self.patterns[pat] == text[end[:, None] + np.arange(1 - m, 1)]).all(axis=1)
                    ends.append(end[same])
                    which.append(pat[same])
            pos = pos + np.maximum(jump, 1)
            live = pos < stop
            pos, stop = pos[live], stop[live]
        empty = np.zeros(0, np.int64)
        return (np.concatenate(ends), np.concatenate(which)) if ends else (empty, empty)


class Matcher:
    """All windows of a block of items."""

    def __init__(self, items, window: int = 10):
        self.words: dict[bytes, int] = {}
        self.items: list = []
        owners: dict[int, dict[tuple, set[int]]] = {}
        for item, text in items:
            words = [self.words.setdefault(w, len(self.words) + 1) for w in lower_words(text, ALNUM)]
            if not words:
                continue
            self.items.append(item)
            m = min(window, len(words))
            for i in range(len(words) - m + 1):
                owners.setdefault(m, {}).setdefault(tuple(words[i:i + m]), set()).add(len(self.items) - 1)
        self.searchers = []
        for _, group in sorted(owners.items()):
            self.searchers.append((WuManber(np.array(list(group), np.int64)), [sorted(o) for o in group.values()]))

    def search(self, texts: list) -> list[tuple[int, list, list]]:
        """For each text: words, hit spans [start, end) in words, items."""
        out: list = []
        at = 0
        while at < len(texts):
            chunk, lengths, total, get = [], [], 0, self.words.get
            while at < len(texts) and total < BATCH_WORDS:
                words = lower_words(texts[at], ALNUM)
                chunk += [get(w, 0) for w in words]
                chunk.append(0)
                lengths.append(len(words))
                total += len(words) + 1
                at += 1
            out += self._search(np.array(chunk, np.int64), np.array(lengths))
        return out

    def _search(self, text, lengths):
        begin = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
        spans: list[list] = [[] for _ in lengths]
        items: list[set] = [set() for _ in lengths]
        for searcher, owner in self.searchers:
            end, pat = searcher.find(text)
            doc = np.searchsorted(begin, end, "right") - 1
            for d, e, p in zip(doc.tolist(), (end - begin[doc]).tolist(), pat.tolist(), strict=True):
                spans[d].append((e - searcher.m + 1, e + 1))
                items[d].update(owner[p])
        return [(int(n), merge_spans(s), sorted({self.items[i] for i in it} - {None})) for n, s, it in zip(lengths, spans, items, strict=True)]


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_words: int) -> list[DataFrame]:
    """The items (item, text) in blocks of bounded size."""
    items = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-chars // (4 * block_words)))
    return [items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == b) if n > 1 else items for b in range(n)]


def _hits(matcher):
    @F.pandas_udf("boolean")
    def hit(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield pd.Series([bool(spans) for _, spans, _ in matcher.value.search(t.tolist())], dtype=bool)

    return hit


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", item_col: str = "item_id",
                      item_text_col: str = "text", block_words: int = 250_000) -> DataFrame:
    """The rows of ``docs`` in which no window of the benchmark occurs, columns unchanged."""
    spark = docs.sparkSession
    prepare(spark)
    for block in item_blocks(benchmark, item_col, item_text_col, block_words):
        matcher = spark.sparkContext.broadcast(Matcher([(r["item"], r["text"]) for r in block.collect()], window))

        docs = docs.where(~_hits(matcher)(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    return docs


SPANS = "array<struct<start:long,end:long>>"


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text",
                       item_col: str = "item_id", item_text_col: str = "text", block_words: int = 250_000) -> DataFrame:
    """Rows (id, n_words, spans, items), one per row of ``docs``.

    ``spans`` are the hit words as merged [start, end) word positions, ``items``
    the distinct items with occurring windows.
    """
    prepare(docs.sparkSession)
    blocks = item_blocks(benchmark, item_col, item_text_col, block_words)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    if len(blocks) == 1:
        return _scan(src, blocks[0], window).drop("row")
    src = materialize(src.select(F.monotonically_increasing_id().alias("row"), "id", "text"), "numbered")
    found = None
    for block in blocks:
        part = _scan(src, block, window)
        found = part if found is None else found.unionByName(part)
    merged = found.groupBy("row").agg(
        F.first("id").alias("id"), F.first("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("s"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    spans = F.expr("""aggregate(s, CAST(array() AS array<struct<start:long,end:long>>), (a, x) ->
        CASE WHEN size(a) > 0 AND x.start <= element_at(a, -1).end
             THEN concat(slice(a, 1, size(a) - 1), array(struct(element_at(a, -1).start AS start, greatest(element_at(a, -1).end, x.end) AS end)))
             ELSE concat(a, array(x)) END)""")
    return merged.select("id", "n_words", spans.cast(SPANS).alias("spans"), "items")


def _scan(src: DataFrame, block: DataFrame, window: int) -> DataFrame:
    matcher, item_kind = src.sparkSession.sparkContext.broadcast(Matcher([(r["item"], r["text"]) for r in block.collect()], window)), block.schema["item"].dataType
    has_row = "row" in src.columns
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    names = ["row", "id", "n_words", "spans", "items"]
    item_type = to_arrow_type(item_kind)

    def scan(batches):
        for b in batches:
            found = matcher.value.search(b.column(b.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([
                b.column(0).cast(pa.int64()) if has_row else pa.nulls(b.num_rows, pa.int64()), b.column(b.num_columns - 2),
                pa.array([x[0] for x in found], pa.int64()),
                pa.array([[{"start": s, "end": e} for s, e in x[1]] for x in found], pa.list_(span)),
                pa.array([x[2] for x in found], pa.list_(item_type))], names=names)

    return src.mapInArrow(scan, f"row long, id {src.schema['id'].dataType.simpleString()}, n_words long, spans {SPANS}, items array<{item_kind.simpleString()}>")
