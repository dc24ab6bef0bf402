"""Row patterns ``A (D|U)*? P`` over each key's ordered rows, without backtracking.

A fits any row with cents. D and U fit a row that ``loops`` and lies below or
above the row before it; P fits a row that ``ends`` and has at least A's cents.
D, U and P also lie within ``gap`` of the row before. The automaton has one inner
state between A and P. For it and row i,

    best[i] = max(cents[i] if P can be here, best[i + 1] if D or U can be here)

is the maximum of A-cents that still succeed from row i on. It is filled from
right to left. A match can start at row s exactly if cents[s] <= best[s + 1];
the forward walk then takes P where it fits, else D or U, and cannot fail.

Rows are dealt by range over (key, time, id) into blocks of about ``block_rows``,
so one key may hold any share of them. A row that can be neither D, U nor P cuts
its block: no match crosses into it. What lies between a block's first and last
cut is matched at once. The rows before the first and after the last (its head
and tail, or the whole block if there is no cut) are fragments. A tail, the
blocks without a cut after it and the next head are a run, solved without ever
bringing its rows together:

* best at a fragment's right edge: a fragment turns best at its right edge, x,
  into max(low, x) or low at its left edge; these pairs are folded over the run.
* the walk's state at its left edge (free, or in a match from an earlier
  fragment with its A-cents): a fragment turns "free" into one state, and open
  A-cents into that of the first step, of ascending thresholds, that holds them.
  Steps are made for all entries at once, from right to left, and folded.
* then every fragment is walked by itself; pieces of a match are put together.

A fold reads one row per fragment. Joins are by key and never broadcast. Only the label string of a single match comes
together in one row, one byte per matched row, as its digest asks.

Defined cases: repeated rows count once; rows without key or time are dropped;
null cents fit no letter; a null flag is false; a null id comes first and is
given back as null; rows of one time and id are ordered by cents and flags, what
is equal in these is interchangeable; an empty table gives an empty result;
other columns only make rows distinct.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import materialize, prepare

GAP = 600_000_000
BLOCK_ROWS = 500_000
#: Blocks of one group of the two-level running sums and maxima.
GROUP = 1024
#: Below all cents: nothing succeeds, or no match is open. Also stands for a null id.
NEVER = -(1 << 63)

MATCH = "block long, pos long, key long, first_id long, last_id long, n_rows long, sum_cents long, labels_sha256 string"
PIECE = "run long, start_block long, start_pos long, block long, key long, first_id long, last_id long, n_rows long, sum_cents long, labels string"


class Rows:
    """Consecutive rows with what each of them can be; the first row follows nothing."""

    def __init__(self, key, ts, ids, cents, known, loops, ends, gap: int):
        self.key, self.ids, self.cents, self.known = key, ids, cents, known
        near = np.zeros(len(key), bool)
        near[1:] = (key[1:] == key[:-1]) & (ts[1:] - ts[:-1] <= gap) & known[1:] & known[:-1]
        step = np.zeros(len(key), np.int8)  # 1 above, -1 below the row before
        step[1:] = np.sign((cents[1:] > cents[:-1]).astype(np.int8) - (cents[1:] < cents[:-1]).astype(np.int8))
        self.loop = near & loops & (step != 0)
        self.end = near & ends
        self.letter = np.where(step > 0, "U", "D")
        self.cut = ~(self.loop | self.end)

    @classmethod
    def of(cls, t: pd.DataFrame, gap: int) -> Rows:
        """From a fragment's rows; row -1, if there, is the last one of the fragment before."""
        t = t.sort_values("pos")
        rows = cls(t["key"].to_numpy(), t["ts"].to_numpy(), t["id"].to_numpy(), t["cents"].to_numpy(), t["known"].to_numpy(bool),
                   t["loops"].to_numpy(bool), t["ends"].to_numpy(bool), gap)
        return rows.part(int((t["pos"] < 0).sum()), len(t))

    def part(self, a: int, b: int) -> Rows:
        out = object.__new__(Rows)
        out.__dict__ = {k: v[a:b] for k, v in self.__dict__.items()}
        return out

    def __len__(self) -> int:
        return len(self.key)


def best_cents(rows: Rows, right: int = NEVER) -> list[int]:
    """best of every row, and ``right``, that of the row after them."""
    out = [right] * (len(rows) + 1)
    here = right
    for i, cents, loop, end in zip(range(len(rows) - 1, -1, -1), rows.cents[::-1].tolist(), rows.loop[::-1].tolist(), rows.end[::-1].tolist(), strict=True):
        if not loop:
            here = NEVER
        if end and cents > here:
            here = cents
        out[i] = here
    return out


def walk(rows: Rows, best: list[int], open_cents: int = NEVER) -> list[tuple[int, int, bool]]:
    """Matches (first row, end, ended) in order; first row -1: begun earlier, with ``open_cents``."""
    out, cents, end, known, n = [], rows.cents.tolist(), rows.end.tolist(), rows.known.tolist(), len(rows)
    s, i, a = -1, 0, open_cents
    while True:
        if a == NEVER:
            while i < n and not (known[i] and cents[i] <= best[i + 1]):
                i += 1
            if i == n:
                return out
            s, a, i = i, cents[i], i + 1
        while i < n and not (end[i] and cents[i] >= a):
            i += 1
        out.append((s, min(i + 1, n), i < n))
        if i == n:
            return out
        a, i = NEVER, i + 1


def exits(rows: Rows, best: list[int]) -> tuple[list[int], list[int], list[int], int, int]:
    """(thresholds, their exit's A-cents and row, the free entry's exit's A-cents and row); NEVER: free.

    Open A-cents up to a threshold, and above the one before, end in this
    fragment and leave it by that exit; larger ones stay open.
    """
    cents, end, known, n = rows.cents.tolist(), rows.end.tolist(), rows.known.tolist(), len(rows)
    leave = [(NEVER, -1)] * (n + 1)
    stack: list[int] = []  # rows where P can be, after i, of ascending cents from the top
    for i in range(n - 1, -1, -1):
        if known[i] and cents[i] <= best[i + 1]:
            low, high = 0, len(stack)  # the last of the stack, which descends, with cents enough is the nearest
            while low < high:
                mid = (low + high) // 2
                low, high = (mid + 1, high) if cents[stack[mid]] >= cents[i] else (low, mid)
            leave[i] = leave[stack[low - 1] + 1] if low else (cents[i], i)
        else:
            leave[i] = leave[i + 1]
        if end[i]:
            while stack and cents[stack[-1]] <= cents[i]:
                stack.pop()
            stack.append(i)
    steps: list[tuple[int, tuple[int, int]]] = []
    top = NEVER
    for i, (loop, ends) in enumerate(zip(rows.loop.tolist(), end, strict=True)):
        if ends and cents[i] > top:
            top = cents[i]
            if steps and steps[-1][1] == leave[i + 1]:
                steps.pop()  # one step up to the new threshold
            steps.append((top, leave[i + 1]))
        if not loop:
            break
    return [t for t, _ in steps], [e[0] for _, e in steps], [e[1] for _, e in steps], *leave[0]


def labels_of(rows: Rows, a: int, b: int, begun: bool, ended: bool) -> str:
    body = "".join(rows.letter[a + begun:b - ended].tolist())
    return "A" * begun + body + "P" * ended


def block_matches(gap: int):
    """Function of one block's batches: matches between its cuts (tag 0) and its fragments' rows (tag 1)."""

    def run(batches):
        from pyspark import TaskContext

        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        t = pa.Table.from_batches(batches)
        block, n = TaskContext.get().partitionId(), t.num_rows
        raw = {c: t.column(c).to_numpy() for c in t.column_names}
        rows = Rows(*(raw[c] for c in ("key", "ts", "id", "cents", "known", "loops", "ends")), gap)
        cuts = np.flatnonzero(rows.cut[1:]) + 1
        first, last = (int(cuts[0]), int(cuts[-1])) if len(cuts) else (n, n)
        inner = rows.part(first, last)
        total = np.concatenate([[0], np.cumsum(inner.cents)]).tolist()
        got = [(a, b, hashlib.sha256(labels_of(inner, a, b, True, True).encode()).hexdigest()) for a, b, _ in walk(inner, best_cents(inner))]
        a, b = np.array([m[0] for m in got], np.int64), np.array([m[1] for m in got], np.int64)
        empty = [None] * len(got)
        yield pa.RecordBatch.from_pydict({
            "tag": [0] * len(got), "block": [block] * len(got), "pos": a + first, "key": inner.key[a], "first_id": inner.ids[a], "last_id": inner.ids[b - 1], "n_rows": b - a,
            "sum_cents": [total[y] - total[x] for x, y, _ in got], "labels_sha256": [m[2] for m in got],
            "ts": empty, "cents": empty, "known": empty, "loops": empty, "ends": empty, "cut": empty}, OUT)
        for x, y in ((0, first), (last, n)):
            for at in range(x, y, 1 << 16):
                m = slice(at, min(y, at + (1 << 16)))
                k = m.stop - m.start
                none = [None] * k
                yield pa.RecordBatch.from_pydict({
                    "tag": [1] * k, "block": [block] * k, "pos": np.arange(m.start, m.stop), "key": raw["key"][m], "first_id": raw["id"][m], "last_id": none, "n_rows": none, "sum_cents": none,
                    "labels_sha256": none, **{c: raw[c][m] for c in ("ts", "cents", "known", "loops", "ends")}, "cut": [bool(len(cuts)) and at >= last] * k}, OUT)

    return run


OUT = pa.schema([("tag", pa.int32()), ("block", pa.int64()), ("pos", pa.int64()), ("key", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("n_rows", pa.int64()),
                 ("sum_cents", pa.int64()), ("labels_sha256", pa.string()), ("ts", pa.int64()), ("cents", pa.int64()), ("known", pa.bool_()), ("loops", pa.bool_()), ("ends", pa.bool_()), ("cut", pa.bool_())])
OUT_DDL = MATCH.replace("block long", "tag int, block long") + ", ts long, cents long, known boolean, loops boolean, ends boolean, cut boolean"


def running(df: DataFrame, keys: list[str], order: str, value: str, how, out: str) -> DataFrame:
    """``how`` (sum or max) of the values of earlier rows of the key, null for the first, in groups of GROUP of the whole-numbered order."""
    df = df.withColumn("g", F.floor(F.col(order) / GROUP))
    within = W.partitionBy(*keys, "g").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    over = W.partitionBy(*keys).orderBy("g").rowsBetween(W.unboundedPreceding, -1)
    groups = df.groupBy(*keys, "g").agg(how(value).alias("x")).withColumn("ahead", how("x").over(over)).drop("x")
    both = df.withColumn("own", how(value).over(within)).join(groups.hint("merge"), [*keys, "g"])
    total = F.coalesce(F.col("own"), F.col("ahead")) if how is F.max else F.coalesce(F.col("own"), F.lit(0)) + F.coalesce(F.col("ahead"), F.lit(0))
    return both.withColumn(out, total).drop("g", "own", "ahead")


def as_runs(fragments: DataFrame) -> DataFrame:
    """Fragment rows with their run (the block of its tail, or -1), the fragment's number in it, and before each fragment the last row of the one before."""
    parts = fragments.groupBy("block", "cut").agg(F.max("pos").alias("last"))
    tails = parts.groupBy("block").agg(F.max(F.when(F.col("cut"), F.col("block"))).alias("tail")).withColumn("one", F.lit(1))
    earlier = running(tails, ["one"], "block", "tail", F.max, "earlier").select("block", "earlier")
    parts = parts.join(earlier.hint("merge"), "block").withColumn("run", F.when(F.col("cut"), F.col("block")).otherwise(F.coalesce("earlier", F.lit(-1))))
    parts = parts.withColumn("next", F.lead("block").over(W.partitionBy("run").orderBy("block"))).select("block", "cut", "run", "last", "next")
    rows = fragments.join(parts.hint("merge"), ["block", "cut"])
    seams = rows.where("pos = last AND next IS NOT NULL").withColumn("block", F.col("next")).withColumn("pos", F.lit(-1).cast("long"))
    return rows.unionByName(seams).select("run", "block", "pos", "key", "ts", F.col("first_id").alias("id"), "cents", "known", "loops", "ends")


def right_edges(low: list[tuple[int, int, bool]]) -> list[int]:
    """best after each fragment of a run, from (block, low, passes) in order."""
    out, x = [], NEVER
    for _, own, passes in reversed(low):
        out.append(x)
        x = max(own, x) if passes else own
    return out[::-1]


def solve_runs(fragments: DataFrame, gap: int) -> DataFrame:
    """Matches of the runs, each with the block and row it begins in."""
    by = ["run", "block"]

    def low(key, t):
        rows = Rows.of(t, gap)
        return pd.DataFrame({"run": [key[0]], "block": [key[1]], "low": [best_cents(rows)[0]], "passes": [bool(rows.loop.all())]})

    def edges(key, t):
        t = t.sort_values("block")
        return pd.DataFrame({"run": t["run"], "block": t["block"], "edge": right_edges(list(zip(t["block"].tolist(), t["low"].tolist(), t["passes"].tolist(), strict=True)))})

    def steps(key, t):
        rows = Rows.of(t, gap)
        shift = int(t["pos"].max()) - len(rows) + 1
        up_to, a, pos, free_a, free_pos = exits(rows, best_cents(rows, int(t["edge"].iloc[0])))
        pos, free_pos = [p + shift for p in pos], free_pos + shift
        return pd.DataFrame({"run": [key[0]], "block": [key[1]], "up_to": [up_to], "a": [a], "pos": [pos], "free_a": [free_a], "free_pos": [free_pos]})

    def entries(key, t):
        t, out, state = t.sort_values("block"), [], (NEVER, -1, -1)
        for r in t.itertuples():
            out.append((*key, r.block, *state))
            if state[0] == NEVER:
                state = (r.free_a, r.block, r.free_pos)
            elif len(r.up_to) and state[0] <= r.up_to[-1]:
                k = int(np.searchsorted(r.up_to, state[0]))
                state = (r.a[k], r.block, r.pos[k])
        return pd.DataFrame(out, columns=["run", "block", "open_cents", "start_block", "start_pos"])

    def pieces(key, t):
        t = t.sort_values("pos")
        rows, head = Rows.of(t, gap), t.iloc[0]
        shift = int(t["pos"].max()) - len(rows) + 1
        out = []
        for s, e, ended in walk(rows, best_cents(rows, int(head["edge"])), int(head["open_cents"])):
            begun, at = s >= 0, max(s, 0)
            out.append((key[0], key[1] if begun else int(head["start_block"]), s + shift if begun else int(head["start_pos"]), key[1], rows.key[at], rows.ids[at] if begun else None,
                        rows.ids[e - 1] if ended else None, e - at, int(rows.cents[at:e].sum()), labels_of(rows, at, e, begun, ended)))
        return pd.DataFrame(out, columns=[c.split()[0] for c in PIECE.split(", ")], dtype=object)

    edge = fragments.groupBy(*by).applyInPandas(low, "run long, block long, low long, passes boolean").groupBy("run").applyInPandas(edges, "run long, block long, edge long")
    edged = materialize(fragments.join(edge.hint("merge"), by), "edged")
    entry = edged.groupBy(*by).applyInPandas(steps, "run long, block long, up_to array<long>, a array<long>, pos array<long>, free_a long, free_pos long").groupBy("run").applyInPandas(
        entries, "run long, block long, open_cents long, start_block long, start_pos long")
    found = edged.join(entry.hint("merge"), by).groupBy(*by).applyInPandas(pieces, PIECE)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "labels"))), lambda x: x["labels"]), "")
    return found.groupBy("run", "start_block", "start_pos").agg(
        F.first("key").alias("key"), F.max("first_id").alias("first_id"), F.max("last_id").alias("last_id"), F.sum("n_rows").alias("n_rows"), F.sum("sum_cents").alias("sum_cents"),
        F.sha2(text, 256).alias("labels_sha256")).select(F.col("start_block").alias("block"), F.col("start_pos").alias("pos"), "key", "first_id", "last_id", "n_rows", "sum_cents", "labels_sha256")


def match_rows(rows: DataFrame, key: Column, ts: Column, row_id: Column, cents: Column, loops: Column, ends: Column, gap: int = GAP, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(key, match_no, first_id, last_id, n_rows, sum_cents, labels_sha256) of the distinct ``rows``.

    The columns are expressions over ``rows``: key, ts, row_id and cents whole
    numbers, ts and ``gap`` in the same unit, loops and ends conditions.
    """
    spark = rows.sparkSession
    prepare(spark)
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // block_rows))
    long = lambda c, other=None: c.cast("long") if other is None else F.coalesce(c.cast("long"), F.lit(other).cast("long"))
    order = ["key", "ts", "id", "known", "cents", "loops", "ends"]
    dealt = rows.distinct().select(
        long(key).alias("key"), long(ts).alias("ts"), long(row_id, NEVER).alias("id"), cents.isNotNull().alias("known"), long(cents, 0).alias("cents"),
        F.coalesce(loops, F.lit(False)).alias("loops"), F.coalesce(ends, F.lit(False)).alias("ends"),
    ).where("key IS NOT NULL AND ts IS NOT NULL").repartitionByRange(blocks, *order).sortWithinPartitions(*order)
    out = materialize(dealt.mapInArrow(block_matches(gap), OUT_DDL), "blocks", "tag")
    fragments = as_runs(out.where("tag = 1").select("block", "cut", "pos", "key", "ts", "first_id", "cents", "known", "loops", "ends"))
    columns = [c.split()[0] for c in MATCH.split(", ")]
    found = materialize(out.where("tag = 0").select(*columns).unionByName(solve_runs(fragments, gap).select(*columns)), "matches")
    before = running(found.groupBy("key", "block").agg(F.count("*").alias("n")), ["key"], "block", "n", F.sum, "before").select("key", "block", "before")
    number = F.row_number().over(W.partitionBy("key", "block").orderBy("pos")) + F.col("before")
    ids = [F.when(F.col(c) != NEVER, F.col(c)).alias(c) for c in ("first_id", "last_id")]
    return found.join(before.hint("merge"), ["key", "block"]).select("key", number.alias("match_no"), *ids, "n_rows", "sum_cents", "labels_sha256")
