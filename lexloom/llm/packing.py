"""Best-fit packing of token sequences by the linear grouping scheme.

1. ``tokenize_pieces``: each document becomes its token ids and an end id; only
   longer ones are cut, into pieces of ``capacity`` whose first may be shorter.
   Pieces and their ids are written to the shared folder once.
2. ``plan_packing``: the histogram of piece lengths (at most ``capacity``
   counts, whatever the corpus) is planned on the driver. Large lengths (over a
   quarter of the capacity) are sorted into equal-cardinality groups and rounded
   up to the group's largest; configurations of these few sizes, and of the space
   they leave to small pieces, are optimised by column generation; actual lengths
   are then substituted for the rounded ones, and small pieces and the rounding's
   leftovers go best-fit, largest first, into the fullest sequences that take
   them. Everything works on runs of equal sequences, so time and the plan's size
   depend on ``capacity`` and ``groups`` only.
3. ``place``: the plan, of bounded size, is broadcast. A piece's rank among
   pieces of its length is its rank in its partition plus a prefix sum over
   partitions (a shuffle join), so no length is gathered anywhere.

Null texts count as empty: a single end id. Very long texts are encoded whole;
runs too long for the fast engine go to the library. Ids may be null, repeated
or of any type; rows may repeat, each is packed; other columns are ignored,
whatever their names. An empty table packs to nothing.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import materialize, prepare
from .token_count import merge_engine, open_library, share_spec, shared_spec

#: Units in 1024 that best fit leaves free in a sequence with small pieces.
SLACK = 8
PIECES = "part int, rank long, id {id}, piece int, start long, length long, ids binary"


def encoder(spec: dict | None, path: str):
    """text -> uint32 ids, as the tokenizers library gives them."""
    library: list = []

    def slow(text):
        if not library:
            library.append(open_library(path, spec))
        return np.array(library[0].encode(text, add_special_tokens=False).ids, "<u4")

    if not spec or spec["other"]:  # the engine takes every vocabulary string for one token
        return slow
    engine = merge_engine(spec)

    def fast(text):
        try:
            return engine.encode_to_numpy(text, allowed_special="all")
        except ValueError:  # a run of blanks beyond the engine's stack
            return slow(text)

    return fast


def tokenize_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """Rows ``PIECES``; ``ids`` are little-endian unsigned 32-bit token ids.

    ``part`` is the task that made the piece and ``rank`` counts the earlier
    pieces of the same length in that task.
    """
    spark = docs.sparkSession
    prepare(spark)
    shared = share_spec(spark, tokenizer_path)
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    schema = PIECES.format(id=src.schema["id"].dataType.simpleString())
    kinds = [pa.int32(), pa.int64(), None, pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        encode, part, seen = encoder(shared_spec(shared), tokenizer_path), TaskContext.get().partitionId(), [0] * (capacity + 1)
        end = np.array([end_id], "<u4")
        for b in batches:
            out, rows = [[] for _ in names], []
            for row, text in enumerate(b.column(1).to_pylist()):
                ids = np.concatenate([encode(text), end]).astype("<u4", copy=False)
                cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                for k, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    for col, v in zip(out, (part, seen[y - x], None, k, x, y - x, ids[x:y].tobytes()), strict=True):
                        col.append(v)
                    rows.append(row)
                    seen[y - x] += 1
            arrays = [b.column(0).take(pa.array(rows, pa.int64())) if t is None else pa.array(c, t) for c, t in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return materialize(src.mapInArrow(run, schema), "pieces")


def fill(space, capacity: int):
    """Units of a free space that small pieces are counted on to fill; ``SLACK`` of them stay free."""
    return np.maximum(space - SLACK * capacity // 1024, 0)


def best_column(sizes: np.ndarray, values: np.ndarray, space_value: float, capacity: int) -> tuple[float, list[int]]:
    """The most valuable set of at most three sizes, all over a quarter of the capacity: (value, indices).

    What small pieces fill of the free space is worth ``space_value`` a unit.
    """
    wide, gain = np.append(sizes, 0), np.append(values, 0.0)  # the last entry is no piece at all
    space = np.arange(capacity + 1)
    left = space[:, None] - wide[None, :]
    last = np.where(left >= 0, gain[None, :] + space_value * fill(left, capacity), -np.inf)  # the last piece, by the space it finds
    best = last.max(axis=1)
    room = capacity - wide[:, None] - wide[None, :]
    value = gain[:, None] + gain[None, :] + np.where(room >= 0, best[np.maximum(room, 0)], -np.inf)
    i, j = divmod(int(value.argmax()), len(wide))
    k = int(last[room[i, j]].argmax())
    return float(value[i, j]), [x for x in (i, j, k) if x < len(sizes)]


def configurations(sizes: np.ndarray, demand: np.ndarray, small: int, capacity: int, rounds: int = 4000) -> list[tuple[np.ndarray, int]]:
    """Configurations of at most three sizes and their multiplicities, rounded down.

    Solves min sum x such that the configurations hold ``demand`` pieces of each
    size and their free space, with sequences of small pieces alone, holds
    ``small`` units, by revised simplex; ``best_column`` prices new columns.
    """
    n = len(sizes)
    need = np.append(demand, small / capacity).astype(float)
    columns: list = [[i] * (capacity // int(sizes[i])) for i in range(n)] + [[]]

    def dense(column):
        out = np.zeros(n + 1)
        np.add.at(out, column, 1.0)
        out[n] = fill(capacity - sizes[column].sum(), capacity) / capacity if column else 1.0
        return out

    basis = np.stack([dense(c) for c in columns], axis=1)
    # free space that nothing fills is no loss: the row of small pieces starts covered
    inverse = np.linalg.inv(basis)
    if (inverse @ need)[n] < 0:
        basis[:, n], columns[n] = np.append(np.zeros(n), -1.0), None
        inverse = np.linalg.inv(basis)
    cost = np.array([0.0 if c is None else 1.0 for c in columns])
    for turn in range(rounds):
        duals = cost @ inverse
        if duals[n] < -1e-9:  # unused free space enters
            value, column, entering = -duals[n], None, np.append(np.zeros(n), -1.0)
        else:
            value, column = best_column(sizes, duals[:n], duals[n] / capacity, capacity)
            if value <= 1 + 1e-7:
                break
            entering = dense(column)
        x, step = inverse @ need, inverse @ entering
        ratio = np.where(step > 1e-9, np.maximum(x, 0) / np.where(step > 1e-9, step, 1), np.inf)
        leave = int(ratio.argmin())
        if not np.isfinite(ratio[leave]):
            break
        basis[:, leave], columns[leave], cost[leave] = entering, column, 0.0 if column is None else 1.0
        if turn % 64 == 63:
            inverse = np.linalg.inv(basis)
        else:
            row = inverse[leave] / step[leave]
            inverse -= np.outer(step, row)
            inverse[leave] = row
    x = np.maximum(np.linalg.inv(basis) @ need, 0)
    out = []
    for column, times in zip(columns, x.tolist(), strict=True):
        if column and times >= 1 - 1e-9:
            out.append((np.bincount(column, minlength=n), int(times + 1e-9)))
    return out


class Plan:
    """Placements (length, first rank, sequences, first sequence, offset).

    ``n`` pieces of one length from ``rank`` on go round robin into ``m``
    sequences from ``base`` on, the first of each at ``offset``.
    """

    def __init__(self, capacity: int):
        self.capacity, self.sequences = capacity, 0
        self.used: dict[int, int] = {}
        self.rows: list[tuple[int, int, int, int, int]] = []
        self.open: dict[int, list[tuple[int, int]]] = {}
        self.spaces: list[int] = []

    def put(self, length: int, n: int, base: int, m: int, offset: int) -> None:
        rank = self.used.get(length, 0)
        self.rows.append((length, rank, m, base, offset))
        self.used[length] = rank + n

    def keep(self, base: int, m: int, space: int) -> None:
        if m and space:
            if not self.open.get(space):
                self.spaces.insert(bisect_left(self.spaces, space), space)
            self.open.setdefault(space, []).append((base, m))

    def new(self, m: int) -> int:
        self.sequences += m
        return self.sequences - m

    def best_fit(self, length: int, n: int) -> None:
        """n pieces, each into the fullest sequence that takes it."""
        while n:
            i = bisect_left(self.spaces, length)
            if i == len(self.spaces):
                m = -(-n // (self.capacity // length))
                self.keep(self.new(m), m, self.capacity)
                continue
            space = self.spaces[i]
            base, m = self.open[space].pop()
            if not self.open[space]:
                self.spaces.pop(i)
            k, offset = space // length, self.capacity - space
            whole, rest = min(m, n // k), 0
            if whole:
                self.put(length, whole * k, base, whole, offset)
                self.keep(base, whole, space - k * length)
            n -= whole * k
            if whole < m and n:
                rest, at = n, base + whole
                self.put(length, rest, at, 1, offset)
                self.keep(at, 1, space - rest * length)
                whole, n = whole + 1, 0
            self.keep(base + whole, m - whole, space)


def plan_packing(histogram: dict[int, int], capacity: int = 1024, groups: int = 256) -> Plan:
    """Linear grouping of the lengths over a quarter of the capacity, best fit of the rest.

    Rounding wastes at most a group's width for each large piece; with ``groups``
    equal-cardinality groups that is a few units of a sequence.
    """
    plan, left = Plan(capacity), {n: c for n, c in histogram.items() if c}
    if full := left.pop(capacity, 0):
        plan.put(capacity, full, plan.new(full), full, 0)
    large = sorted((n for n in left if n > capacity // 4), reverse=True)
    total = sum(left[n] for n in large)
    if total:
        # equal-cardinality groups over the sorted pieces; a length may lie in several
        share, queues, at = -(-total // groups), {}, 0
        for n in large:
            c = left[n]
            while c:
                take = min(c, share - at % share)
                top = n if at % share == 0 else top
                queues.setdefault(top, []).append([n, take])
                at, c = at + take, c - take
        sizes = np.array(sorted(queues, reverse=True))
        demand = np.array([sum(c for _, c in queues[s]) for s in sizes.tolist()])
        small = sum(n * c for n, c in left.items() if n <= capacity // 4)
        for config, m in configurations(sizes, demand, small, capacity):
            slots = [int(s) for s, c in zip(sizes, config, strict=True) for _ in range(c)]
            done = 0
            while done < m:
                # the longest run over which every slot takes one actual length
                runs = [(s, queues[s][0][0]) for s in slots if queues[s]]
                if not runs:
                    break
                need: dict[int, int] = {}
                for s, _ in runs:
                    need[s] = need.get(s, 0) + 1
                step = min([m - done, *(max(1, queues[s][0][1] // k) for s, k in need.items())])
                base, offset = plan.new(step), 0
                for s, _ in runs:
                    if not queues[s]:
                        continue
                    n, c = queues[s][0]
                    take = min(step, c)
                    if take < step:  # only with step 1 could a run end inside a slot
                        continue
                    plan.put(n, take, base, take, offset)
                    left[n] -= take
                    offset += n
                    queues[s][0][1] -= take
                    if not queues[s][0][1]:
                        queues[s].pop(0)
                plan.keep(base, step, capacity - offset)
                done += step
    for n in sorted(left, reverse=True):
        if left[n]:
            plan.best_fit(n, left[n])
    return plan


def place(pieces: DataFrame, capacity: int = 1024, groups: int = 256) -> DataFrame:
    """``pieces`` (with part, rank, length) plus sequence_id and offset."""
    spark = pieces.sparkSession
    counts = materialize(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    plan = plan_packing(histogram, capacity, groups)
    before = F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    base = counts.select("part", "length", F.coalesce(before, F.lit(0)).alias("before"))
    rows = np.array(sorted(plan.rows), np.int64).reshape(-1, 5)
    table = spark.sparkContext.broadcast((rows, (rows[:, 0] << 44) | rows[:, 1]))

    def run(batches):
        rows, keys = table.value
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "all_rank"))
            row = rows[np.searchsorted(keys, (length << 44) | rank, "right") - 1]
            turn = rank - row[:, 1]
            cols = [c for n, c in zip(b.schema.names, b.columns, strict=True) if n != "all_rank"]
            names = [n for n in b.schema.names if n != "all_rank"]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(row[:, 3] + turn % row[:, 2]), pa.array(row[:, 4] + turn // row[:, 2] * length)], names=[*names, "sequence_id", "offset"])

    # the table of tasks and lengths grows with the tasks, so it is never broadcast
    ranked = pieces.join(base.hint("shuffle_hash"), ["part", "length"]).withColumn("all_rank", F.col("rank") + F.col("before")).drop("before")
    schema = ", ".join(f"`{n}` {t}" for n, t in ranked.drop("all_rank").dtypes)
    return ranked.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, groups: int = 256, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """Every piece with its ids, its sequence and its place there."""
    return place(tokenize_pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col), capacity, groups)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: (sequence_id, ids), ids joined by offset.

    A sequence has at most ``capacity`` pieces, so its group is bounded.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"))
