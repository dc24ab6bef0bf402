"""SimHash near-duplicates with the generalised pigeonhole principle.

Fingerprints: a bit is 1 if it is set in over half of the text's shingle hashes
(XXH64, seed 42). Fingerprints at most ``max_bits`` apart are linked.

Search, over distinct fingerprints only:

1. A bounded sample (``SAMPLE`` fingerprints, smallest hashes first) gives the
   correlation of the bits and candidate estimates. Correlated bits are grouped
   into partitions.
2. If the thresholds t_i of m partitions sum to max_bits - m + 1, two linked
   fingerprints agree within t_i in some partition i. Dynamic programming picks
   the t_i (-1: the partition is not probed) of least estimated cost, probes
   plus candidates, over several m.
3. Fingerprints are indexed by each partition's bits, probed with all values
   within t_i, and candidates are verified by their full distance.

A bucket of more than ``BUCKET`` fingerprints would give a quadratic number of
candidates. Its members, and the fingerprints that probe it, are instead linked
through the points one bit away from them: two fingerprints share such a point
exactly if they are at most two bits apart, so linking each point's members to
its smallest one is exact and linear. (For max_bits 1 each fingerprint itself
is the only centre; more than 2 bits are not supported.)

Null and empty texts have fingerprint zero and are linked like any other; short
texts are one shingle; repeated rows and ids are kept as they are; an empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, connected_components, lower_words, materialize, prepare, skew_join

SAMPLE = 2048
BUCKET = 32
SEED = 42
#: Cost of a probe row, in candidate rows.
PROBE_COST = 2.0


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """SimHash of one text, unsigned."""
    words = lower_words(text, BLANKS)
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    k = min(shingle, len(words))
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1:].tolist(), strict=True)], "<u8")
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # bounded memory for very long texts
        part = hashes[at:at + (1 << 16)]
        total += np.unpackbits(part.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * total > len(hashes)).astype("u1")
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, h, fp), fp as a signed 64-bit number, h the text's hash, written to the shared folder."""
    prepare(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("h"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in b.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps)], names=["id", "h", "fp"])

    return materialize(src.mapInArrow(run, "id long, h long, fp long"), "fingerprints")


def group_bits(bits: np.ndarray, m: int) -> list[list[int]]:
    """Partitions of 64 bits: each grows by the bit most correlated with it."""
    x = bits - bits.mean(axis=0)
    norm = np.sqrt((x * x).sum(axis=0)) + 1e-9
    corr = np.abs((x.T @ x) / norm / norm[:, None])
    left, out = list(range(64)), []
    for i in range(m):
        size = (64 - sum(map(len, out))) // (m - i)
        group = [left.pop(int(np.argmax([corr[b][left].sum() for b in left])))]
        while len(group) < size:
            group.append(left.pop(int(np.argmax([corr[b][group].sum() for b in left]))))
        out.append(sorted(group))
    return out


def allocate(cost: list[dict[int, float]], total: int) -> tuple[float, list[int]]:
    """Thresholds that sum to ``total`` with the least summed cost."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for options in cost:
        step: dict[int, tuple[float, list[int]]] = {}
        for s, (c, chosen) in best.items():
            for t, extra in options.items():
                if s + t not in step or c + extra < step[s + t][0]:
                    step[s + t] = (c + extra, [*chosen, t])
        best = step
    return best[total]


def plan_partitions(sample: list[int], n: int, max_bits: int = 2) -> list[tuple[int, int]]:
    """(bit mask, threshold) of each probed partition."""
    fps = np.array(sample, np.int64).view(np.uint64)
    if len(fps) < 2:
        return [((1 << 64) - 1, max_bits)] if max_bits == 0 else [((1 << 32) - 1, 0), (((1 << 32) - 1) << 32, max_bits - 1)]
    bits = np.unpackbits(fps.view("u1").reshape(-1, 8), axis=1, bitorder="little").astype(float)
    half = len(fps) // 2
    other = np.roll(np.arange(len(fps)), half)
    apart = np.concatenate([bits != bits[np.roll(other, k)] for k in range(min(64, half))])
    found = None
    for m in range(1, 5):
        groups, cost = group_bits(bits, m), []
        for g in groups:
            near, options = apart[:, g].sum(axis=1), {-1: 0.0}
            for t in range(max_bits + 1):
                probes = sum(_choose(len(g), k) for k in range(t + 1))
                # a sampled share, but no less than that of independent even bits
                share = max((near <= t).mean(), probes / 2.0 ** len(g))
                options[t] = n * (PROBE_COST * probes + share * n)
            cost.append(options)
        value, chosen = allocate(cost, max_bits - m + 1)
        if found is None or value < found[0]:
            found = (value, [(sum(1 << b for b in g), t) for g, t in zip(groups, chosen, strict=True) if t >= 0])
    return found[1]


def _choose(n: int, k: int) -> int:
    out = 1
    for i in range(k):
        out = out * (n - i) // (i + 1)
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _variants(mask: int, threshold: int) -> list[int]:
    """All flips of at most ``threshold`` bits of the mask."""
    bits = [1 << b for b in range(64) if mask >> b & 1]
    out = {0}
    for _ in range(threshold):
        out |= {v ^ b for v in out for b in bits}
    return sorted(v for v in out if bin(v).count("1") <= threshold)


def near_edges(distinct: DataFrame, max_bits: int = 2) -> DataFrame:
    """Rows (src, dst) that connect all linked fingerprints (column fp, distinct)."""
    if max_bits not in (1, 2):
        raise ValueError("max_bits must be 1 or 2")
    n = distinct.count()
    sample = [r["fp"] for r in distinct.orderBy(F.xxhash64("fp")).limit(SAMPLE).collect()]
    parts = plan_partitions(sample, n, max_bits)
    entry = F.explode(F.array(*[
        F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(_signed(mask))).alias("key"))
        for i, (mask, _) in enumerate(parts)
    ])).alias("e")
    index = distinct.select("fp", entry).select("fp", "e.*")
    sizes = materialize(index.groupBy("part", "key").agg(F.count("*").alias("size")).where("size > 1" if all(t == 0 for _, t in parts) else "size > 0"), "buckets")
    if all(t == 0 for _, t in parts):
        probes = index.withColumnRenamed("fp", "q")
    else:
        def probed(i: int, mask: int, t: int):
            key = F.col("fp").bitwiseAND(F.lit(_signed(mask)))
            values = F.array(*[F.lit(_signed(v)) for v in _variants(mask, t)])
            return F.transform(values, lambda v: F.struct(F.lit(i).alias("part"), key.bitwiseXOR(v).alias("key")))

        flips = F.explode(F.concat(*[probed(i, mask, t) for i, (mask, t) in enumerate(parts)])).alias("e")
        probes = distinct.select(F.col("fp").alias("q"), flips).select("q", "e.*")
    on = ["part", "key"]
    members = skew_join(index, sizes, on, "size", n * len(parts))
    big = sizes.where(F.col("size") > BUCKET)
    small = members.where(F.col("size") <= BUCKET)
    pairs = (
        probes.join(small, on).where("q <> fp")
        .where(F.bit_count(F.col("q").bitwiseXOR(F.col("fp"))) <= max_bits)
        .select(F.greatest("q", "fp").alias("src"), F.least("q", "fp").alias("dst"))
    )
    dense = members.where(F.col("size") > BUCKET).select("fp")
    if not all(t == 0 for _, t in parts):
        dense = dense.unionByName(skew_join(probes, big, on, "size", n * len(parts)).select(F.col("q").alias("fp")))
    dense = dense.distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << b)) for b in range(64)])
    if max_bits == 1:
        # centres are the fingerprints themselves: a neighbour one bit away must be one of them
        points = dense.select("fp", F.explode(F.transform(flips, lambda v: F.col("fp").bitwiseXOR(v))).alias("point"))
        stars = points.join(dense.select(F.col("fp").alias("point")), "point").select(F.col("fp").alias("src"), F.col("point").alias("dst"))
    else:
        points = dense.select("fp", F.explode(F.transform(flips, lambda v: F.col("fp").bitwiseXOR(v))).alias("point"))
        centre = points.groupBy("point").agg(F.min("fp").alias("dst"), F.count("*").alias("c")).where("c > 1")
        stars = points.join(centre, "point").select(F.col("fp").alias("src"), "dst")
    return pairs.unionByName(stars).where("src <> dst").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, h, fp, root, component): component is the smallest id reachable.

    ``root`` names the group, also where ids are missing or repeated.
    """
    marked = fingerprints(docs, shingle, id_col, text_col)
    classes = materialize(marked.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("copies")), "classes")
    roots = connected_components(near_edges(classes.select("fp"), max_bits))
    rooted = classes.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", "copies", F.coalesce("root", "fp").alias("root"))
    rooted = materialize(rooted, "rooted")
    low = rooted.groupBy("root").agg(F.min("least").alias("component"), F.count("*").alias("size"))
    named = materialize(skew_join(rooted, low, ["root"], "size", rooted.count()).select("fp", "copies", "root", "component"), "named")
    return skew_join(marked, named, ["fp"], "copies", marked.count()).select("id", "h", "fp", "root", "component")


def drop_near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each group, that of the smallest id, columns unchanged.

    A group without ids keeps any one row, equal rows are folded to one.
    """
    first = F.struct(F.col("id").isNull().alias("none"), "id", "h")
    groups = near_duplicates(docs, shingle, max_bits, id_col, text_col).groupBy("root", "id", "h").agg(F.count("*").alias("rows"))
    keep = materialize(groups.groupBy("root").agg(F.min_by(F.struct("id", "h", "rows"), first).alias("k")).select("k.*"), "keep")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(row, F.col(id_col).cast("long").alias("k_id"), F.xxhash64(F.col(text_col).cast("string")).alias("k_h"))
    on = [F.col("k_id").eqNullSafe(F.col("id")), F.col("k_h") == F.col("h")]
    stay = keyed.join(keep.where("rows = 1"), on, "left_semi")
    if not keep.where("rows > 1").isEmpty():
        again = keyed.join(keep.where("rows > 1"), on, "left_semi")
        stay = stay.unionByName(again.dropDuplicates(["k_id", "k_h"]))
    return stay.select("row.*")
