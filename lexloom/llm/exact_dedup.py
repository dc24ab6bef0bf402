"""Exact deduplication through an extendible-hash index on shared files.

Main path in DataFrame operations only:

1. ``records``: every row (row id, id, 64-bit hash, byte length, text) is
   written to the shared folder once, so row ids are stable; later steps read
   only the columns they need.
2. ``directory``: a hash's leading bits address its bucket. A bucket whose
   distinct texts exceed ``bucket_bytes`` is overfull and split by one more bit,
   as often as it takes; only a bucket of one single hash cannot be split. The
   directory doubles with the depth up to 2**SLOT_BITS entries (the bound of
   what is broadcast). Beyond it an entry keeps the depth its deepest bucket
   needs, and all buckets under it have that depth.
3. ``build_index``: texts are grouped by (bucket, hash, text), so equality is
   decided on the bytes; map-side combining folds each task's copies before the
   shuffle. Owner tasks take whole buckets (key ranges of the hash), sort them
   and chain the texts that share a hash.
4. ``exact_duplicates``: each row goes through the directory to its bucket and
   chain. A chain of one text needs no further comparison, as all rows' bytes
   were compared when it was built; in longer chains (hash collisions) the
   row's bytes are compared with those of the entries. Classes holding more
   than 1/1000 of all rows (fewer than 1000 of them) are looked up by
   broadcast, so no task receives a hot class.

Null texts count as empty; very long texts are hashed and compared whole; ids
may be null, repeated or of any ordered type; among rows of the same largest id
and text one arbitrary row is kept; an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import materialize, skew_join

SLOT_BITS = 12
BUCKET_BYTES = 4 << 20
KEY = ["bucket", "h"]


def text_hash(text: Column) -> Column:
    return F.xxhash64(text)


def prefix(h: Column, bits: int) -> Column:
    """The first ``bits`` bits of the hash."""
    return F.shiftrightunsigned(h, 64 - bits) if bits else F.lit(0).cast("long")


def records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *also: Column) -> DataFrame:
    """Rows (row_id, id, h, bytes, t, ...) in the shared folder; null texts stay null in t."""
    t = F.col(text_col).cast("string")
    whole = F.coalesce(t, F.lit(""))
    return materialize(
        docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).alias("id"), text_hash(whole).alias("h"),
                    F.octet_length(whole).cast("long").alias("bytes"), t.alias("t"), *also),
        "records")


def directory(rows: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, int]:
    """Rows (slot, depth), and how many leading bits of the hash make a slot."""
    sizes = rows.groupBy("h").agg(F.max("bytes").alias("bytes"))
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    start, deep, splits = 0, min(64, (total // bucket_bytes).bit_length() + 3), None
    while True:
        leaf = sizes.groupBy(prefix(F.col("h"), deep).alias("leaf")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("hashes"))
        above = F.expr(f"CASE WHEN {deep} - d < 64 THEN shiftrightunsigned(leaf, {deep} - d) ELSE 0L END")
        nodes = (
            leaf.withColumn("d", F.explode(F.sequence(F.lit(start), F.lit(deep))))
            .groupBy("d", above.alias("p")).agg(F.sum("bytes").alias("bytes"), F.sum("hashes").alias("hashes"))
        )
        full = materialize(nodes.where((F.col("bytes") > bucket_bytes) & (F.col("hashes") > 1)).select("d", "p"), "splits")
        splits = full if splits is None else splits.unionByName(full)
        open_leaves = full.where(F.col("d") == deep).select(F.col("p").alias("leaf"))
        if open_leaves.isEmpty():
            break
        sizes = sizes.join(open_leaves, prefix(F.col("h"), deep) == F.col("leaf"), "left_semi")
        start, deep = deep + 1, min(64, deep + 16)
    last = splits.agg(F.max("d")).first()[0]
    bits = 0 if last is None else min(last + 1, SLOT_BITS)
    touched = F.expr(f"""CASE WHEN d <= {bits} THEN sequence(shiftleft(p, {bits} - d), shiftleft(p + 1, {bits} - d) - 1)
                         ELSE array(shiftrightunsigned(p, d - {bits})) END""")
    depths = splits.select(F.explode(touched).alias("slot"), "d").groupBy("slot").agg((F.max("d") + 1).alias("depth"))
    slots = rows.sparkSession.range(1 << bits).select(F.col("id").alias("slot"))
    return materialize(slots.join(depths, "slot", "left").select("slot", F.coalesce("depth", F.lit(0)).alias("depth")), "directory"), bits


def with_bucket(rows: DataFrame, slots: DataFrame, bits: int) -> DataFrame:
    """``rows`` plus bucket, named by the first hash of its range."""
    first = F.expr("CASE WHEN depth = 0 THEN 0L ELSE shiftleft(shiftrightunsigned(h, 64 - depth), 64 - depth) END")
    found = rows.withColumn("slot", prefix(F.col("h"), bits)).join(F.broadcast(slots), "slot")
    return found.withColumn("bucket", first).drop("slot", "depth")


def build_index(rows: DataFrame, slots: DataFrame, bits: int) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """(index, chained rows, chained index) over ``records``.

    Index rows: bucket, h, chain, sha, group_size, keep_id, keep_row. The first
    holds the hashes of one text. The others are None without hash collisions;
    else the rows of the chains of several texts, and these chains' entries,
    both with their text in t.
    """
    text = F.coalesce("t", F.lit("")).alias("t")
    sha = F.unhex(F.sha2("t", 256)).alias("sha")
    compared = (
        with_bucket(rows.select("h", text), slots, bits)
        .groupBy(*KEY, "t").agg(F.count("*").alias("group_size")).select(*KEY, sha, "group_size")
    )
    owned = materialize(
        compared.repartition("bucket").sortWithinPartitions(*KEY).withColumn("texts", F.count("*").over(W.partitionBy(*KEY))), "buckets")
    top = F.max(F.struct("id", "row_id")).alias("top")
    entry = [*KEY, "chain", "sha", "group_size", F.col("top.id").alias("keep_id"), F.col("top.row_id").alias("keep_row")]
    index = materialize(
        owned.where("texts = 1").join(rows.groupBy("h").agg(top), "h").withColumn("chain", F.lit(1)).select(*entry), "index")
    collided = owned.where("texts > 1").select("h").distinct()
    if collided.isEmpty():
        return index, None, None
    chained = materialize(with_bucket(rows.select("row_id", "id", "h", text).join(collided, "h", "left_semi"), slots, bits), "chained")
    chain = F.row_number().over(W.partitionBy(*KEY).orderBy("t"))
    entries = chained.groupBy(*KEY, "t").agg(F.count("*").alias("group_size"), top).withColumn("chain", chain)
    return index, chained, materialize(entries.select(*KEY, "t", "chain", sha, "group_size", *entry[-2:]), "chains")


def classes(rows: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per row of ``records``: row_id, id and its index entry."""
    slots, bits = directory(rows, bucket_bytes)
    index, chained, chains = build_index(rows, slots, bits)
    total = rows.count()
    out = ["row_id", "id", *KEY, "chain", "sha", "group_size", "keep_id", "keep_row"]
    keys = with_bucket(rows.select("row_id", "id", "h"), slots, bits)
    found = skew_join(keys, index, KEY, "group_size", total).select(*out)
    if chained is None:
        return found
    return found.unionByName(skew_join(chained, chains, [*KEY, "t"], "group_size", total).select(*out))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per input row: id, h, sha, bucket, chain, keep_id, group_size, kept."""
    return classes(records(docs, id_col, text_col), bucket_bytes).select(
        "id", "h", "sha", "bucket", "chain", "keep_id", "group_size", (F.col("row_id") == F.col("keep_row")).alias("kept"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The rows of ``docs`` that stay, all their columns unchanged.

    One row stays for each distinct text, that of the largest id: the entries of
    the index, which carry their row here. Rows meet by bucket, hash and the
    bytes of their text, and all but one go before and in that one exchange.
    """
    others = [c for c in docs.columns if c != text_col]
    rows = records(docs, id_col, text_col, F.struct(*[F.col(f"`{c}`") for c in others]).alias("rest"))
    slots, bits = directory(rows, bucket_bytes)
    own = F.struct(F.col("t").isNull().alias("none"), "rest")
    keyed = with_bucket(rows.select("h", F.coalesce("t", F.lit("")).alias("t"), own.alias("own"), F.struct("id", "row_id").alias("at")), slots, bits)
    kept = keyed.groupBy(*KEY, "t").agg(F.max_by("own", "at").alias("own"))
    kind = docs.schema[text_col].dataType
    text = F.when(~F.col("own.none"), F.col("t")).cast(kind)
    return kept.select(*[text.alias(c) if c == text_col else F.col(f"own.rest.`{c}`") for c in docs.columns])
