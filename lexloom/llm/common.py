"""Shared pieces of the training-data operators.

* ``shared_root`` / ``materialize``: intermediate tables live in the folder
  that ``spark.checkpoint.dir`` names, so that they outlive any executor.
* ``connected_components``: star contraction with aggregates and joins only.
* ``lower_words``: the byte-level word splitter several operators share.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches are cut by rows; texts can be long, so batches are kept short.
ARROW_ROWS = 256

_roots: dict[str, str] = {}
_shipped: set[str] = set()


def prepare(spark: SparkSession) -> None:
    """Session settings the Python-backed operators rely on, and their code for the executors."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.add(app)
        package = Path(__file__).resolve().parent.parent
        name = Path(tempfile.mkdtemp(prefix="lexloom-code-")) / "lexloom-code.zip"
        with zipfile.ZipFile(name, "w") as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f.relative_to(package.parent))
        spark.sparkContext.addPyFile(str(name))


def shared_root(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``.

    Only in local mode, where that setting is absent (tests), a temporary folder
    of the driver is used, which the executors of local mode share by definition.
    """
    app = spark.sparkContext.applicationId
    if app not in _roots:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            base = tempfile.mkdtemp(prefix="lexloom-")
            spark.sparkContext.setCheckpointDir(base)
        _roots[app] = f"{base.rstrip('/')}/lexloom-{uuid.uuid4().hex}"
        atexit.register(_forget, weakref.ref(spark), _roots[app])
    return _roots[app]


def _forget(ref, root: str) -> None:
    spark = ref()
    try:
        if spark is not None:
            delete(spark, root)
    except Exception:  # noqa: BLE001  the context may be gone at exit
        pass


def _path(spark: SparkSession, path: str):
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jpath


def delete(spark: SparkSession, path: str) -> None:
    fs, jpath = _path(spark, path)
    fs.delete(jpath, True)


def write_bytes(spark: SparkSession, path: str, blocks) -> None:
    """Write byte blocks as one file through Hadoop's file system API."""
    fs, jpath = _path(spark, path)
    out = fs.create(jpath, True)
    for block in blocks:
        out.write(bytearray(block))
    out.close()


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts the lineage."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    writer = df.write.mode("overwrite").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph: rows (node, root), root the smallest node.

    Alternates a large-star and a small-star step until the edge set is stable;
    every step is a min-aggregate (map-side combined) and a join, no group is
    ever collected. Nodes without edges do not appear. Each round is written to
    the shared folder, and rounds no longer needed are deleted. An empty edge
    set gives an empty result; self loops and repeated edges are harmless.
    """
    spark = edges.sparkSession

    def settle(df: DataFrame) -> tuple[DataFrame, str, tuple]:
        table, path = materialize_at(df.where("u > v").distinct(), "edges")
        mark = table.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return table, path, tuple(mark)

    cur, path, mark = settle(
        edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
    )
    old: list[str] = []
    for _ in range(max_rounds):
        if mark[0] == 0:
            break
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large, large_path, _ = settle(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.select("u", F.col("m").alias("v")))
        nxt, nxt_path, nxt_mark = settle(small)
        old += [path, large_path]
        for p in old:
            delete(spark, p)
        old = []
        done = nxt_mark == mark
        cur, path, mark = nxt, nxt_path, nxt_mark
        if done:
            break
    else:
        raise RuntimeError("components did not settle")
    stars = cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())


def byte_table(keep: str) -> bytes:
    """Translation table: A-Z to a-z; 'alnum' also maps other ASCII to blanks."""
    table = bytearray(range(256))
    table[65:91] = bytes(range(97, 123))
    if keep == "alnum":
        for b in range(128):
            if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122):
                table[b] = 32
    return bytes(table)


#: Words are runs of 0-9, a-z and bytes above 127.
ALNUM = byte_table("alnum")
#: Words are runs of anything but the six ASCII blanks; only A-Z are lowered.
BLANKS = byte_table("all")


def lower_words(text: str | None, table: bytes) -> list[bytes]:
    """Lower-cased words as UTF-8 bytes; None and empty text have none.

    ``bytes.split()`` splits at exactly 0x20 and 0x09-0x0D, and no byte of a
    multi-byte UTF-8 character lies below 0x80.
    """
    return text.encode("utf-8", "surrogatepass").translate(table).split() if text else []


def skew_join(rows: DataFrame, table: DataFrame, on: list[str], size_col: str, total: int, share: int = 1000) -> DataFrame:
    """Inner join of ``rows`` with ``table``, which has one row per key.

    ``size_col`` of ``table`` is the number of rows with that key. Keys with
    more than 1/``share`` of all ``total`` rows (fewer than ``share`` keys, a
    proven bound) are joined by broadcast, the rest by a shuffle, so no task
    receives a hot key.
    """
    hot = table.where(F.col(size_col) * share > total)
    cold = table.where(F.col(size_col) * share <= total)
    return rows.join(F.broadcast(hot), on).unionByName(
        rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on)
    )
