"""A stored vector index: k-means cells as partitions, searched by matrix products.

``build`` fits the centres on a bounded sample, places every vector in its
nearest cell and writes the vectors partitioned by cell, with one row per cell
(centre, radius, size) beside them.

``topk`` compares each question with its ``probes`` nearest cells. Then either
that is the answer (``exact`` off: recall is what the probes give), or further
cells are read unless no member can reach the k-th similarity found:
q.x = q.c + q.(x - c) is at most q.c + |q| times the cell's radius.

Cells are read by a partition filter on those that some question needs. A cell's
vectors are split into blocks of at most ``BLOCK`` rows and its questions into
blocks of ``ASKED``, so no group grows with a popular cell; a group is one matrix
product and returns at most k rows a question.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .retrieval import fit_cells, top_k

CELLS, SAMPLE = 64, 20_000
BLOCK, ASKED = 16_384, 2048
PROBES = 8


@dataclass(frozen=True)
class VectorIndex:
    spark: SparkSession
    path: str
    centres: np.ndarray
    radius: np.ndarray
    size: np.ndarray
    id_type: str

    def vectors(self) -> DataFrame:
        return self.spark.read.schema(f"id {self.id_type}, embedding array<float>, away double, cell int").parquet(f"{self.path}/vectors")


def build(chunks: DataFrame, path: str, cells: int = CELLS, sample: int = SAMPLE) -> VectorIndex:
    """Writes the index of all chunks (id, embedding); rows without a vector have no place in it."""
    spark = chunks.sparkSession
    vectors = chunks.where("embedding IS NOT NULL").select("id", F.col("embedding").cast("array<float>").alias("embedding"))
    centres = np.array(fit_cells(vectors, cells, sample), np.float32)
    id_type = dict(vectors.dtypes)["id"]

    def place(batches):
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(1))
                cell = (x @ centres.T).argmax(axis=1)
                away = np.sqrt(((x - centres[cell]).astype(float) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell.astype("int32")), pa.array(away)], names=["id", "embedding", "cell", "away"])

    placed = vectors.mapInArrow(place, f"id {id_type}, embedding array<float>, cell int, away double")
    if not len(centres):
        placed = vectors.selectExpr("id", "embedding", "0 AS cell", "0D AS away")
    placed.write.mode("overwrite").partitionBy("cell").option("compression", "zstd").parquet(f"{path}/vectors")
    empty = VectorIndex(spark, path, centres, np.zeros(0), np.zeros(0, int), id_type)
    if len(centres):
        sizes = empty.vectors().groupBy("cell").agg(F.max("away").alias("radius"), F.count("*").alias("n"))  # a row a cell
        at = spark.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(centres)], "cell int, centre array<float>")
        at.join(sizes, "cell").withColumn("id_type", F.lit(id_type)).coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")
    return open_index(spark, path) if len(centres) else empty


def open_index(spark: SparkSession, path: str) -> VectorIndex:
    rows = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()
    dim, last = len(rows[0]["centre"]), rows[-1]["cell"]
    centres, radius, size = np.zeros((last + 1, dim), np.float32), np.zeros(last + 1), np.zeros(last + 1, int)
    for r in rows:
        centres[r["cell"]], radius[r["cell"]], size[r["cell"]] = r["centre"], r["radius"], r["n"]
    return VectorIndex(spark, path, centres, radius, size, rows[0]["id_type"])


def matrix(column) -> np.ndarray:
    """Rows of a list column as a matrix, without copying values one by one."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def nearest(index: VectorIndex, queries: DataFrame, probes: int) -> DataFrame:
    """(qid, query_vector, cell, most, near): every non-empty cell of a question with what it can reach at most; near: among the ``probes`` nearest."""
    centres, radius, size = index.centres.astype(float), index.radius, index.size
    qid_type = dict(queries.dtypes)["qid"]

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            q = matrix(b.column(1)).astype(float)
            dots = np.where(size > 0, q @ centres.T, -np.inf)
            order = np.argsort(-dots, axis=1, kind="stable")
            place = np.empty_like(order)
            np.put_along_axis(place, order, np.arange(len(size))[None, :].repeat(len(q), 0), axis=1)
            most = dots + np.sqrt((q * q).sum(axis=1))[:, None] * radius
            row, cell = np.nonzero(size[None, :].repeat(len(q), 0) > 0)
            yield pa.RecordBatch.from_arrays([
                b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)), pa.array(cell.astype("int32")), pa.array(most[row, cell]), pa.array(place[row, cell] < probes)],
                names=["qid", "query_vector", "cell", "most", "near"])

    cast = queries.select("qid", F.col("query_vector").cast("array<float>").alias("query_vector"))
    return cast.mapInArrow(run, f"qid {qid_type}, query_vector array<float>, cell int, most double, near boolean")


def search_cells(index: VectorIndex, wanted: DataFrame, k: int, digits: int) -> DataFrame:
    """(qid, id, sim): for each block of a wanted cell, the best k of each of its questions. wanted: (qid, query_vector, cell)."""
    per_cell = {r["cell"]: r["n"] for r in wanted.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row a cell
    cells = sorted(per_cell)
    id_type, qid_type = index.id_type, dict(wanted.dtypes)["qid"]
    if not cells:
        return index.spark.createDataFrame([], f"qid {qid_type}, id {id_type}, sim double")
    parts = lambda sizes, of: F.coalesce(F.create_map(*[F.lit(v) for c in cells for v in (c, max(1, -(-int(sizes[c]) // of)))])[F.col("cell")], F.lit(1))
    blocks, asked = parts(index.size, BLOCK), parts(per_cell, ASKED)
    own = lambda key, n: F.pmod(F.xxhash64(key), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), (n - 1).cast("int")))
    x = index.vectors().where(F.col("cell").isin(cells)).select("cell", "id", "embedding", own("id", blocks).alias("block"), every(asked).alias("asked"))
    q = wanted.select("cell", "qid", "query_vector", own("qid", asked).alias("asked"), every(blocks).alias("block"))

    def best(left, right):
        if not left.num_rows or not right.num_rows:
            return pa.table({"qid": right.column("qid").slice(0, 0), "id": left.column("id").slice(0, 0), "sim": pa.array([], pa.float64())})
        a, b = matrix(right.column("query_vector")).astype(float), matrix(left.column("embedding")).astype(float)
        sim = np.round(a @ b.T, digits)
        n = min(k, sim.shape[1])
        ids = left.column("id").combine_chunks()
        rank = np.empty(len(ids), np.int64)
        rank[pa.compute.sort_indices(ids).to_numpy()] = np.arange(len(ids))
        rows, cols = [], []
        for i in range(len(sim)):
            cut = -np.partition(-sim[i], n - 1)[n - 1]
            c = np.flatnonzero(sim[i] >= cut)  # ties at the cut are decided by id
            cols.append(c[np.lexsort((rank[c], -sim[i][c]))[:n]])
            rows.append(np.full(n, i))
        r, c = np.concatenate(rows), np.concatenate(cols)
        return pa.table({"qid": right.column("qid").combine_chunks().take(pa.array(r)), "id": ids.take(pa.array(c)), "sim": pa.array(sim[r, c])})

    by = ["cell", "block", "asked"]
    return x.groupBy(*by).cogroup(q.groupBy(*by)).applyInArrow(best, f"qid {qid_type}, id {id_type}, sim double")


def topk(index: VectorIndex, queries: DataFrame, k: int = 50, probes: int = PROBES, exact: bool = True, digits: int = 9) -> DataFrame:
    """(qid, id, sim, rank) of questions (qid, query_vector) by inner product; ties by id."""
    if not len(index.centres):
        return queries.select("qid").crossJoin(index.vectors().select("id").limit(0)).selectExpr("qid", "id", "0D AS sim", "1 AS rank").limit(0)
    reach = nearest(index, queries, probes)
    order = ("qid", F.desc("sim"), F.asc("id"))
    first = top_k(search_cells(index, reach.where("near").select("qid", "query_vector", "cell"), k, digits), k, *order).drop("rank")
    if exact and probes < int((index.size > 0).sum()):
        floor = first.groupBy("qid").agg(F.min("sim").alias("floor"), F.count("*").alias("n")).where(F.col("n") >= k).select("qid", "floor")
        more = reach.where("NOT near").join(floor, "qid", "left").where(F.col("floor").isNull() | (F.col("most") >= F.col("floor") - 1e-6))
        first = first.unionByName(search_cells(index, more.select("qid", "query_vector", "cell"), k, digits))
    return top_k(first, k, *order)


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(recall): the share of the true (qid, id) pairs that were found."""
    return truth.join(found.select("qid", "id", F.lit(1).alias("hit")), ["qid", "id"], "left").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
