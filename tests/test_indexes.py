"""The stored text and vector indexes against plain search over the same rows."""

import random

import pytest
from pyspark.sql import functions as F

from lexloom import catalog
from lexloom.operators import retrieval, text_index, vector_index
from lexloom.sources.workspace import built_once, shared_folder


def texts(n, seed=1):
    """A few words in nearly all texts, many in few; a third of the texts of one length."""
    rng = random.Random(seed)
    common, rare = ["der", "die", "Und"], [f"w{i}" for i in range(60)]
    out = []
    for i in range(n):
        k = 8 if i % 3 == 0 else rng.randrange(1, 60)
        out.append((i, " ".join(rng.choice(common) if rng.random() < 0.5 else rare[int(60 * rng.random() ** 2)] for _ in range(k))))
    return [*out, (n, None), (n + 1, ""), (n + 2, "der der der w1"), (n + 3, out[0][1])]


QUESTIONS = ["der die", "w1 w2", "und", "w40 der w3", "nothing here", "", "die die DIE w5"]


@pytest.fixture(scope="module")
def corpus(spark):
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in texts(500)], "id long, text string, term string, n int").cache()
    return df, text_index.build(df, shared_folder(spark, "text"), buckets=4, slot_rows=40)


def asked(spark):
    return spark.createDataFrame(list(enumerate(QUESTIONS)), "qid long, question string")


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.mark.parametrize("mode", ["and", "or"])
@pytest.mark.parametrize("n_queries", [len(QUESTIONS), None])
def test_text_index_ranks_as_plain_bm25(spark, corpus, mode, n_queries):
    df, index = corpus
    q = asked(spark)
    n, mean = retrieval.corpus_stats(df)
    assert (index.n, round(index.mean, 9)) == (n, round(mean, 9))
    plain = retrieval.postings(df)
    for k in (3, 50):
        want = rows(retrieval.lexical_topk(plain, n, mean, q, k, mode), "qid", "rank", "id", "score")
        assert rows(text_index.topk(index, q, k, mode, n_queries=n_queries, first_slots=2), "qid", "rank", "id", "score") == want
    assert rows(text_index.match(index, q, mode, n_queries=n_queries), "qid", "id", "hits") == rows(retrieval.lexical_match(plain, q, mode), "qid", "id", "hits")


def test_slots_are_bounded_and_blocks_pruned(spark, corpus):
    df, index = corpus
    blocks = index.blocks()
    assert blocks.select("slot").distinct().count() >= 10
    assert blocks.agg(F.max("n")).first()[0] <= 200  # one length holds a third of the texts: its class has its own slots
    docs = blocks.select(F.explode("ids").alias("id"), "slot").distinct().groupBy("id").count()
    assert docs.agg(F.max("count")).first()[0] == 1
    plan = text_index.batch_blocks(index, retrieval.query_terms(asked(spark)).select("term"), len(QUESTIONS))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert "In(term" in plan


def test_bounds_leave_slots_unread(spark):
    """One document stands out: after its slot is scored, no other slot can reach it."""
    df = spark.createDataFrame([(i, "x " + " ".join(f"f{j}" for j in range(i % 50 + 5))) for i in range(400)] + [(1000, "x x x")], "id long, text string")
    index = text_index.build(df, shared_folder(spark, "text"), slot_rows=20)
    q = spark.createDataFrame([(0, "x")], "qid long, question string")
    assert rows(text_index.topk(index, q, 1, n_queries=1, first_slots=1), "qid", "id") == [(0, 1000)]
    best = index.blocks().where("term = 'x'").orderBy(F.desc("most")).select("most").collect()
    idf = 1  # bounds and scores share it
    score = retrieval.K1 * 0 + 3 * (retrieval.K1 + 1) / (3 + retrieval.K1 * (1 - retrieval.B + retrieval.B * 3 / index.mean)) * idf
    assert best[0][0] == pytest.approx(score) and sum(b[0] >= score - 1e-6 for b in best) == 1


def test_empty_text_index(spark):
    index = text_index.build(spark.createDataFrame([], "id long, text string"), shared_folder(spark, "text"))
    assert index.n == 0
    assert text_index.topk(index, asked(spark)).count() == 0
    assert text_index.match(index, asked(spark), "or", n_queries=7).count() == 0


def test_index_is_built_once_per_state_of_the_files(spark, tmp_path):
    path, calls = str(tmp_path / "t"), []
    spark.range(3).selectExpr("id", "'a b' AS text").coalesce(1).write.parquet(path)
    build = lambda p: calls.append(p)
    assert built_once(spark.read.parquet(path), "x", build) == built_once(spark.read.parquet(path), "x", build)
    spark.range(4).selectExpr("id", "'a b' AS text").coalesce(1).write.mode("append").parquet(path)
    built_once(spark.read.parquet(path), "x", build)
    assert len(calls) == 2


def vectors(n, dim=8, seed=1):
    """Some clustered, a third of them equal, some null."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        v = [rng.gauss(3 if j == i % 5 else 0, 1) for j in range(dim)] if i % 3 else [1.0] * dim
        norm = sum(x * x for x in v) ** 0.5
        out.append((i, [x / norm for x in v]))
    return [*out, (n, None), (n + 1, None)]


@pytest.fixture(scope="module")
def space(spark):
    df = spark.createDataFrame(vectors(900), "id long, embedding array<float>").cache()
    return df, vector_index.build(df, shared_folder(spark, "vectors"), 8)


@pytest.mark.parametrize(("block", "asked_rows"), [(16_384, 2048), (50, 7)])
def test_vector_index_is_exact(spark, space, monkeypatch, block, asked_rows):
    monkeypatch.setattr(vector_index, "BLOCK", block)
    monkeypatch.setattr(vector_index, "ASKED", asked_rows)
    df, index = space
    q = df.where("id % 30 = 1 AND embedding IS NOT NULL").select(F.col("id").alias("qid"), F.col("embedding").alias("query_vector"))
    want = rows(retrieval.dense_topk(df, q, 20, digits=6), "qid", "rank", "id")
    assert rows(vector_index.topk(index, q, 20, probes=2, digits=6), "qid", "rank", "id") == want
    near = vector_index.topk(index, q, 20, probes=4, exact=False, digits=6)
    truth = retrieval.dense_topk(df, q, 20, digits=6)
    assert vector_index.recall(near, truth).first()[0] >= 0.9


def test_cells_prune_partitions(spark, space):
    df, index = space
    q = df.where("id = 1").select(F.col("id").alias("qid"), F.col("embedding").alias("query_vector"))
    out = vector_index.topk(index, q, 5, probes=1, exact=False)
    plan = out._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [(cell" in plan or "PartitionFilters: [cell" in plan
    assert out.count() == 5


def test_vector_index_without_vectors(spark):
    df = spark.createDataFrame([(1, None)], "id long, embedding array<float>")
    index = vector_index.build(df, shared_folder(spark, "vectors"))
    q = spark.createDataFrame([(0, [1.0, 0.0])], "qid long, query_vector array<float>")
    assert vector_index.topk(index, q).count() == 0


def test_registered_search_asks_every_fiftieth_vector(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    out = catalog.QUERIES["dense_topk_cells"](spark, sf)
    assert out.select("qid").distinct().count() == e.where("vec_id % 50 = 0").count()
