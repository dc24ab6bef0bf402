"""Faults found on odd rows and larger tables, one test each."""

import datetime as dt
import time

from pyspark.sql import functions as F

from lexloom import catalog, catalog_more  # noqa: F401  registers further queries
from lexloom.operators import evaluation, normalize, ordered, text_index
from lexloom.sources.workspace import shared_folder


def test_equal_ranks_keep_the_order_of_the_table(spark, tmp_path):
    rows = [(9, 0.5, None, "7", "7"), (1, 0.5, 0.5, "7", "7"), (1, 0.5, None, "7", "7")]
    schema = "rank int, score double, sim double, row_article string, article string, nr long, stored long"
    df = spark.createDataFrame([(*r, k, i) for k in range(50) for i, r in enumerate(rows)], schema)
    for given in (df, df.orderBy("stored"), df.orderBy(df["stored"].desc())):
        got = evaluation.basis_path(given.repartition(7, "row_article", "stored"), tie="stored").collect()
        assert len(got) == 50 and {(r["hit"], r["path"]) for r in got} == {(True, "dense")}
    none = spark.createDataFrame([(1, 0.5, None, "7", "7", None, 0), (1, 0.5, None, "8", "7", 3, 0)], schema)
    assert sorted(((r["nr"], r["hit"], r["path"]) for r in evaluation.basis_path(none, tie="stored").collect()), key=str) == [(3, False, None), (None, False, None)]


def test_basis_paths_takes_the_first_stored_of_equal_rows(spark, tmp_path):
    lines = [(o, 1 + o % 3, flag, status) for o in range(40) for flag, status in ([("A", "O"), ("R", "F"), ("N", "F")] if o % 2 else [("N", "F"), ("A", "O")])]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_returnflag string, l_linestatus string").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {r["nr"]: r["path"] for r in catalog.QUERIES["basis_paths"](spark, str(tmp_path)).collect()}
    assert got == {o: "lexical" if o % 2 else "dense" for o in range(40)}


def test_similarities_are_rounded_as_doubles(spark):
    # 0.06835 * 10000 lies below its tie, 0.00025 * 10000 on it
    df = spark.createDataFrame([("a", 0.06835), ("a", 0.0683), ("b", 0.00025), ("b", 0.0003), ("b", -0.00025)], "category string, max_similarity double")
    assert {r["category"]: r["distinct_values"] for r in evaluation.similarity_diagnostics(df).collect()} == {"a": 1, "b": 2}


def test_rows_of_equal_time_stay_in_their_session(spark):
    at = dt.datetime(2024, 4, 11, 9, 42, 2)
    rows = [(26, at - dt.timedelta(days=2), 1), *[(26, at, i) for i in (4, 3, 2)]]
    got = ordered.sessions(spark.createDataFrame(rows, "u long, ts timestamp, id long"), "u", "ts", "id", 600).collect()
    assert sorted((r["session_start"], r["session_end"], r["n"]) for r in got) == [(rows[0][1], rows[0][1], 1), (at, at, 3)]


def test_slots_hold_a_bounded_number_of_words(spark):
    # a hundred long texts and many short ones: before, slots were bounded by documents alone
    df = spark.createDataFrame([(i, " ".join(f"w{(i * 7 + j) % 300}" for j in range(1000 if i < 100 else 5))) for i in range(600)], "id long, text string")
    index = text_index.build(df, shared_folder(spark, "text"), buckets=4, slot_words=8000)
    words = index.blocks().select("slot", F.explode(F.arrays_zip("ids", "tfs")).alias("p")).groupBy("slot").agg(F.sum("p.tfs").alias("n"))
    assert words.agg(F.sum("n")).first()[0] == 100 * 1000 + 500 * 5
    assert words.agg(F.max("n")).first()[0] <= 3 * 8000


def test_the_consolidated_key_is_found_once_an_act(spark):
    # before, every amendment went over all consolidated texts again: 16 million keys here
    refs = spark.range(1).select(F.create_map(*[x for name, low in ((normalize.CONSOLIDATED, 0), (normalize.AMENDING, 2000)) for x in (
        F.lit(name), F.transform(F.sequence(F.lit(low), F.lit(low + 3999)), lambda i: F.struct(F.concat(F.lit("DU/2001/"), i.cast("string")).alias("id"), F.lit(None).cast("string").alias("date"))))]).alias("r"))
    at = time.monotonic()
    got = refs.select(F.size(normalize.unabsorbed_amendments(F.col("r"), normalize.newest_consolidated(F.col("r")))).alias("n")).first()["n"]
    assert got == 2000 and time.monotonic() - at < 15


def test_duplicate_units_are_sorted_in_bounded_tasks(spark):
    u = spark.range(4000).select((F.col("id") % 50).alias("doc_id"), F.lit("1").alias("article"), (F.col("id") % 20).cast("string").alias("paragraph"), F.lit(None).cast("string").alias("point"), F.col("id").alias("pos"))
    got = normalize.mark_duplicate_units(u, task_rows=100)
    assert got.rdd.getNumPartitions() == 40
    assert got.where("doc_id = 3").orderBy("pos").first()["variant"] == " (wariant 1/40)"


def test_python_workers_get_short_batches(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        pages = spark.range(3000).select("id", F.lit("<p>a</p>").alias("html"))
        assert normalize.with_plain_text(pages, "html").where("plain_text = 'a'").count() == 3000
        assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 512
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")  # a smaller bound stays
        normalize.with_plain_text(pages, "html")
        assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "100"
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
