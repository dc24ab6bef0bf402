"""Retrieval, grounding, ingest, limits, evaluation and flows on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from lexloom import catalog
from lexloom.operators import conversations, embedding, evaluation, grounding, ingest, limits, retrieval, structural
from lexloom.plans import chat
from lexloom.plans import ingest as jobs
from lexloom.streaming import limits as live

EMBED = embedding.hashed_embedder(16)
ROWS = [("c1", "kara za zabójstwo człowieka", "DU/1", "act", "148", 0), ("c2", "Kara  za ZABÓJSTWO człowieka", "S/1", "judgment", None, 0),
        ("c3", "kradzież mienia ruchomego", "DU/1", "act", "278", 1), ("c4", "zmienia się art. 148 kodeksu", "DU/9", "act", "1", 0), ("c5", "podatek od towarów", "DU/2", "act", "5", 0)]


@pytest.fixture(scope="module")
def chunks(spark):
    df = spark.createDataFrame(ROWS, "id string, text string, external_id string, doc_type string, article_no string, chunk_index int").withColumn("label", F.col("external_id"))
    return embedding.embed_passages(df, "text", EMBED, 16, "m").cache()


def ask(spark, *questions):
    return spark.createDataFrame(list(enumerate(questions)), "qid long, question string")


def test_hybrid_and_dedup(spark, chunks):
    rows, signals = chat.search(chunks, ask(spark, "kara zabójstwo", "zzz"), EMBED, 16, k=3, n_queries=2)
    got = [(r["qid"], r["rank"], r["id"]) for r in rows.orderBy("qid", "rank").collect()]
    first = [g[2] for g in got if g[0] == 0]
    assert first[0] in ("c1", "c2") and not {"c1", "c2"} <= set(first)
    assert {r["qid"] for r in signals.collect()} == {0, 1}


def test_filters_follow_sql_nulls(spark):
    df = spark.createDataFrame([(1, "act", True, "2020-01-01", 10), (2, "act", None, None, 10), (3, "judgment", None, "2021-01-01", 1)], "id int, doc_type string, in_force boolean, d string, token_count int")
    df = df.withColumn("judgment_date", F.to_date("d")).withColumn("court_type", F.lit("X"))
    ids = lambda **k: [r["id"] for r in retrieval.metadata_filter(df, **k).orderBy("id").collect()]
    assert ids(only_in_force=True) == [1, 3] and ids(date_from="2020-06-01") == [3] and ids(min_tokens=5) == [1, 2] and ids(court_type="Y") == [] and ids() == [1, 2, 3]


def test_registered_cells_find_all_neighbours(spark):
    """The setting of the registered query: 50 neighbours, 16 cells, ids divisible by 50."""
    sf = "/root/testdata/sf0.01"
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("id"))
    q = e.where("id % 50 = 0").select(F.col("id").alias("qid"), F.col("embedding").alias("query_vector"))
    exact = {(r["qid"], r["id"], r["rank"]) for r in retrieval.dense_topk(e.join(docs, "id"), q).collect()}
    assert {(r["qid"], r["id"], r["rank"]) for r in catalog.QUERIES["dense_topk_cells"](spark, sf).collect()} == exact


def test_structural_lookup_and_assembly(spark, chunks):
    acts = spark.createDataFrame([("DU/1", "Ustawa - Kodeks karny"), ("DU/2", "Ustawa o podatku od towarów"), ("DU/3", "Kodeks karny skarbowy i inne")], "external_id string, title string")
    q = ask(spark, "art. 148 kk kara zabójstwo", "art. 5 ustawy", "nic")
    cited = structural.cited_units(q)
    resolved = structural.resolve_acts(cited.select(F.col("act_hint").alias("hint")), acts)
    assert [(r["hint"], r["external_id"]) for r in resolved.collect()] == [("KK", "DU/1")]
    units = structural.structural_lookup(cited, resolved, chunks)
    assert [(r["qid"], r["id"], r["pos"]) for r in units.collect()] == [(0, "c1", 1)]
    rows, _ = chat.search(chunks, q, EMBED, 16, acts, k=2, n_queries=3)
    top = rows.where("qid = 0 AND rank = 1").first()
    assert (top["id"], top["path"]) == ("c1", 0)


def test_reranker_orders_and_signals(spark, chunks):
    rows, signals = chat.search(chunks, ask(spark, "kara"), EMBED, 16, k=2, reranker=embedding.substring_reranker("podatek"))
    assert rows.where("rank = 1").first()["id"] == "c5" and signals.first()["max_similarity"] == 1.0


def test_amendments_and_prompt(spark, chunks):
    acts = spark.createDataFrame([("DU/1", [("du/9", "2024-01-01")])], "external_id string, unabsorbed array<struct<eli_id:string,effective_date:string>>")
    un = grounding.unabsorbed_map(acts)
    rows = chunks.where("id = 'c1'").select(F.lit(0).cast("long").alias("qid"), "id", F.lit(1).alias("pos"), "external_id", "doc_type", "article_no", "text")
    cited = spark.createDataFrame([(0, "148")], "qid long, article string")
    got = grounding.append_amendments(rows, cited, un, chunks.select("id", "external_id", "text")).orderBy("pos").collect()
    assert [r["id"] for r in got] == ["c1", "c4"] and got[1]["text"].startswith("[NOWELIZACJA od 2024-01-01] ")
    history = spark.createDataFrame([(0, 1, "stare", None), (0, 2, "pytanie", "odp [1]"), (0, 3, " ", "x")], "qid long, turn int, question string, answer string")
    p = grounding.grounded_prompt(ask(spark, "nowe"), rows.withColumn("label", F.lit("L")), history).first()["messages"]
    assert [m["role"] for m in p] == ["system", "user", "assistant", "user"]
    assert p[1]["content"] == "stare\n\npytanie" and p[2]["content"] == "odp" and "[1] L\nkara" in p[3]["content"]


def test_chat_flow(spark, chunks):
    out = chat.answer(chunks, ask(spark, "kara za zabójstwo", "qqq"), EMBED, 16, lambda m: "Tak [1], art. 999.", threshold=0.3, n_queries=2).orderBy("qid").collect()
    assert not out[0]["abstained"] and out[0]["check"]["suspicious"] == ["art. 999"] and out[0]["check"]["cited"] == [1]
    assert out[1]["abstained"] and out[1]["answer"] is None
    ev = grounding.event_stream(spark.createDataFrame([(0, False, "s", "a b", None), (1, True, None, None, None), (2, False, None, None, "boom")], "qid long, abstained boolean, sources string, answer string, error string"))
    assert [r["event"] for r in ev.orderBy("qid", "seq").collect()] == ["sources", "token", "token", "done", "abstain", "done", "error"]


def raws(spark, *rows):
    return spark.createDataFrame([("SAOS", i, "judgment", t, "html", None, None) for i, t in rows],
                                 "source string, external_id string, doc_type string, raw_content string, content_format string, payload string, source_url string")


def test_ingest_is_idempotent(spark):
    calls = spark.sparkContext.accumulator(0)

    def provider(texts):
        calls.add(len(texts))
        return EMBED(texts)

    body = "WYROK Sąd po rozpoznaniu sprawy orzeka że wniosek zostaje oddalony w całości"
    empty_docs = spark.createDataFrame([], "source string, external_id string, doc_id string, content_hash string, status string")
    empty_chunks = spark.createDataFrame([], "doc_id string, chunk_id string, chunk_index int, text string, embedding array<float>, embedded_with string")
    raw = raws(spark, ("1", body), ("2", body + " dwa"))
    out, docs, chunks = jobs.process(raw, empty_docs, empty_chunks, provider, 16, "m1")
    assert {r["outcome"] for r in out.collect()} == {"Inserted"}
    docs, chunks = docs.cache(), chunks.cache()
    assert docs.count() == 2 and chunks.count() == 2
    before = calls.value
    out, docs2, chunks2 = jobs.process(raw, docs, chunks, provider, 16, "m1")
    assert {r["outcome"] for r in out.collect()} == {"Skipped"} and chunks2.count() == 2 and calls.value == before
    out, docs2, chunks2 = jobs.process(raws(spark, ("1", body + " zmiana"), ("3", body)), docs, chunks, provider, 16, "m1")
    assert {r["external_id"]: r["outcome"] for r in out.collect()} == {"1": "Updated", "3": "Inserted"}
    assert docs2.count() == 3 and chunks2.count() == 3 and ingest.orphans(chunks2, docs2).count() == 0
    out, _, chunks3 = jobs.process(raw, docs, chunks, provider, 16, "m2")
    assert {r["outcome"] for r in out.collect()} == {"ReEmbedded"} and {r["embedded_with"] for r in chunks3.collect()} == {"m2"}


def test_filters_bind_ranked_rows_only(spark):
    rows = [(1, "alpha beta", [1.0, 0.0], "X"), (2, "alpha", [3.0, 4.0], "X"), (3, "alpha", [0.0, 9.0], "Y"), (4, "gamma", [5.0, 0.0], "Y")]
    chunks = spark.createDataFrame(rows, "id int, text string, embedding array<double>, court_type string")
    q = spark.createDataFrame([(0, "alpha", [1.0, 0.0])], "qid int, question string, query_vector array<double>")
    unit = spark.createDataFrame([(0, 4, 1)], "qid int, id int, pos int")
    found, signals = retrieval.hybrid(chunks, q, 8, n_queries=1, structural=unit, filters={"court_type": "X"}, unit_norm=False)
    got = found.orderBy("rank").collect()
    assert [(r["id"], r["path"]) for r in got] == [(4, 0), (1, 1), (2, 1)]
    assert [r["sim"] for r in got] == [None, 1.0, 0.6] and signals.first()["max_similarity"] == 1.0
    none, _ = retrieval.hybrid(chunks, q, 8, n_queries=1, structural=unit, filters={"court_type": "Z"})
    assert none.count() == 0
    terms = retrieval.batch_terms(q, 1)
    assert retrieval.postings(chunks, terms=terms).exceptAll(retrieval.postings(chunks).where("term = 'alpha'")).count() == 0
    assert retrieval.postings(chunks, terms=terms).count() == 3


def test_breaker_quarantine_relink(spark):
    rows = spark.createDataFrame([("a", str(i), "Failed" if i in (2, 3, 4, 6) else "Skipped") for i in range(8)], "source string, external_id string, outcome string")
    assert ingest.fail_streaks(rows).first()["longest"] == 3
    assert ingest.tripped(ingest.fail_streaks(rows), 3).count() == 1 and ingest.tripped(ingest.fail_streaks(rows), 0).count() == 0
    bad = ingest.guarded(lambda r: 1 / 0, "chunk")({})
    assert bad["status"] == "Failed" and bad["failure_reason"].startswith("[chunk] ")
    stored = spark.createDataFrame([("k", "x", ["a", "b"]), ("same", "x", ["b", "a"])], "key string, consolidated string, amendments array<string>")
    fresh = spark.createDataFrame([("k", "y", ["a"]), ("same", "x", ["a", "b"])], "key string, consolidated string, amendments array<string>")
    assert [(r["key"], r["consolidated"]) for r in ingest.relink(stored, fresh).collect()] == [("k", "y")]


def brute_sliding(times, limit, seconds):
    recent, out = [], []
    for t in times:
        recent = [x for x in recent if x >= t - seconds]
        out.append(len(recent) < limit)
        if out[-1]:
            recent.append(t)
    return out


def test_sliding_limit_forms_agree(spark, tmp_path):
    rng = random.Random(3)
    rows, want = [], {}
    for u in range(4):
        times = sorted(rng.randrange(0, 400) for _ in range(60))
        for k, (t, ok) in enumerate(zip(times, brute_sliding(times, 3, 60), strict=True)):
            rows.append((u, u * 100 + k, t))
            want[u * 100 + k] = ok
    df = spark.createDataFrame(rows, "user_id int, event_id int, t long").withColumn("ts", F.timestamp_seconds("t"))
    for blocks in (500_000, 25):  # one user a block at most, and users over several blocks
        assert {r["event_id"]: r["accepted"] for r in limits.sliding_limit(df, 3, 60, block_rows=blocks).collect()} == want
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = live.stream_sliding_limit(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), 3, 60)
    q = stream.writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {r["event_id"]: r["accepted"] for r in spark.table("limited").collect()} == want


def test_daily_caps_match_sequence(spark):
    rng = random.Random(4)
    rows = [(k, rng.randrange(5), rng.randrange(1, 50), rng.randrange(0, 3 * 86400)) for k in range(300)]
    want, state = {}, {}
    for k, u, c, t in sorted(rows, key=lambda r: (r[3], r[0])):
        s = state.setdefault(t // 86400, {"c": 0, "n": 0, "u": {}})
        v = "chars" if s["c"] >= 560 else "requests" if s["n"] >= 24 else "user" if s["u"].get(u, 0) >= 5 else "ok"
        if v == "ok":
            s["c"], s["n"] = s["c"] + c, s["n"] + 1
            s["u"][u] = s["u"].get(u, 0) + 1
        want[k] = v
    df = spark.createDataFrame(rows, "event_id int, user_id int, chars int, t long").withColumn("ts", F.timestamp_seconds("t"))
    assert {r["event_id"]: r["verdict"] for r in limits.daily_caps(df, 560, 24, 5).collect()} == want
    assert set(want.values()) >= {"ok", "user"}


def test_evaluation(spark):
    items = spark.createDataFrame([
        ("a", "InCorpus", False, False, "DU/1", "5", None, None), ("b", "Trap", True, False, None, None, None, None), ("c", "Freshness", False, False, None, None, None, "du/9"),
        ("d", "InCorpus", False, True, None, None, "i c 1/20", None)],
        "id string, category string, should_abstain boolean, needs_lawyer boolean, expected_eli string, expected_article string, expected_case string, expected_amendment string")
    obs = spark.createDataFrame([("a", 0.8, False, None, None), ("b", 0.4, True, False, True), ("c", 0.7, False, True, False), ("d", 0.6, False, None, True)],
                                "id string, max_similarity double, would_abstain boolean, citations_clean boolean, abstained boolean")
    got = spark.createDataFrame([("a", "du/1", "5", None), ("c", "DU/9", "1", None)], "id string, eli string, article string, case_number string")
    v = evaluation.score_items(items, obs, got)
    by = {r["id"]: r for r in v.collect()}
    assert (by["a"]["hit"], by["b"]["no_hallucination"], by["b"]["chat_ok"], by["c"]["fresh_hit"], by["d"]["hit"], by["d"]["chat_ok"]) == (True, True, True, True, None, None)
    r = evaluation.report(v, 0.5).first()
    assert (r["recall_at_k"], r["abstention_accuracy"], r["scored_traps"], round(r["mean_sim_in"], 6)) == (1.0, 1.0, 1, 0.7)
    empty = evaluation.report(v.limit(0), 0.5).first()
    assert empty["recall_at_k"] is None and empty["abstention_accuracy"] == 0 and empty["mean_sim_in"] == 0
    pts = spark.createDataFrame([(True, 0.4), (False, 0.8)], "should_abstain boolean, max_similarity double")
    assert tuple(evaluation.best_threshold(pts).first()) == (0.45, 1.0)


def test_conversation_log(spark):
    conv = spark.createDataFrame([("c1", "u", "2024-01-01"), ("c2", "v", "2024-08-01")], "conv_id string, user_id string, d string").withColumn("updated_at", F.to_timestamp("d"))
    msg = spark.createDataFrame([("m1", "c1", "2024-02-01"), ("m2", "c2", "2024-08-02")], "message_id string, conv_id string, d string").withColumn("created_at", F.to_timestamp("d")).drop("d")
    assert [r["conv_id"] for r in conversations.conversation_list(conv, "u").collect()] == ["c1"]
    assert conversations.messages_of(conv, msg, "u", "c2").count() == 0
    fb = spark.createDataFrame([("m1", "u", "up"), ("m1", "v", "down"), ("m1", "u", "bogus")], "message_id string, user_id string, verdict string").withColumn("created_at", F.lit(1))
    assert [(r["user_id"], r["verdict"]) for r in conversations.accepted_feedback(fb, msg, conv).collect()] == [("u", "up")]
    kept = conversations.retain(conversations.touch(conv, msg), "2024-09-01")
    assert [r["conv_id"] for r in conversations.cascade(msg, kept, "conv_id").collect()] == ["c2"]
    df = spark.createDataFrame([('[{"Index":1,"Label":"L"},3]',), ("broken",), (None,)], "j string")
    got = [r[0] for r in df.coalesce(1).select(conversations.stored_sources(F.col("j"))).collect()]
    assert got[1] == [] and got[2] == []
