"""Snapshots, quarantine and the breaker of the batch, by replay."""

import pytest
from pyspark.sql import functions as F

from lexloom.operators import ingest
from lexloom.plans import ingest as jobs
from lexloom.sources.snapshots import Change, Conflict, SnapshotStore
from lexloom.sources.workspace import shared_folder

BODY = "WYROK Sąd po rozpoznaniu sprawy orzeka że wniosek zostaje oddalony w całości "


def vectors(texts):
    """A deterministic provider that takes no text with a bad word and no batch that holds one."""
    if any("zepsuty" in t for t in texts):
        raise ValueError("model is down")
    return [[float(len(t)), 1.0] for t in texts]


def raws(spark, rows):
    """rows: (external_id, text, type)."""
    return spark.createDataFrame([("S", i, kind, t, "html", None, None) for i, t, kind in rows],
                                 "source string, external_id string, doc_type string, raw_content string, content_format string, payload string, source_url string")


def stored(store):
    docs = {r["external_id"]: r for r in store.read("documents").collect()}
    chunks = {}
    for r in store.read("chunks").collect():
        chunks.setdefault(r["doc_id"], []).append(r["text"])
    return docs, chunks


@pytest.fixture
def store(spark):
    return jobs.document_store(spark, shared_folder(spark, "store"), 4)


def test_commit_changes_tables_together(spark):
    store = SnapshotStore(spark, shared_folder(spark, "store"), {"a": "id", "b": "id"}, 4)
    with pytest.raises(LookupError):
        store.read("a")
    rows = spark.range(20).selectExpr("id", "id * 2 AS v")
    assert store.commit("w", 0, {"a": Change(rows.select("id"), rows), "b": Change(rows.select("id"), rows)}) == 1
    two = spark.range(2).selectExpr("id", "-1L AS v")
    gone = spark.createDataFrame([(0,), (1,), (5,), (77,)], "id long")
    assert store.commit("w", 1, {"a": Change(gone, two)}) == 2
    assert sorted(tuple(r) for r in store.read("a").collect()) == sorted([(0, -1), (1, -1), *((i, 2 * i) for i in range(2, 20) if i != 5)])
    assert store.read("b").count() == 20 and store.read("a", 1).agg(F.sum("v")).first()[0] == 380  # older versions stay readable
    old, new = (store.manifest(v)["tables"]["a"]["buckets"] for v in (1, 2))
    assert any(old[b] == new[b] for b in old) and any(old[b] != new[b] for b in old)  # untouched buckets are not rewritten
    assert store.commit("w", 1, {"a": Change(rows.select("id"), rows.limit(0))}) == 2  # a replay changes nothing
    assert store.read("a").count() == 19
    assert store.vacuum(1) > 0 and store.versions() == [2] and store.read("a").count() == 19 and store.read("b").count() == 20


def test_crash_between_tables_leaves_the_old_state(spark, monkeypatch):
    store = SnapshotStore(spark, shared_folder(spark, "store"), {"documents": "doc_id", "chunks": "doc_id"}, 4)
    rows = spark.createDataFrame([("a", "old"), ("b", "old")], "doc_id string, v string")
    store.commit("w", 0, {"documents": Change(rows.select("doc_id"), rows), "chunks": Change(rows.select("doc_id"), rows)})
    new = rows.withColumn("v", F.lit("new"))
    changes = {"documents": Change(new.select("doc_id"), new), "chunks": Change(new.select("doc_id"), new)}
    stage = SnapshotStore._stage

    def crash(self, name, *rest):
        if name == "chunks":
            raise OSError("lost")
        return stage(self, name, *rest)

    for name, broken in (("_stage", crash), ("_publish", lambda *_: (_ for _ in ()).throw(OSError("lost")))):
        with monkeypatch.context() as m:
            m.setattr(SnapshotStore, name, broken)
            with pytest.raises(OSError, match="lost"):
                store.commit("w", 1, changes)
        assert {r["v"] for t in ("documents", "chunks") for r in store.read(t).collect()} == {"old"}
    assert store.commit("w", 1, changes) == 2
    assert {r["v"] for t in ("documents", "chunks") for r in store.read(t).collect()} == {"new"}


def test_two_writers_cannot_take_one_version(spark, monkeypatch):
    store = SnapshotStore(spark, shared_folder(spark, "store"), {"a": "id"}, 2)
    rows = spark.range(3).selectExpr("id")
    store.commit("w", 0, {"a": Change(rows, rows)})
    head = store.manifest()
    store.commit("x", 0, {"a": Change(rows, rows.limit(1))})
    monkeypatch.setattr(store, "manifest", lambda version=None: head)  # has not seen x
    with pytest.raises(Conflict):
        store.commit("y", 0, {"a": Change(rows, rows.limit(0))})
    monkeypatch.undo()
    assert store.read("a").count() == 1


def test_bad_documents_do_not_end_the_batch(spark, store):
    first = raws(spark, [("1", BODY + "raz", "judgment"), ("2", BODY + "dwa", "judgment"), ("3", BODY + "trzy", "book"), ("4", BODY + "zepsuty", "judgment"), ("5", None, "judgment")])
    run = jobs.process_into(store, first, vectors, 2, "m1")
    assert run.outcomes == {"Inserted": 3, "Failed": 2} and run.aborted is None
    assert (run.metrics["documents"], run.metrics["unparsed"], run.metrics["unembedded"]) == (5, 1, 1)
    docs, chunks = stored(store)
    assert {i: (d["status"], d["attempt_count"]) for i, d in docs.items()} == {"1": ("Indexed", 0), "2": ("Indexed", 0), "3": ("Failed", 1), "4": ("Failed", 1), "5": ("Indexed", 0)}
    assert docs["3"]["failure_reason"] == "[normalize] no normalizer for type book" and docs["4"]["failure_reason"] == "[embed] model is down"
    assert docs["4"]["title"] == jobs.FAILED_TITLE and set(chunks) == {docs["1"]["doc_id"], docs["2"]["doc_id"]}
    # a stored document that breaks keeps its row and its chunks; failed ones are tried again
    second = raws(spark, [("1", BODY + "zepsuty", "judgment"), ("2", BODY + "dwa", "judgment"), ("4", BODY + "naprawiony", "judgment"), ("3", BODY + "trzy", "book")])
    assert jobs.process_into(store, second, vectors, 2, "m1").outcomes == {"Failed": 2, "Skipped": 1, "Updated": 1}
    again, kept = stored(store)
    assert (again["1"]["status"], again["1"]["attempt_count"], again["1"]["content_hash"]) == ("Failed", 1, docs["1"]["content_hash"])
    assert again["3"]["attempt_count"] == 2 and kept[docs["1"]["doc_id"]] == chunks[docs["1"]["doc_id"]]
    assert (again["4"]["status"], again["4"]["attempt_count"], again["4"]["failure_reason"]) == ("Indexed", 1, None) and again["4"]["doc_id"] in kept
    assert ingest.orphans(store.read("chunks"), store.read("documents")).count() == 0
    # another model: a chunk that cannot be embedded again leaves its document as it was
    third = jobs.process_into(store, second.where("external_id = '2'"), lambda t: 1 / 0, 2, "m2")
    assert third.outcomes == {"Failed": 1}
    docs3, kept3 = stored(store)
    assert docs3["2"]["failure_reason"].startswith("[re-embed] ") and kept3 == kept
    assert jobs.process_into(store, second.where("external_id = '2'"), vectors, 2, "m2").outcomes == {"Updated": 1}


def sequential(bad, limit):
    """Ids processed by a loop that stops after ``limit`` failures in a row."""
    streak = 0
    for at, b in enumerate(bad):
        streak = streak + 1 if b else 0
        if limit and streak == limit:
            return at + 1
    return len(bad)


@pytest.mark.parametrize(("pattern", "limit", "wave_rows"), [("..x" + "x" * 12 + "...", 10, 9), ("xxx.xxxx.xxxxx..", 4, 6), ("xx.xx.xx.xx.", 3, 6), ("xxxxxx", 0, 6)])
def test_breaker_stops_where_a_loop_would(spark, store, pattern, limit, wave_rows):
    bad = [c == "x" for c in pattern]
    raw = raws(spark, [(f"{i:03d}", BODY + ("zepsuty" if b else str(i)), "judgment") for i, b in enumerate(bad)])
    run = jobs.process_into(store, raw, vectors, 2, "m1", breaker=limit, wave_rows=wave_rows)
    done = sequential(bad, limit)
    assert (run.aborted is not None) == (done < len(bad) or (limit > 0 and pattern.endswith("x" * limit)))
    assert sum(run.outcomes.values()) == done and run.outcomes.get("Failed", 0) == sum(bad[:done])
    assert sorted(stored(store)[0]) == [f"{i:03d}" for i in range(done)]
    if run.aborted:
        assert f"S/{done - 1:03d}" in run.aborted
        repaired = jobs.process_into(store, raw.withColumn("raw_content", F.regexp_replace("raw_content", "zepsuty", "dobry")), vectors, 2, "m1", breaker=limit, wave_rows=wave_rows)
        assert repaired.aborted is None and sum(repaired.outcomes.values()) == len(bad)
        assert store.read("documents").where("status = 'Indexed'").count() == len(bad)
