"""Sources, stores and the registered queries."""

import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lexloom import catalog
from lexloom.sources import api, stores


def save(root, path, body):
    f = root.joinpath(*path.split("/")).with_suffix(".json")
    f.parent.mkdir(parents=True, exist_ok=True)
    f.write_text(json.dumps(body), encoding="utf-8")


def test_judgment_source(spark, tmp_path):
    api.register(spark)
    save(tmp_path, "search/0", {"total": 5, "items": [{"id": 1, "href": "h1"}, {"id": 2, "href": "h2"}]})
    save(tmp_path, "search/1", {"items": [{"id": 3, "href": "h3"}]})
    for i, text in ((1, "<p>a</p>"), (2, "  "), (3, "c")):
        save(tmp_path, f"judgments/{i}", {"data": {"id": i, "textContent": text}})
    df = spark.read.format("judgments").option("root", str(tmp_path)).option("pagesize", "2").option("pagesperpartition", "1").load()
    assert sorted(r["external_id"] for r in df.collect()) == ["1", "3"]
    save(tmp_path, "dump/0", {"items": [{"id": 7, "textContent": "x"}]})
    q = spark.readStream.format("judgments").option("root", str(tmp_path)).load().writeStream.format("memory").queryName("dump").option(
        "checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert [r["external_id"] for r in spark.table("dump").collect()] == ["7"]


def test_act_sources(spark, tmp_path):
    api.register(spark)
    save(tmp_path, "acts/2020", {"items": [{"ELI": "DU/2020/1", "type": "Ustawa", "status": "akt obowiązujący"}, {"ELI": " ", "type": "Ustawa"}]})
    save(tmp_path, "acts/2021", {"items": [{"ELI": "DU/2021/9", "type": "Umowa", "status": "x"}]})
    listing = spark.read.format("act_listing").option("root", str(tmp_path)).option("yearFrom", "2020").option("yearTo", "2022").load()
    kept = listing.where(api.should_include(F.col("eli"), F.col("type"), F.col("status"), ["ustawa"], []))
    assert [r["eli"] for r in kept.collect()] == ["DU/2020/1"]
    assert [r["eli"] for r in api.act_addresses(kept, [" du/2020/1 ", "DU/1997/553"]).collect()] == ["DU/1997/553", "DU/2020/1"]
    save(tmp_path, "DU/2020/1/meta", {"textHTML": True, "references": {"Inf. o tekście jednolitym": [{"id": "DU/2021/5"}, {"id": "DU/2020/99"}]}})
    save(tmp_path, "DU/2021/5/meta", {"textHTML": False})
    save(tmp_path, "DU/2021/5/pdf", {"text": "Art. 1. x"})
    row = spark.read.format("acts").option("root", str(tmp_path)).option("addresses", "DU/2020/1").load().first()
    assert (row["external_id"], row["content_format"], row["raw_content"], row["source_url"]) == ("DU/2020/1", "pdf-text", "Art. 1. x", "DU/2021/5")


def test_slice_passes_missing_values(spark):
    df = spark.createDataFrame([(1, "COMMON", "Sąd Okręgowy w X", "2020-01-01"), (2, None, None, "junk"), (3, "common", "Inny", "2030-01-01")], "id int, court_type string, court string, judgment_date string")
    assert [r["id"] for r in api.in_slice(df, "Common", today="2026-01-01").collect()] == [1, 2]
    assert [r["id"] for r in api.in_slice(df, court_prefix="sąd okręgowy", today="2026-01-01").collect()] == [1]


def test_stores(spark, tmp_path):
    raw = spark.createDataFrame([("S", "1", "a"), ("E", "2", "b")], "source string, external_id string, raw_content string")
    stores.write_raw(raw, str(tmp_path / "raw"))
    stores.write_raw(raw.where("source = 'S'").withColumn("raw_content", F.lit("new")), str(tmp_path / "raw"))
    assert {(r["external_id"], r["raw_content"]) for r in stores.read_raw(spark, str(tmp_path / "raw")).collect()} == {("1", "new"), ("2", "b")}
    assert stores.read_raw(spark, str(tmp_path / "raw"), "E").count() == 1
    (tmp_path / "pdf").mkdir()
    (tmp_path / "pdf/a.pdf").write_bytes(b"one\ftwo")
    (tmp_path / "pdf/b.pdf").write_bytes(b" \n")
    got = {r["path"][-5:]: (r["text"], r["error"]) for r in stores.pdf_texts(spark, str(tmp_path / "pdf"), lambda b: b.decode().split("\f")).collect()}
    assert got == {"a.pdf": ("one\ntwo", None), "b.pdf": (None, "no text")}
    out = spark.createDataFrame([("S", "1", "Failed", "[x] y"), ("S", "2", "Indexed", None)], "source string, external_id string, status string, failure_reason string")
    stores.write_failures(out, str(tmp_path / "fail"))
    assert spark.read.json(str(tmp_path / "fail")).count() == 1
    stores.write_watermark(spark, str(tmp_path / "wm"), "S", "2024-01-01 00:00:00")
    stores.write_watermark(spark, str(tmp_path / "wm"), "S", "2024-02-01 00:00:00")
    assert str(stores.read_watermarks(spark, str(tmp_path / "wm")).first()["watermark"]) == "2024-02-01 00:00:00"
    (tmp_path / "golden.json").write_text(json.dumps([{"id": "1", "question": "q", "category": "Trap", "shouldAbstain": True}]))
    assert stores.golden_set(spark, str(tmp_path / "golden.json")).first()["should_abstain"]
    (tmp_path / "exam.json").write_text(json.dumps({"Name": "N", "Items": [{"Nr": 1, "Pytanie": "?", "Odpowiedzi": {"A": "x"}, "Prawidlowa": "a"}]}))
    assert stores.exam_set(spark, str(tmp_path / "exam.json")).first()["key"] == "A"


def normal(rows, names):
    def one(v):
        return round(v, 6) if isinstance(v, float) else str(v) if v is not None and not isinstance(v, (int, bool, str)) else v

    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([one(r[i]) for i in order]) for r in rows)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in sorted(os.listdir(sf)):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_matches_sql(spark, sf, duck, name):
    got = catalog.QUERIES[name](spark, sf)
    cur = duck.execute(catalog.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(got.columns)
    assert normal([tuple(r) for r in got.collect()], got.columns) == normal(cur.fetchall(), names)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(entry.queries()) and set(catalog.SQL) <= set(entry.oracle_sql())
