"""The pipeline against plain Python, stage by stage."""

from collections import defaultdict

import pytest
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from lexloom.llm import toxicity
from lexloom.llm.queries import table, tokenizer_file

from . import fixtures
from .test_near_and_components import brute_components, brute_fp
from .test_search_tokens_packing import brute_hits


@pytest.fixture(scope="module")
def docs(spark, sf):
    return table(spark, sf, "documents")


def test_stages_match_plain_python(spark, sf, docs):
    rows = {r["doc_id"]: r for r in docs.collect()}
    model = toxicity.fit(docs, table(spark, sf, "labels"))
    scorer = model.scorer()
    kept = {i for i, r in rows.items() if scorer.scores([r["text"]])[0] < model.thresholds.get(r["lang"], model.threshold)}

    def step(k, df, want):
        out = pipeline.STAGES[k][1](spark, df, sf)
        assert out.columns == docs.columns
        out = out.cache()
        assert sorted(r["doc_id"] for r in out.collect()) == sorted(want)
        assert all(tuple(r) == tuple(rows[r["doc_id"]]) for r in out.collect())
        return out

    df = step(0, docs, kept)
    by_text = defaultdict(list)
    for i in kept:
        by_text[rows[i]["text"]].append(i)
    kept = {max(v) for v in by_text.values()}
    df = step(1, df, kept)
    order = sorted(kept)
    groups = defaultdict(list)
    for i, root in zip(order, brute_components([brute_fp(rows[i]["text"]) for i in order]), strict=True):
        groups[root].append(i)
    kept = {min(v) for v in groups.values()}
    df = step(2, df, kept)
    items = [(r["item_id"], r["text"]) for r in table(spark, sf, "benchmark").collect()]
    windows = defaultdict(set)
    for i in kept:
        windows[i] = brute_hits(rows[i]["text"], items)[1]
    kept = {i for i in kept if not windows[i]}
    df = step(3, df, kept)
    library = Tokenizer.from_file(tokenizer_file())
    packed = pipeline.STAGES[4][1](spark, df, sf).collect()
    total = defaultdict(int)
    for r in packed:
        total[r["doc_id"]] += r["length"]
    assert total == {i: len(library.encode(rows[i]["text"], add_special_tokens=False).ids) + 1 for i in kept}
    assert sorted(tuple(r) for r in pipeline.run(spark, sf).select("doc_id", "piece", "start", "length", "ids_crc32").collect()) == sorted(
        (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed)


def test_stages_take_awkward_tables(spark, sf):
    df = fixtures.docs(spark)
    for _, stage in pipeline.STAGES:
        out = stage(spark, df, sf)
        assert out.count() > 0
        assert stage(spark, df.limit(0), sf).count() == 0
