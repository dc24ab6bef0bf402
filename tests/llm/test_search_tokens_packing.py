import re
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexloom.llm import decontaminate, packing, token_count

from . import fixtures

PATH = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def item_windows(text, window=10):
    w = WORD.findall(fixtures.lowered(text))
    m = min(window, len(w))
    return {tuple(w[i:i + m]) for i in range(len(w) - m + 1)} if w else set()


def brute_hits(text, items):
    w = WORD.findall(fixtures.lowered(text))
    hit, found = set(), set()
    for item, body in items:
        for win in item_windows(body):
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i:i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    found.add(item)
    return len(w), hit, found


def bench_items():
    texts = [r[1] for r in fixtures.rows() if r[1]]
    long = texts[40].split()
    return [(1, " ".join(long[50:75])), (10, " ".join(long[60:64])), (2, "Éa-ÀB!cd"), (3, None), (4, " . "), (5, texts[3]), (5, texts[3]), (6, "never seen words at all in here x y z q r s"), (9, "X")]


@pytest.mark.parametrize("block_words", [2_000_000, 20])
def test_contamination_matches_brute_force(spark, block_words):
    items = bench_items()
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_contamination(fixtures.docs(spark), bench, 10, block_words=block_words).collect()
    want = Counter()
    for r in fixtures.rows():
        n, hit, found = brute_hits(r[1], items)
        want[(r[0], n, tuple(sorted(hit)), tuple(sorted(found)))] += 1
    have = Counter((r["id"], r["n_words"], tuple(i for s in r["spans"] for i in range(s["start"], s["end"])), tuple(r["items"])) for r in got)
    assert have == want
    clean = decontaminate.drop_contaminated(fixtures.docs(spark), bench, block_words=block_words)
    assert clean.count() == sum(n for (_, _, hit, _), n in want.items() if not hit)
    assert decontaminate.find_contamination(fixtures.docs(spark, []), bench).count() == 0
    assert decontaminate.find_contamination(fixtures.docs(spark), bench.limit(0)).where("size(spans) > 0").count() == 0


@pytest.mark.parametrize("block_words", [250_000, 5])
def test_items_with_text_ids_or_none(spark, block_words):
    bench = spark.createDataFrame([("a-1", "one two three"), (None, "four five"), ("b", None)], "item_id string, text string")
    docs = spark.createDataFrame([("x", "zero one two three four"), (None, "Four, five"), ("x", None)], "doc_id string, text string")
    got = decontaminate.find_contamination(docs, bench, block_words=block_words).collect()
    assert sorted((str(r["id"]), len(r["spans"]), r["items"]) for r in got) == [("None", 1, []), ("x", 0, []), ("x", 1, ["a-1"])]
    assert [r["text"] for r in decontaminate.drop_contaminated(docs, bench, block_words=block_words).collect()] == [None]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=0, max_size=900), st.lists(st.lists(st.integers(1, 4), min_size=3, max_size=3), min_size=1, max_size=5))
def test_wu_manber_finds_every_occurrence(text, patterns):
    patterns = sorted({tuple(p) for p in patterns})
    end, which = decontaminate.WuManber(np.array(patterns)).find(np.array(text, np.int64))
    want = {(i + 2, k) for i in range(len(text) - 2) for k, p in enumerate(patterns) if tuple(text[i:i + 3]) == p}
    assert set(zip(end.tolist(), which.tolist(), strict=True)) == want


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_counts_match_library(spark, library):
    got = Counter((r["id"], r["n_bytes"], r["n_tokens"]) for r in token_count.count_tokens(fixtures.docs(spark), PATH).collect())
    want = Counter((r[0], len((r[1] or "").encode()), len(library.encode(r[1] or "", add_special_tokens=False).ids)) for r in fixtures.rows())
    assert got == want


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_tokenizers_use_their_library(spark, name):
    path = public_tokenizers.path(name)
    got = sorted(r["n_tokens"] for r in token_count.count_tokens(fixtures.docs(spark, fixtures.rows()[:50]), path).collect())
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        want = [len(t.encode(r[1] or "", add_special_tokens=False).ids) for r in fixtures.rows()[:50]]
    else:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        want = [len(sp.encode(r[1] or "")) for r in fixtures.rows()[:50]]
    assert got == sorted(want)


@cache
def shortcut():
    spec = token_count.load_spec(PATH)
    return token_count.Counter(spec, token_count.whole_tokens(spec)), token_count.merge_engine(spec)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_shortcut_equals_library(library, text):
    counter, engine = shortcut()
    ids = library.encode(text, add_special_tokens=False).ids
    assert counter.count(text) == len(ids)
    assert list(engine.encode(text, allowed_special="all")) == ids


def check_plan(histogram, capacity=1024):
    plan = packing.plan_packing(dict(histogram), capacity)
    sequences, rows = defaultdict(list), sorted(plan.rows)
    for i, (length, rank, m, base, offset) in enumerate(rows):
        end = rows[i + 1][1] if i + 1 < len(rows) and rows[i + 1][0] == length else histogram[length]
        for j in range(end - rank):
            sequences[base + j % m].append((offset + j // m * length, length))
    assert Counter(n for s in sequences.values() for _, n in s) == Counter({n: c for n, c in histogram.items() if c})
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(sequences) == plan.sequences
    return plan.sequences


@settings(max_examples=25, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), min_size=1, max_size=30))
def test_plans_are_valid(histogram):
    n = check_plan(histogram, 64)
    assert n >= -(-sum(k * c for k, c in histogram.items()) // 64)


def test_plan_is_close_to_the_bound():
    rng = np.random.default_rng(1)
    histogram = Counter(rng.integers(1, 1025, 50_000).tolist())
    assert check_plan(histogram) <= 1.005 * -(-sum(k * c for k, c in histogram.items()) // 1024)
    assert check_plan({1024: 3}) == 3
    assert packing.plan_packing({}).sequences == 0


def test_most_large_pieces_share_a_configuration():
    """On lengths like a corpus's: configurations of two or more large pieces, close to the bound."""
    rng = np.random.default_rng(2)
    histogram = Counter(np.concatenate([rng.integers(1, 1024, 40_000), np.minimum(rng.lognormal(5.8, 0.9, 40_000).astype(int) + 1, 1024)]).tolist())
    histogram.pop(1024)
    assert check_plan(histogram) <= 1.003 * -(-sum(k * c for k, c in histogram.items()) // 1024)
    large = np.array(sorted((n for n in histogram if n > 256), reverse=True))
    found = packing.configurations(large[::3], np.full(len(large[::3]), 300), 10**6, 1024)
    pieces = [(int(c.sum()), m * int(c.sum())) for c, m in found]
    assert sum(n for k, n in pieces if k >= 2) > 0.6 * sum(n for _, n in pieces)


@pytest.mark.parametrize("text", [" " * 1_000_000, "a" + " " * 1_000_000 + "b\n" + "\t" * 700_000 + "x", "ab" * 300_000])
def test_very_long_runs_are_encoded_as_the_library_does(spark, library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    encode = packing.encoder(token_count.load_spec(PATH), PATH)
    same = encode(text).tolist() == ids
    assert same
    assert shortcut()[0].count(text) == len(ids)


def test_pieces_round_trip(spark, library):
    packed = packing.pack(fixtures.docs(spark), PATH, 1024, 2).collect()
    texts = Counter()
    for r in fixtures.rows():
        ids = library.encode(r[1] or "", add_special_tokens=False).ids + [2]
        texts[(r[0], tuple(ids))] += 1
    by_id = defaultdict(list)
    for r in packed:
        ids = np.frombuffer(bytes(r["ids"]), "<u4")
        assert len(ids) == r["length"] <= 1024
        by_id[r["id"]].append((r["start"], tuple(ids.tolist()), r["piece"]))
    for (doc, ids), n in texts.items():
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            assert by_id[doc].count((a, ids[a:b], k)) >= n
    assert len(packed) == sum(n * -(-len(ids) // 1024) for (_, ids), n in texts.items())
    places = defaultdict(list)
    for r in packed:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in places.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024
    joined = packing.sequences(packing.pack(fixtures.docs(spark), PATH, 1024, 2)).agg(F.sum(F.length("ids"))).first()[0]
    assert joined == 4 * sum(r["length"] for r in packed)
    assert packing.pack(fixtures.docs(spark, []), PATH).count() == 0


def test_unreachable_vocabulary_strings_are_no_whole_tokens(spark, tmp_path):
    """"abc" is in the vocabulary, but "ab" is merged first."""
    import json

    from tokenizers import Tokenizer

    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    letters = {b: c for c, b in token_count.byte_alphabet().items()}
    spec["model"]["vocab"] = {letters[b]: b for b in range(256)} | {"ab": 256, "bc": 257, "abc": 258}
    spec["model"]["merges"] = [["a", "b"], ["b", "c"], ["a", "bc"]]
    spec["added_tokens"] = []
    path = str(tmp_path / "small.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(spec, f)
    rows = [(1, "abc"), (2, "xabc abc"), (3, "ab bc")]
    got = {r["id"]: r["n_tokens"] for r in token_count.count_tokens(spark.createDataFrame(rows, "doc_id long, text string"), path).collect()}
    library = Tokenizer.from_file(path)
    assert got == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in rows} and got[1] == 2


def test_the_vocabulary_is_proven_in_a_task(spark, monkeypatch):
    """What the parser and the library leave in memory would add up in the driver, call by call."""

    def in_driver(*_):
        raise AssertionError("called in the driver")

    monkeypatch.setattr(token_count, "encoded_alone", in_driver)
    df = fixtures.docs(spark, fixtures.rows()[:5])
    assert token_count.count_tokens(df, PATH).count() == 5
    assert packing.tokenize_pieces(df, PATH).select("id").distinct().count() > 0
