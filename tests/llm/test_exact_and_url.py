import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lexloom.llm import exact_dedup, url_filter
from lexloom.llm.queries import RULES

from . import fixtures


def check_classes(spark, **kw):
    data = fixtures.rows()
    groups = defaultdict(list)
    for r in data:
        groups[r[1] or ""].append(r[0])
    got = exact_dedup.exact_duplicates(fixtures.docs(spark), **kw).collect()
    assert len(got) == len(data)
    texts = {hashlib.sha256(t.encode()).hexdigest(): t for t in groups}
    for r in got:
        ids = groups[texts[bytes(r["sha"]).hex()]]
        known = [i for i in ids if i is not None]
        assert r["group_size"] == len(ids)
        assert r["keep_id"] == (max(known) if known else None)
    kept = [bytes(r["sha"]).hex() for r in got if r["kept"]]
    assert sorted(kept) == sorted(texts)
    return got


def test_exact_duplicates_match_brute_force(spark):
    got = check_classes(spark, bucket_bytes=2000)
    assert len({r["bucket"] for r in got}) > 2 and {r["chain"] for r in got} == {1}


def test_colliding_hashes_are_chained_and_compared(spark, monkeypatch):
    """Five hashes for all texts: long chains, and buckets that split at the last bits only."""
    monkeypatch.setattr(exact_dedup, "text_hash", lambda t: F.pmod(F.length(t), F.lit(5)).cast("long"))
    got = check_classes(spark, bucket_bytes=500)
    for h in {r["h"] for r in got}:
        chain = {r["chain"]: bytes(r["sha"]) for r in got if r["h"] == h}
        assert sorted(chain) == list(range(1, len(set(chain.values())) + 1))
    assert len({r["h"] for r in got}) == 5 and len({r["bucket"] for r in got}) > 1
    kept = exact_dedup.drop_exact_duplicates(fixtures.docs(spark), bucket_bytes=500).collect()
    assert sorted(r["text"] or "" for r in kept) == sorted({r[1] or "" for r in fixtures.rows()})


def test_overfull_buckets_split(spark):
    rows = exact_dedup.records(fixtures.docs(spark))
    slots, bits = exact_dedup.directory(rows, 2000)
    depths = {r["slot"]: r["depth"] for r in slots.collect()}
    assert sorted(depths) == list(range(2 ** bits)) and max(depths.values()) >= bits > 1
    buckets = defaultdict(dict)
    for r in exact_dedup.with_bucket(rows, slots, bits).collect():
        buckets[r["bucket"]][r["h"]] = r["bytes"]
    assert all(sum(b.values()) <= 2000 or len(b) == 1 for b in buckets.values())
    slots, bits = exact_dedup.directory(rows)
    assert bits == 0 and [tuple(r) for r in slots.collect()] == [(0, 0)]


def test_drop_keeps_columns_and_one_row_each(spark):
    df = fixtures.docs(spark)
    kept = exact_dedup.drop_exact_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(r["text"] or "" for r in kept.collect()) == sorted({r[1] or "" for r in fixtures.rows()})
    assert exact_dedup.drop_exact_duplicates(fixtures.docs(spark, [])).count() == 0
    assert exact_dedup.exact_duplicates(fixtures.docs(spark, [])).count() == 0


def test_main_path_is_native(spark):
    plan = exact_dedup.exact_duplicates(fixtures.docs(spark))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def brute(url):
    at = url.find("://") if url else -1
    rest = url[at + 3:] if at >= 0 else ""
    host = rest
    for c in "/?#":
        host = host.split(c)[0]
    path = rest[len(host):].split("?")[0].split("#")[0]
    host = fixtures.lowered(host)
    fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else "allow"


URLS = [None, "", "no scheme", "http://", "http://net", "http://NET/", "https://a.example.net/en/1?x#y", "https://example.net/enx", "x://example.com/de/",
        "http://notexample.com/de/", "http://example.com?/de/", "http://example.com#/de/", "ftp://m.EXAMPLE.org/fr/a://b", "a://b.net./x", "http://ÀB.net/é/",
        "http://u:p@x.example.com:80/de/", "http://x.net\n/y", "https://.net/", "http://example.com/DE/"]


def test_url_filter_matches_brute_force(spark):
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)] + [(1, URLS[5], "y")], "page_id long, url string, host string")
    got = url_filter.filter_urls(df, RULES).collect()
    assert len(got) == len(URLS) + 1
    for r in got[:-1]:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == brute(URLS[r["id"]])
    assert url_filter.filter_urls(df.limit(0), RULES).count() == 0
    assert {r["verdict"] for r in url_filter.filter_urls(df, [], "allow").collect()} == {"allow"}


def test_very_long_hosts_and_paths(spark):
    host = "a." * 200_000 + "example.net"
    df = spark.createDataFrame([("p", f"http://{host}/en/" + "x/" * 200_000), (None, "http://" + "net." * 100_000 + "net?"), ("p", "http://" + "y" * 300_000)],
                               "page_id string, url string")
    rules = [*RULES, *[("a.b", "/" + "x" * n, "block") for n in range(400)], ("", "/", "block"), ("net", "en", "block")]
    got = url_filter.filter_urls(df, rules).collect()
    assert [(r["id"], r["rule"], r["verdict"]) for r in got] == [("p", "example.net/en/", "allow"), (None, None, "allow"), ("p", None, "allow")]
    assert got[0]["host"] == host
    with pytest.raises(ValueError):
        url_filter.pack_rules([("a", "/", "maybe")])


def test_digest_collisions_are_told_apart(tmp_path):
    path = tmp_path / "rules.bin"
    path.write_bytes(url_filter.pack_rules([("a.b", "/", "block"), ("c.d", "/x", "allow")]))
    array = url_filter.DigestArray(str(path))
    array.digests = array.digests * 0 + array.digests[0]  # all entries share one digest
    first = array.keys[:int(array.offsets[1])].tobytes()
    second = array.keys[int(array.offsets[1]):].tobytes()
    real = url_filter.xxhash.xxh64_intdigest
    url_filter.xxhash.xxh64_intdigest = lambda k: int(array.digests[0])
    try:
        assert array.probe([second, first, b"zz"]).tolist() == [1, 0, -1]
    finally:
        url_filter.xxhash.xxh64_intdigest = real
