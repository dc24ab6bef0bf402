import random
from collections import defaultdict

import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from lexloom.llm import common, simhash

from . import fixtures


def brute_fp(text):
    w = re_split(fixtures.lowered(text))
    if not w:
        return 0
    k = min(3, len(w))
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + k]).encode(), 42) for i in range(len(w) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def re_split(text):
    out = text
    for c in "\t\n\x0b\x0c\r":
        out = out.replace(c, " ")
    return [w for w in out.split(" ") if w]


def brute_components(fps):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_fingerprints_and_components_match_brute_force(spark):
    data = fixtures.rows()
    got = simhash.near_duplicates(fixtures.docs(spark)).collect()
    fps = [brute_fp(r[1]) for r in data]
    roots = brute_components(fps)
    least = defaultdict(list)
    for r, root in zip(data, roots, strict=True):
        if r[0] is not None:
            least[root].append(r[0])
    want = sorted((str(r[0]), fp, min(least[root]) if root in least else None) for r, fp, root in zip(data, fps, roots, strict=True))
    assert sorted((str(r["id"]), r["fp"] & (2**64 - 1), r["component"]) for r in got) == want
    kept = simhash.drop_near_duplicates(fixtures.docs(spark))
    assert kept.columns == fixtures.docs(spark).columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(map(str, ids)) == sorted(str(min(least[r])) if r in least else "None" for r in set(roots))
    assert simhash.near_duplicates(fixtures.docs(spark, [])).count() == 0


def edges_of(spark, fps):
    df = spark.createDataFrame([(simhash._signed(f),) for f in sorted(set(fps))], "fp long")
    edges = [(r["src"], r["dst"]) for r in simhash.near_edges(df).collect()]
    for a, b in edges:
        assert bin((a ^ b) & (2**64 - 1)).count("1") <= 2
    parent = {simhash._signed(f): simhash._signed(f) for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    return {f: find(simhash._signed(f)) for f in fps}


def test_dense_and_sparse_buckets_lose_no_link(spark):
    rng = random.Random(5)
    fps = [rng.getrandbits(64) for _ in range(150)]
    centre = rng.getrandbits(64)
    fps += [centre ^ (1 << i) ^ (1 << rng.randrange(64)) for i in range(60)] + [centre]  # a dense bucket
    for f in fps[:60]:
        fps.append(f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    fps = sorted(set(fps))
    root, want = edges_of(spark, fps), brute_components(fps)
    groups = defaultdict(set)
    for f, r in zip(fps, want, strict=True):
        groups[r].add(root[f])
    assert all(len(g) == 1 for g in groups.values())
    assert len({root[f] for f in fps}) == len(groups)


def test_unequal_thresholds_lose_no_link(spark, monkeypatch):
    rng = random.Random(6)
    fps = [rng.getrandbits(64) for _ in range(40)]
    fps += [f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for f in fps]
    fps = sorted(set(fps))
    monkeypatch.setattr(simhash, "plan_partitions", lambda *a: [((1 << 30) - 1, 1), (((1 << 34) - 1) << 30, 0)])
    root, want = edges_of(spark, fps), brute_components(fps)
    assert len({root[f] for f in fps}) == len(set(want))


@settings(max_examples=30, deadline=None)
@given(st.integers(2, 1 << 40), st.integers(0, 1 << 30))
def test_partition_plans_cover_the_budget(n, seed):
    rng = random.Random(seed)
    parts = simhash.plan_partitions([simhash._signed(rng.getrandbits(64)) for _ in range(32)], n, 2)
    masks = [m for m, _ in parts]
    assert all(a & b == 0 for i, a in enumerate(masks) for b in masks[:i])
    # a distance of 2 spread over the probed partitions leaves one within its threshold
    assert sum(t + 1 for _, t in parts) >= 3 or any(t >= 2 for _, t in parts)


def test_components_match_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in common.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
    assert common.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0
