"""Running sums and folds over blocks against loops, with a key that fills most blocks."""

import random

import pytest
from pyspark.sql import functions as F

from lexloom.operators import ingest, limits, ordered


def rows(n, seed, hot=0.6):
    rng = random.Random(seed)
    return [(7 if rng.random() < hot else rng.randrange(6), i, rng.randrange(0, n * 6), rng.randrange(1, 9)) for i in range(n)]


@pytest.mark.parametrize("block_rows", [15, 500_000])
def test_running_sum(spark, block_rows):
    data = [*rows(300, 1), (None, 900, 5, 2), (None, 901, 6, 3)]
    df = spark.createDataFrame(data, "k int, id int, t int, v int")
    got = ordered.running(ordered.deal(df, ["k"], ["t", "id"], block_rows), ["k"], ["t", "id"], F.col("v"), "s")
    want, total = {}, {}
    for k, i, _, v in sorted(data, key=lambda r: (r[2], r[1])):
        want[i] = total.get(k, 0)
        total[k] = want[i] + v
    assert {r["id"]: r["s"] for r in got.collect()} == want
    if block_rows == 15:
        assert got.select(ordered.BLOCK).distinct().count() > 10


def loop(times, limit, us):
    recent, out = [], []
    for t in times:
        recent = [x for x in recent if x >= t - us]
        out.append(len(recent) < limit)
        if out[-1]:
            recent.append(t)
    return out


@pytest.mark.parametrize(("seed", "block_rows", "limit", "seconds"), [(2, 12, 3, 90), (3, 20, 1, 7), (4, 10, 5, 10_000), (5, 500_000, 3, 90)])
def test_fold_over_blocks_of_one_key(spark, seed, block_rows, limit, seconds):
    data = rows(260, seed)
    df = spark.createDataFrame(data, "user_id int, event_id int, t int, v int").withColumn("ts", F.timestamp_seconds("t"))
    want = {}
    for user in {r[0] for r in data}:
        own = sorted((r for r in data if r[0] == user), key=lambda r: (r[2], r[1]))
        want |= dict(zip([r[1] for r in own], loop([r[2] for r in own], limit, seconds), strict=True))
    got = limits.sliding_limit(df, limit, seconds, block_rows=block_rows).collect()
    assert len(got) == len(data) and {r["event_id"]: r["accepted"] for r in got} == want


def test_fold_of_nothing(spark):
    df = spark.createDataFrame([], "user_id int, event_id int, ts timestamp")
    assert limits.sliding_limit(df).count() == 0


def test_limits_and_streaks_over_small_blocks(spark):
    data = rows(200, 6)
    df = spark.createDataFrame(data, "user_id int, event_id int, t int, chars int").withColumn("ts", F.timestamp_seconds("t"))
    got = {r["event_id"]: r["accepted"] for r in limits.fixed_window_limit(df, 5, "10 minutes", block_rows=20).collect()}
    seen, want = {}, {}
    for _, i, t, _ in sorted(data, key=lambda r: (r[2], r[1])):
        seen[t // 600] = seen.get(t // 600, 0) + 1
        want[i] = seen[t // 600] <= 5
    assert got == want
    bad = spark.createDataFrame([("s", f"{i:04d}", "Failed" if i % 37 else "Skipped") for i in range(300)] + [("t", "1", "Failed"), ("u", "1", "Indexed")], "source string, external_id string, outcome string")
    assert {r["source"]: r["longest"] for r in ingest.fail_streaks(bad).collect()} == {"s": 36, "t": 1, "u": 0}
