"""Row patterns against plain backtracking, with blocks of a few rows and runs over many blocks."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lexloom.llm.queries import op13_row_pattern_matching, table
from lexloom.llm.row_patterns import match_rows

SCHEMA = "client long, at long, id long, cents long, kind string, note string, key string, pos int"


def brute(rows, gap):
    """By the letters' definitions, row by row; rows (client, at, id, cents, kind)."""
    by, out = defaultdict(list), []
    for r in sorted(set(rows), key=lambda r: (r[0], r[1], r[2] is not None, r[2] or 0, r[3] is not None, r[3] or 0)):
        by[r[0]].append(r)
    for client, rs in by.items():
        i = number = 0
        while i < len(rs):
            labels, j, a = "A", i + 1, rs[i][3]
            while a is not None and j < len(rs) and rs[j][3] is not None and rs[j][1] - rs[j - 1][1] <= gap:
                cents, before, kind = rs[j][3], rs[j - 1][3], rs[j][4]
                if kind == "purchase" and cents >= a:
                    labels += "P"
                    break
                if kind in (None, "error") or cents == before:
                    break
                labels += "D" if cents < before else "U"
                j += 1
            if labels[-1] == "P":
                number += 1
                out.append((client, number, rs[i][2], rs[j][2], j - i + 1, sum(r[3] for r in rs[i:j + 1]), hashlib.sha256(labels.encode()).hexdigest()))
                i = j
            i += 1
    return sorted(out, key=lambda r: r[:2])


def found(spark, rows, gap, block_rows):
    df = spark.createDataFrame([(*r, "n", "clash", 3) for r in rows], SCHEMA)
    out = match_rows(df, F.col("client"), F.col("at"), F.col("id"), F.col("cents"), F.col("kind") != "error", F.col("kind") == "purchase", gap, block_rows)
    return sorted((tuple(r) for r in out.collect()), key=lambda r: r[:2])


def clicks(rng, n, high, errors=0.1, clients=3):
    """A third and more of the rows on one client."""
    kinds = ["view"] * 5 + ["purchase"] * 2 + (["error", None] if errors else [])
    rows = [(rng.choice([7, 7, rng.randrange(clients)]), rng.randrange(n * 4), i, rng.choice([None, *range(-2, high)]) if errors else rng.randrange(high), rng.choice(kinds)) for i in range(n)]
    return rows


@pytest.mark.parametrize(("seed", "high", "errors", "block_rows"), [(1, 12, 0.1, 20), (2, 10_000, 0, 10), (3, 10_000, 0, 25), (4, 40, 0, 12)])
def test_matches_equal_backtracking(spark, seed, high, errors, block_rows):
    rng = random.Random(seed)
    rows = clicks(rng, 300, high, errors)
    for gap in (30, 10_000):
        assert found(spark, rows, gap, block_rows) == brute(rows, gap)


def test_one_match_over_many_blocks(spark):
    """Falling rows, then a purchase above all: every block between is without a cut."""
    rows = [(1, i, i, 5000 - i, "view") for i in range(400)] + [(1, 400, 400, 6000, "purchase")]
    assert found(spark, rows, 10, 20) == brute(rows, 10) != []


def test_open_matches_end_by_their_cents(spark):
    """Purchases of rising cents inside a run of blocks without a cut: each threshold leaves by its own exit."""
    rng = random.Random(5)
    rows = [(1, i, i, rng.randrange(10) + (i * 7) % 300, "purchase" if i % 5 == 0 else "view") for i in range(400)]
    rows.append((1, 400, 400, 900, "purchase"))
    assert found(spark, rows, 10, 15) == brute(rows, 10)


def test_awkward_rows(spark):
    rows = [(1, 0, 1, 5, "view"), (1, 0, 1, 5, "view"), (1, 0, None, 4, "view"), (1, 1, 2, None, "purchase"), (1, 2, 3, 5, "purchase"), (1, 3, 3, 6, "purchase"), (1, 3, 3, 6, "purchase"),
            (None, 1, 9, 5, "purchase"), (1, None, 9, 5, "purchase"), (2, 0, 0, 1, "view"), (3, 1, 1, 2, "purchase"), (4, 0, 5, 3, None), (4, 1, 6, 3, "purchase"), (4, 12, 7, 3, "purchase"),
            (5, 0, None, 3, "view"), (5, 1, None, 4, "purchase")]
    want = brute([r for r in rows if r[0] is not None and r[1] is not None], 10)
    assert found(spark, rows, 10, 3) == want
    assert [r[2:4] for r in want if r[0] in (1, 5)] == [(3, 3), (None, None)]
    assert found(spark, [], 10, 3) == []


def test_query_equals_backtracking_on_the_table(spark, sf):
    c = table(spark, sf, "clicks").distinct().where("client_id IS NOT NULL AND ts IS NOT NULL")
    rows = [(r[0], r[1], r[2], r[3], r[4]) for r in c.select(
        "client_id", F.unix_micros(F.col("ts").cast("timestamp")), "click_id", F.floor(F.col("value") * 100 + 0.5), "kind").collect()]
    got = op13_row_pattern_matching(spark, sf)
    assert got.dtypes == [("client_id", "bigint"), ("match_no", "bigint"), ("first_id", "bigint"), ("last_id", "bigint"), ("n_rows", "bigint"), ("sum_cents", "bigint"), ("labels_sha256", "string")]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 600_000_000)
