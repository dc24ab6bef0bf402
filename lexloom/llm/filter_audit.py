"""How filters of a corpus interact: what each removes, in every order, by part.

1. Every text gets a mask of the filters it fails. Masks are counted by part.
2. A part's counts form its removal polynomial, the multilinear extension of
   "rows removed by a set of filters": f(x) = sum over masks of
   n * (1 - product over the mask of (1 - x_i)).
3. f at a 0/1 corner is what that set of filters removes, so differences of
   corners along an order give kept and removed rows of every step.
4. A filter's Shapley value is the integral of f's partial derivative along the
   diagonal x = (t, ..., t), taken with exact rationals; times k! it is the sum
   of what the filter removes over all k! orders.

Only masks, labels and text hashes are shuffled, never texts; counts are combined
before each shuffle, so one part or one text may hold any share of the rows.

Defined cases: a null text is empty; a null part is the empty string; labels are
joined by id, a row without label is neither good nor toxic, and of repeated
labels any 1 counts; a text repeats if an equal text (SHA-256) has a smaller id,
so rows that repeat an id do not repeat each other, and a null id is neither
smaller nor larger than any; repeated rows count each; an empty table gives no
row; other columns are ignored.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations
from math import factorial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, prepare

#: Names of the filters; bit i of a mask belongs to the i-th.
NAMES = "ABCDE"
BLANKS = r"[\x20\x09-\x0D]+"


def text_failures(text: Column) -> Column:
    """Bits 0 to 3: under 200 words; under half of the words distinct; over 2 % of the characters A-Z; any of #$%&*|."""
    words = F.array_remove(F.split(text, BLANKS), "")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    tests = [F.size(words) < 200, F.size(F.array_distinct(words)) * 100 < F.size(words) * 50, capitals * 100 > F.length(text) * 2, text.rlike("[#$%&*|]")]
    return sum((t.cast("int") * (1 << i) for i, t in enumerate(tests)), F.lit(0))


def failure_masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """Counts (part, mask, rows, good, toxic) of the documents, bit 4 of a mask: the text repeats one of a smaller id."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("sha"),
        text_failures(text).alias("mask")).groupBy("id", "part", "sha", "mask").agg(F.count("*").alias("n"))
    marks = labels.groupBy(F.col(id_col).alias("id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = materialize(rows.join(marks, "id", "left").fillna(0, ["good", "toxic"]), "masks")
    first = rows.groupBy("sha").agg(F.min("id").alias("id")).where("id IS NOT NULL").withColumn("first", F.lit(True))
    repeats = F.col("id").isNotNull() & F.col("first").isNull()
    return rows.join(first, ["sha", "id"], "left").groupBy("part", (F.col("mask") + repeats.cast("int") * 16).alias("mask")).agg(
        F.sum("n").alias("rows"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


class RemovalPolynomial:
    """f(x) = sum over sets T of c[T] * product of x_i, i in T, for k filters."""

    def __init__(self, counts: dict[int, int], k: int):
        self.k, self.c = k, [0] * (1 << k)
        for mask, n in counts.items():
            part = mask
            while part:  # every set within the mask, by the product's expansion
                self.c[part] += n if part.bit_count() % 2 else -n
                part = (part - 1) & mask

    def corner(self, chosen: int) -> int:
        """Rows that the chosen filters remove."""
        return sum(c for t, c in enumerate(self.c) if t & chosen == t)

    def shapley(self, i: int) -> Fraction:
        """Integral of the partial derivative by x_i along the diagonal, from 0 to 1."""
        powers = [0] * self.k
        for t, c in enumerate(self.c):
            if t >> i & 1:
                powers[t.bit_count() - 1] += c
        return sum((Fraction(c, p + 1) for p, c in enumerate(powers)), Fraction(0))


def audit_counts(masks: list[int], rows: list[int], good: list[int], toxic: list[int], names: str = NAMES) -> list[tuple]:
    """(order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for all orders of the filters."""
    k, every = len(names), (1 << len(names)) - 1
    removal, of_good, of_toxic = (RemovalPolynomial(dict(zip(masks, n, strict=True)), k) for n in (rows, good, toxic))
    corners = [[p.corner(s) for s in range(1 << k)] for p in (removal, of_good, of_toxic)]
    total, out = sum(rows), []
    alone = [corners[0][every] - corners[0][every ^ 1 << i] for i in range(k)]
    shapley = [removal.shapley(i) * factorial(k) for i in range(k)]
    assert all(s.denominator == 1 for s in shapley)
    for order in permutations(range(k)):
        before, name = 0, "".join(names[i] for i in order)
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            removed, lost_good, lost_toxic = (c[after] - c[before] for c in corners)
            out.append((name, step, total - corners[0][after], removed, corners[0][1 << i] - removed, alone[i], lost_good, lost_toxic, int(shapley[i])))
            before = after
    return out


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row per part, order of the five filters and step; a part's group has at most 32 rows."""
    prepare(docs.sparkSession)
    columns = ["filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]

    def audit(key, pdf: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(audit_counts(*(pdf[c].tolist() for c in ("mask", "rows", "good", "toxic"))), columns=columns)
        out.insert(0, "part", key[0])
        return out

    return failure_masks(docs, labels, id_col, text_col, part_col).groupBy("part").applyInPandas(
        audit, "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long")
