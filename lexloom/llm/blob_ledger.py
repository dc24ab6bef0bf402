"""Secrets in every historical version of every path, by an incremental blob ledger.

A version's content is addressed by its SHA-256: equal contents are one blob,
whatever paths and versions hold it. The ledger, a Parquet folder, has rows
(blob, rules, spans): which rule versions that blob has been scanned with, and
what they found. ``update`` scans only pairs of blob and rule version that the
ledger lacks and appends them; ``findings`` joins the ledger back to all paths.
A rule whose pattern changes gets a new version, and only that rule is run again.

A blob's text is scanned once although many versions hold it: contents are
combined by address before and after the shuffle. Rows of one blob that many
paths share are joined by a plain equi-join, whose large partitions Spark splits
(adaptive skew join). A lost executor repeats its tasks; an append that is cut
off leaves whole rows, which a later update does not repeat, or none.

Matching is on UTF-8 bytes with ASCII letters and classes only, so a span never
cuts a character; spans are given in code points, end exclusive. Each rule is
searched leftmost, without overlap, and matches whose ``group`` is shorter than
``least`` are dropped.

Defined cases: null text is empty; empty text has no span but has its ledger
row; texts of any length are scanned whole; repeated rows each get their
findings; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _path, materialize, prepare


@dataclass(frozen=True)
class Rule:
    """A kind of secret. Matches need ``least`` bytes in ``group``; ``fold``: match on text with A-Z lowered."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int
    fold: bool = False

    @property
    def name(self) -> str:
        return f"{self.kind}/{self.version}"


#: The base rules.
BASE = (
    Rule("assign", 1, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", 1, r"[0-9a-f]+", 0, 16),
)
#: Further kinds, listed after the base ones.
ADDED = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 27),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
    Rule("forge", 1, r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
)
RULES = BASE + ADDED

SPAN = "struct<start: bigint, rank: int, kind: string, version: int, end: bigint>"
LEDGER = f"blob binary, rules array<string>, spans array<{SPAN}>"
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def spelled(rule: Rule) -> str:
    """The rule's pattern for engines that search unfolded text; in it, only groups and literals hold letters that fold."""
    either = lambda m: m[0] if len(m[0]) > 1 else f"[{m[0]}{m[0].upper()}]"
    if not rule.fold:
        return long_runs(rule)
    return re.sub(r"\\x..|\[[^\]]*\]|[a-z]", either, rule.pattern).replace("a-z0-9", "A-Za-z0-9")


def long_runs(rule: Rule) -> str:
    """A run of one class that is too short cannot hide a longer one, so its length goes into the pattern: far fewer matches."""
    run = re.fullmatch(r"(\[[^\]]+\])\+", rule.pattern)
    return f"{run[1]}{{{rule.least},}}" if run and not rule.group else rule.pattern


def compiled(rule: Rule) -> re.Pattern:
    return re.compile(long_runs(rule).encode())


def scan(data: bytes, rules: list[tuple[int, Rule, re.Pattern]]) -> list[dict]:
    """Spans of one text, by start and then by the rules' order."""
    folded = data.translate(LOWER) if any(r.fold for _, r, _ in rules) else data
    found = [
        (m.start(), rank, m.end(), rule)
        for rank, rule, pattern in rules
        for m in pattern.finditer(folded if rule.fold else data)
        if m.end(rule.group) - m.start(rule.group) >= rule.least
    ]
    if found and not data.isascii():
        points = np.concatenate([[0], np.cumsum((np.frombuffer(data, "u1") & 0xC0) != 0x80)])
        found = [(int(points[a]), rank, int(points[b]), rule) for a, rank, b, rule in found]
    return [{"start": a, "rank": rank, "kind": r.kind, "version": r.version, "end": b} for a, rank, b, r in sorted(found, key=lambda x: x[:3])]


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger's rows; none if nothing has been written yet."""
    fs, jpath = _path(spark, path)
    return spark.read.schema(LEDGER).parquet(path) if fs.exists(jpath) else spark.createDataFrame([], LEDGER)


def _content(text_col: str):
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def _address(text_col: str):
    return F.unhex(F.sha2(_content(text_col), 256)).alias("blob")


def unseen(versions: DataFrame, rules: tuple[Rule, ...], path: str, text_col: str = "text") -> DataFrame:
    """(blob, text, rules): each distinct content with the rule versions that the ledger lacks for it."""
    wanted = F.array(*[F.lit(r.name) for r in rules])
    blobs = versions.select(_address(text_col), _content(text_col).cast("binary").alias("text")).groupBy("blob").agg(F.any_value("text").alias("text"))
    seen = read_ledger(versions.sparkSession, path).groupBy("blob").agg(F.flatten(F.collect_set("rules")).alias("seen"))
    return blobs.join(seen, "blob", "left").select(
        "blob", "text", F.when(F.col("seen").isNull(), wanted).otherwise(F.array_except(wanted, "seen")).alias("rules")).where(F.size("rules") > 0)


def update(versions: DataFrame, rules: tuple[Rule, ...], path: str, text_col: str = "text") -> None:
    """Scan what the ledger at ``path`` lacks and append it."""
    spark = versions.sparkSession
    prepare(spark)

    def run(batches):
        ready = {r.name: (rank, r, compiled(r)) for rank, r in enumerate(rules)}
        for b in batches:
            names = b.column(2).to_pylist()
            spans = [scan(t, [ready[n] for n in due]) for t, due in zip(b.column(1).to_pylist(), names, strict=True)]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("rank", pa.int32()), ("kind", pa.string()), ("version", pa.int32()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(spans, kind)], names=["blob", "rules", "spans"])

    unseen(versions, rules, path, text_col).mapInArrow(run, LEDGER).write.mode("append").option("compression", "zstd").parquet(path)


def findings(versions: DataFrame, rules: tuple[Rule, ...], path: str, id_cols: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """Every version (its ``id_cols``) with its blob and the spans of the given rule versions, by start and then by rule."""
    spark, names = versions.sparkSession, {r.name: rank for rank, r in enumerate(rules)}
    name = lambda s: F.concat_ws("/", s["kind"], s["version"].cast("string"))
    ranks = F.create_map(*[x for n, rank in names.items() for x in (F.lit(n), F.lit(rank))])
    current = F.filter(F.flatten(F.collect_set("spans")), lambda s: name(s).isin(*names))
    ranked = F.transform(current, lambda s: F.struct(
        s["start"].alias("start"), ranks[name(s)].alias("rank"), s["kind"].alias("kind"), s["version"].alias("version"), s["end"].alias("end")))
    found = read_ledger(spark, path).groupBy("blob").agg(F.array_sort(F.array_distinct(ranked)).alias("spans"))
    # written first, so that the join stands on two exchanges and Spark can split a blob of many paths
    return versions.select(*id_cols, _address(text_col)).join(materialize(found, "findings"), "blob")

