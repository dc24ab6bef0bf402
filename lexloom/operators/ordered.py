"""Running sums and folds over ordered rows of keys that may hold any share of them.

Rows are dealt by range over (key, order) into blocks and written once, so a
key's rows lie in consecutive blocks and no task holds more than a block.

* ``running``: each block sums its own rows, the blocks' totals are summed in two
  levels, and a row adds what precedes its block. Nothing is grouped by key alone.
* ``fold``: every block folds its rows from an empty state. Only its first key can
  have begun earlier; if its predecessor ended in that key, those rows are folded
  again from the predecessor's last state. A block that lies within one key hands
  its new state on, so rounds go on until no state changes: at most as many as
  blocks that one key fills, two as a rule.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources.workspace import shared_folder

BLOCK_ROWS = 500_000
#: Blocks of one group of the two-level sums.
GROUP = 1024
BLOCK = "_block"


def stored(df: DataFrame, name: str) -> DataFrame:
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def deal(df: DataFrame, by: list[str], order: list[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``df`` with its block, written to the shared folder; blocks follow (by, order)."""
    blocks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // block_rows))
    return stored(df.repartitionByRange(blocks, *by, *order).withColumn(BLOCK, F.spark_partition_id().cast("long")), "dealt")


def same_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join by keys that may be null; never broadcast, as both sides grow with the input."""
    renamed = right.withColumnsRenamed({c: f"_r{c}" for c in keys}).hint("merge")
    return left.join(renamed, [F.col(c).eqNullSafe(F.col(f"_r{c}")) for c in keys], how).drop(*[f"_r{c}" for c in keys])


def before_block(totals: DataFrame, by: list[str], value: str, how=F.sum) -> DataFrame:
    """(by, block, before): ``how`` of the values of a key's earlier blocks, null for its first."""
    t = totals.withColumn("_g", F.floor(F.col(BLOCK) / GROUP))
    within = W.partitionBy(*by, "_g").orderBy(BLOCK).rowsBetween(W.unboundedPreceding, -1)
    over = W.partitionBy(*by).orderBy("_g").rowsBetween(W.unboundedPreceding, -1)
    groups = t.groupBy(*by, "_g").agg(how(value).alias("_x")).withColumn("_ahead", how("_x").over(over)).drop("_x")
    both = same_keys(t.withColumn("_own", how(value).over(within)), groups, [*by, "_g"])
    total = F.coalesce("_own", "_ahead") if how is not F.sum else F.when(F.col("_own").isNull(), F.col("_ahead")).otherwise(F.col("_own") + F.coalesce("_ahead", F.lit(0)))
    return both.select(*by, BLOCK, total.alias("before"))


def running(dealt: DataFrame, by: list[str], order: list[str], value, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the key's earlier rows (0 for its first). ``dealt`` by (by, order)."""
    rows = dealt.withColumn("_v", value.cast("long"))
    before = before_block(rows.groupBy(*by, BLOCK).agg(F.sum("_v").alias("_t")), by, "_t")
    local = F.sum("_v").over(W.partitionBy(BLOCK, *by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    rows = same_keys(rows.withColumn("_local", local), before, [*by, BLOCK], "left")
    return rows.select(*dealt.columns, (F.coalesce("_local", F.lit(0)) + F.coalesce("before", F.lit(0))).alias(out))


def previous(dealt: DataFrame, by: list[str], order: list[str], out: str) -> DataFrame:
    """Adds ``out``: the first order column of the key's row before, null for its first. ``dealt`` by (by, order)."""
    at = order[0]
    before = before_block(dealt.groupBy(*by, BLOCK).agg(F.max(at).alias("_t")), by, "_t", F.max)
    rows = same_keys(dealt.withColumn("_local", F.lag(at).over(W.partitionBy(BLOCK, *by).orderBy(*order))), before, [*by, BLOCK], "left")
    return rows.select(*dealt.columns, F.coalesce("_local", "before").alias(out))


def sessions(df: DataFrame, by: str, at: str, tie: str, seconds: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(by, session_start, session_end, n): rows of a key at most ``seconds`` apart, the end being the last row's time.

    A session may hold any share of the rows; rows without key or time have none.
    """
    rows = deal(df.where(F.col(by).isNotNull() & F.col(at).isNotNull()).select(by, at, tie), [by], [at, tie], block_rows)
    rows = previous(rows, [by], [at, tie], "_before")
    opens = F.col("_before").isNull() | (F.col(at) > F.col("_before") + F.make_dt_interval(secs=F.lit(seconds)))
    rows = running(rows.withColumn("_opens", opens.cast("int")), [by], [at, tie], F.col("_opens"), "_earlier")
    numbered = rows.withColumn("_session", F.col("_earlier") + F.col("_opens"))
    return numbered.groupBy(by, "_session").agg(F.min(at).alias("session_start"), F.max(at).alias("session_end"), F.count("*").alias("n")).drop("_session")


Step = Callable[[list[int], int], tuple[list[int], bool]]


def fold(df: DataFrame, key: str, at: str, tie: str, step: Step, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(key, at, tie, accepted): ``step(state, at) -> (state, accepted)`` over a key's rows by (at, tie).

    key and tie of any orderable type, ``at`` long; the state is a short list of
    whole numbers, empty at first.
    """
    src = df.select(key, at, tie)
    types = dict(src.dtypes)
    blocks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // block_rows))
    row = f"`{key}` {types[key]}, `{at}` long, `{tie}` {types[tie]}, accepted boolean"
    schema = f"{row}, {BLOCK} long, head boolean, one boolean, state array<long>"

    def first_pass(frames):
        """Rows as they come; the last row of the block carries its last key's state."""
        from pyspark import TaskContext

        block, who, state, heads, first, held = TaskContext.get().partitionId(), None, [], True, None, None
        for f in frames:
            if not len(f):
                continue
            if held is not None:
                yield held
            ok, head = [], []
            first = f[key].iloc[0] if first is None else first
            for k, t in zip(f[key], f[at], strict=True):
                if k != who:
                    who, state, heads = k, [], who is None
                state, accepted = step(state, t)
                ok.append(accepted)
                head.append(heads)
            held = f.assign(accepted=ok, **{BLOCK: block, "head": head, "one": False, "state": [None] * len(f)})
        if held is not None:
            at_end = held.index[-1]
            held.at[at_end, "state"] = state
            held.loc[at_end, "one"] = heads
            yield held

    def again(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values([at, tie], kind="stable")
        state, ok = [int(x) for x in f["carry"].iloc[0]], []
        for t in f[at]:
            state, accepted = step(state, t)
            ok.append(accepted)
        out = f.assign(accepted=ok, state=[*[None] * (len(f) - 1), state])
        return out[[key, at, tie, "accepted", BLOCK, "head", "one", "state"]]

    laid = src.where(F.col(key).isNotNull() & F.col(at).isNotNull()).repartitionByRange(blocks, key, at, tie).sortWithinPartitions(key, at, tie)
    rows = stored(laid.mapInPandas(first_pass, schema), "folded")
    ends = rows.where("state IS NOT NULL").select(BLOCK, F.col(key).alias("last"), "state", "one").withColumn("_one", F.lit(1))
    before = before_block(ends.withColumn("_b", F.col(BLOCK)), ["_one"], "_b", F.max).select(BLOCK, F.col("before").alias("prior"))
    firsts = rows.where("head").groupBy(BLOCK).agg(F.first(key).alias("first"))
    links = stored(firsts.join(before, BLOCK).where("prior IS NOT NULL"), "links")  # a row a block
    heads = rows.where("head").drop("state").withColumn("state", F.lit(None).cast("array<long>"))
    ends = stored(ends.drop("_one"), "ends")
    fixed = None
    given = links.select(BLOCK).withColumn("carry", F.array().cast("array<long>"))
    while True:
        prior = ends.select(F.col(BLOCK).alias("prior"), "last", F.col("state").alias("carry"))
        carried = links.join(prior, "prior").where("last = first").select(BLOCK, "carry")
        changed = stored(carried.join(given.withColumnRenamed("carry", "old"), BLOCK).where("carry <> old").drop("old"), "changed")
        if changed.isEmpty():
            break
        redone = stored(heads.join(changed, BLOCK).groupBy(BLOCK).applyInPandas(again, schema), "redone")
        fixed = redone if fixed is None else stored(fixed.join(changed.select(BLOCK), BLOCK, "left_anti").unionByName(redone), "fixed")
        moved = redone.where("one AND state IS NOT NULL").select(BLOCK, F.col(key).alias("last"), "state", "one")
        ends = stored(ends.join(moved.select(BLOCK), BLOCK, "left_anti").unionByName(moved), "ends")
        given = stored(given.join(changed.select(BLOCK), BLOCK, "left_anti").unionByName(changed), "given")
    out = [key, at, tie, "accepted"]
    if fixed is None:
        return rows.select(*out)
    kept = rows.join(fixed.select(BLOCK).distinct().withColumn("head", F.lit(True)), [BLOCK, "head"], "left_anti")
    return kept.select(*out).unionByName(fixed.select(*out))
