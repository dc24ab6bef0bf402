r"""Chat formatting into budgeted windows, in DataFrame operations only.

Turns are laid out in order by a range shuffle; their token costs are summed to
a prefix sum by partition and carried over partitions, so a conversation of any
size is spread over many tasks. With G the budget left after the system turn
and the history allowance, a turn of more than G/2 is a window of its own, and
the others go to windows by where their prefix sum starts in steps of G/2; such
a window holds at most G. Windows are whole turns in order. Every window but
the first repeats the conversation's leading system turn and up to
``history_turns`` preceding turns of at most ``history_tokens`` in all. Only a
turn too large by itself exceeds the budget; such windows are marked, never cut.

Template: every turn has an opening and a closing control string. A control
string inside a text gets a backslash behind its first character, and one that
already has backslashes there gets one more, so the text can be restored.

Loss mask: character spans of the assistant texts of a window's own turns;
repeated turns are never under the mask.

Null texts and roles count as empty; null conversation ids form a conversation;
rows of equal turn numbers are ordered by role and text; repeated rows are
turns of their own; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import materialize

#: Opening and closing control strings by role; other roles are
#: named between [ROLE] and [/ROLE].
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
ROLE = ("[ROLE]", "[/ROLE]", "[/TURN]")
#: What follows the first character of each control string.
TAILS = r"(?:<SYS>>|</SYS>>|INST\]|/INST\]|s>|/s>|ROLE\]|/ROLE\]|/TURN\])"
ESCAPE = rf"([<\[])(\\*{TAILS})"
UNESCAPE = rf"([<\[])\\(\\*{TAILS})"
TURN = r"(?s)(<<SYS>>|\[INST\]|<s>|\[ROLE\])(.*?)(<</SYS>>|\[/INST\]|</s>|\[/TURN\])"
#: Turns per block, for joins of a conversation's rows with its system turn.
BLOCK = 4096


def escape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPE, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, UNESCAPE, "$1$2")


def default_cost(text: Column) -> Column:
    """Token estimate: runs of letters and of digits, and other marks; 4 for the template."""
    return F.regexp_count(text, F.lit(r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]")).cast("long") + 4


def opening(role: Column) -> Column:
    out = F.concat(F.lit(ROLE[0]), escape(role), F.lit(ROLE[1]))
    for name, (start, _) in MARKS.items():
        out = F.when(role == name, start).otherwise(out)
    return out


def closing(role: Column) -> Column:
    out = F.lit(ROLE[2])
    for name, (_, end) in MARKS.items():
        out = F.when(role == name, end).otherwise(out)
    return out


def ordered_turns(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, cost) -> DataFrame:
    """Rows (ck, conv, pos, role, text, cost, before): position and cost before it, from 0."""
    turns = conversations.select(
        F.col(conv_col).alias("conv"), F.coalesce(F.col(conv_col).cast("string"), F.lit("\u0000")).alias("ck"),
        F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    ).withColumn("cost", cost(F.col("text"))).withColumn("tie", F.xxhash64("text"))
    order = ["turn", "role", "tie", "text"]
    laid = turns.repartitionByRange("ck", "turn", "role", "tie").sortWithinPartitions("ck", *order).withColumn("part", F.spark_partition_id())
    laid = materialize(laid, "turns")
    own = W.partitionBy("part", "ck").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    local = laid.withColumn("pos", F.row_number().over(W.partitionBy("part", "ck").orderBy(*order)).cast("long") - 1).withColumn(
        "before", F.coalesce(F.sum("cost").over(own), F.lit(0)))
    earlier = W.partitionBy("ck").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    carry = laid.groupBy("part", "ck").agg(F.count("*").alias("n"), F.sum("cost").alias("c")).select(
        "part", "ck", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n"), F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("c"))
    return local.join(carry, ["part", "ck"]).select(
        "ck", "conv", (F.col("pos") + F.col("n")).alias("pos"), "role", "text", "cost", (F.col("before") + F.col("c")).alias("before"))


def split_windows(turns: DataFrame, budget: int, history_tokens: int) -> DataFrame:
    """``turns`` plus own (the window's key within its conversation) and the system turn's cost."""
    heads = turns.where("pos = 0 AND role = 'system'").select("ck", F.col("cost").alias("sys"))
    blocks = turns.groupBy("ck").agg(F.max("pos").alias("last")).join(heads, "ck").select(
        "ck", "sys", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"last DIV {BLOCK}"))).alias("block"))
    room = F.greatest(F.lit(budget) - F.coalesce("sys", F.lit(0)) - history_tokens, F.lit(max(2, budget // 4)))
    framed = turns.withColumn("block", F.expr(f"pos DIV {BLOCK}")).join(blocks, ["ck", "block"], "left").withColumn("half", (room / 2).cast("long"))
    framed = framed.withColumn("big", (F.col("cost") > F.col("half")).cast("long"))
    # big turns before a turn: inside its block by a window, over blocks by a carry
    inside = W.partitionBy("ck", "block").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    earlier = W.partitionBy("ck").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    carry = framed.groupBy("ck", "block").agg(F.sum("big").alias("c")).select("ck", "block", F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("c"))
    framed = framed.withColumn("over", F.coalesce(F.sum("big").over(inside), F.lit(0))).join(carry, ["ck", "block"])
    step = F.when(F.col("big") == 1, 0).otherwise(F.expr("before DIV greatest(half, 1)"))
    return framed.withColumn("own", F.struct((F.col("over") + F.col("c")).alias("over"), "big", step.alias("step"))).drop("over", "c", "big", "half")


def format_windows(conversations: DataFrame, budget: int = 2048, history_turns: int = 2, history_tokens: int = 512, cost=default_cost,
                   conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows (conv_id, first_turn, repeated, tokens, over_budget, text, loss).

    ``first_turn`` is the position of the window's first own turn; the first
    ``repeated`` turns of ``text`` are the system turn and history; ``loss`` are
    (start, length) character spans, from 0.
    """
    turns = materialize(split_windows(ordered_turns(conversations, conv_col, turn_col, role_col, text_col, cost), budget, history_tokens), "windows")
    windows = turns.groupBy("ck", "own").agg(F.min("pos").alias("first"))
    own = turns.join(windows, ["ck", "own"]).select("ck", "conv", "first", "pos", "role", "text", "cost", F.lit(False).alias("repeated"))
    wanted = windows.where("first > 0").select("ck", "first", F.explode(F.sequence(F.col("first") - history_turns, F.col("first") - 1)).alias("pos")) if history_turns else None
    parts = [own]
    head = turns.where("pos = 0 AND role = 'system'")
    later = windows.where("first > 0").select("ck", "first", F.expr(f"first DIV {BLOCK}").alias("block"))
    spread = head.join(turns.groupBy("ck").agg(F.max("pos").alias("last")), "ck").select(
        "ck", "conv", "pos", "role", "text", "cost", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"last DIV {BLOCK}"))).alias("block"))
    parts.append(later.join(spread, ["ck", "block"]).select("ck", "conv", "first", "pos", "role", "text", "cost", F.lit(True).alias("repeated")))
    if wanted is not None:
        back = W.partitionBy("ck", "first").orderBy(F.col("pos").desc()).rowsBetween(W.unboundedPreceding, 0)
        history = wanted.where("pos >= 0").join(turns.where("NOT (pos = 0 AND role = 'system')").select("ck", "conv", "pos", "role", "text", "cost"), ["ck", "pos"])
        history = history.withColumn("sum", F.sum("cost").over(back)).where(F.col("sum") <= history_tokens)
        parts.append(history.select("ck", "conv", "first", "pos", "role", "text", "cost", F.lit(True).alias("repeated")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = rows.withColumn("start", opening(F.col("role"))).withColumn("body", escape(F.col("text"))).withColumn("end", closing(F.col("role")))
    loss = (F.col("role") == "assistant") & ~F.col("repeated")
    piece = F.struct("pos", F.concat("start", "body", "end").alias("full"), F.length("start").alias("lead"), F.length("body").alias("size"),
                     F.length(F.concat("start", "body", "end")).alias("width"), loss.alias("loss"))
    made = rows.groupBy("ck", "first").agg(
        F.first("conv").alias("conv"), F.sum("cost").alias("tokens"), F.sum(F.col("repeated").cast("int")).alias("repeated"),
        F.array_sort(F.collect_list(piece)).alias("pieces"))
    spans = F.expr("""aggregate(pieces, struct(0 AS at, CAST(array() AS array<struct<start:int,length:int>>) AS spans),
        (a, p) -> struct(a.at + p.width AS at,
                         CASE WHEN p.loss THEN concat(a.spans, array(struct(a.at + p.lead AS start, p.size AS length))) ELSE a.spans END AS spans),
        a -> a.spans)""")
    return made.select(
        F.col("conv").alias("conv_id"), F.col("first").alias("first_turn"), "repeated", "tokens", (F.col("tokens") > budget).alias("over_budget"),
        F.array_join(F.col("pieces.full"), "").alias("text"), spans.alias("loss"))


def read_turns(text: Column) -> Column:
    """Array of (role, text) read back from a window's text."""
    raw = F.regexp_extract_all(text, F.lit(TURN), F.lit(0))

    def parse(t: Column) -> Column:
        role, body = F.lit(None).cast("string"), F.lit(None).cast("string")
        named = F.substring_index(F.substr(t, F.lit(len(ROLE[0]) + 1)), ROLE[1], 1)
        role = unescape(named)
        lead = F.length(named) + len(ROLE[0]) + len(ROLE[1])
        body = F.substr(t, lead + 1, F.length(t) - lead - len(ROLE[2]))
        for name, (start, end) in MARKS.items():
            mine = F.startswith(t, F.lit(start))
            role = F.when(mine, name).otherwise(role)
            body = F.when(mine, F.substr(t, F.lit(len(start) + 1), F.length(t) - len(start) - len(end))).otherwise(body)
        return F.struct(role.alias("role"), unescape(body).alias("text"))

    return F.transform(raw, parse)


def read_loss(text: Column, loss: Column) -> Column:
    """The unescaped texts under the loss mask, joined."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substr(text, s["start"] + 1, s["length"]))), "")
