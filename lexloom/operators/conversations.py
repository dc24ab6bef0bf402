"""Conversation log: list, messages, feedback, stored sources, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Accepted feedback.
VERDICTS = ["up", "down", "wrong-answer", "needless-refusal"]
RETENTION_DAYS = 183
SOURCE = "array<struct<Index:int,Label:string,Title:string,Url:string,Snippet:string,AmendmentEffectiveDate:string>>"


def conversation_list(conversations: DataFrame, user: str, limit: int = 50) -> DataFrame:
    return conversations.where(F.col("user_id") == user).orderBy(F.desc("updated_at"), F.asc("conv_id")).limit(limit)


def messages_of(conversations: DataFrame, messages: DataFrame, user: str, conv_id) -> DataFrame:
    own = conversations.where((F.col("user_id") == user) & (F.col("conv_id") == conv_id)).select("conv_id")
    return messages.join(own, "conv_id", "left_semi").orderBy("created_at", "message_id")


def touch(conversations: DataFrame, new_messages: DataFrame) -> DataFrame:
    """A message moves its conversation's updated_at forward."""
    last = new_messages.groupBy("conv_id").agg(F.max("created_at").alias("_last"))
    return conversations.join(last, "conv_id", "left").withColumn("updated_at", F.greatest("updated_at", "_last")).drop("_last")


def accepted_feedback(feedback: DataFrame, messages: DataFrame, conversations: DataFrame) -> DataFrame:
    """Feedback on the user's own messages with a known verdict; the latest per message counts."""
    own = messages.join(conversations.select("conv_id", F.col("user_id").alias("owner")), "conv_id").select("message_id", "owner")
    ok = feedback.where(F.col("verdict").isin(VERDICTS)).join(own, "message_id").where("user_id = owner").drop("owner")
    return ok.groupBy("message_id", "user_id").agg(F.max_by("verdict", F.struct("created_at", "verdict")).alias("verdict"))


def stored_sources(json: Column) -> Column:
    """Tolerant parse: missing fields are empty, elements that are no objects go, bad JSON gives none."""
    parsed = F.filter(F.coalesce(F.from_json(json, SOURCE), F.array().cast(SOURCE)), lambda s: s.isNotNull())
    return F.transform(parsed, lambda s: F.struct(
        F.coalesce(s["Index"], F.lit(0)).alias("index"), *[F.coalesce(s[n], F.lit("")).alias(n.lower()) for n in ("Label", "Title", "Url", "Snippet")],
        s["AmendmentEffectiveDate"].alias("amendment_effective_date")))


def retain(parents: DataFrame, as_of, days: int = RETENTION_DAYS, at: str = "updated_at") -> DataFrame:
    """Parents active in the last ``days`` days before ``as_of``."""
    return parents.where(F.col(at) >= F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {int(days)} DAYS"))


def cascade(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    return children.join(parents.select(key), key, "left_semi")


def invite(codes: dict[str, str], code: Column) -> Column:
    """User of an invite code: trimmed, with case."""
    if not codes:
        return F.lit(None).cast("string")
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in codes.items() for x in kv]), F.trim(code))
