"""From retrieved rows to a cited prompt: gate, newer amendments, messages, checks."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.citations import citation_check
from ..functions.text import sanitize_history
from .retrieval import STRUCTURAL_SCORE

HISTORY_TURNS = 4
#: Rules given to the model; a deployment passes its own text.
SYSTEM_RULES = (
    "Odpowiadaj wyłącznie na podstawie ponumerowanych źródeł i przy każdej tezie podaj numer źródła w nawiasie kwadratowym. "
    'Jeśli źródła nie zawierają odpowiedzi, napisz dokładnie: "Nie mam wystarczających źródeł, aby odpowiedzieć." '
    "Nie wymyślaj przepisów ani sygnatur. Źródło oznaczone jako nowelizacja zmienia przepis: podaj stan po zmianie i oba źródła."
)


def abstain(signal: Column, n_rows: Column, threshold: float = 0.55) -> Column:
    """No rows, or a signal below the threshold."""
    return (F.coalesce(n_rows, F.lit(0)) == 0) | (F.coalesce(signal, F.lit(0.0)) < threshold)


def unabsorbed_map(acts: DataFrame, column: str = "unabsorbed") -> DataFrame:
    """(act, amendment, effective_date) of all acts' amendments that are not yet in their texts."""
    e = acts.select(F.col("external_id").alias("act"), F.explode(column).alias("a"))
    rows = e.select("act", F.lower("a.eli_id").alias("amendment"), F.col("a.effective_date").alias("effective_date"))
    return rows.groupBy("act", "amendment").agg(F.max("effective_date").alias("effective_date"))


def tag_amendments(rows: DataFrame, unabsorbed: DataFrame) -> DataFrame:
    """Adds amendment_date to rows whose own document is such an amendment."""
    dates = unabsorbed.groupBy("amendment").agg(F.max("effective_date").alias("amendment_date"))
    return rows.join(dates, F.lower(rows["external_id"]) == dates["amendment"], "left").drop("amendment")


def mentioned_articles(text: Column) -> Column:
    """Lower-cased article numbers after "art.", found in one pass over the text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(?iU)\bart(?=\.?\s*(\w+))"), F.lit(1)), lambda a: F.lower(a)))


def mentions_any(text: Column, articles: Column) -> Column:
    """Whether the text names one of the articles; the cost does not grow with their number.

    A number of letters and digits equals a whole word after "art."; only others
    (with brackets or hyphens) are searched one by one.
    """
    plain = lambda a: F.regexp_like(a, F.lit(r"(?U)^\w+$"))
    words = F.transform(F.filter(articles, plain), lambda a: F.lower(a))
    odd = F.filter(articles, lambda a: ~plain(a))
    return F.arrays_overlap(mentioned_articles(text), words) | F.exists(odd, lambda a: F.regexp_like(text, F.concat(F.lit(r"(?iU)\bart\.?\s*\Q"), a, F.lit(r"\E\b"))))


def append_amendments(rows: DataFrame, cited: DataFrame, unabsorbed: DataFrame, chunks: DataFrame) -> DataFrame:
    """Rows plus chunks of unabsorbed amendments that mention an article of interest.

    rows (qid, id, pos, external_id, doc_type, article_no, text); cited (qid,
    article); chunks (id, external_id, text). Articles of interest are those of
    the hits of an act and the cited ones. Appended rows come after all others,
    with a marker, so a prompt can exceed k.
    """
    hits = rows.where("doc_type = 'act'").groupBy("qid", F.col("external_id").alias("act")).agg(F.collect_set(F.lower("article_no")).alias("own"))
    asked = cited.groupBy("qid").agg(F.collect_set(F.lower("article")).alias("asked"))
    interest = hits.join(asked, "qid", "left").select("qid", "act", F.array_union("own", F.coalesce("asked", F.array().cast("array<string>"))).alias("articles"))
    wanted = interest.join(unabsorbed, "act").groupBy("qid", "amendment").agg(
        F.array_distinct(F.flatten(F.collect_list("articles"))).alias("articles"), F.max("effective_date").alias("amendment_date"))
    found = chunks.withColumn("amendment", F.lower("external_id")).join(wanted, "amendment").where(mentions_any(F.col("text"), F.col("articles")))
    found = found.join(rows.select("qid", "id"), ["qid", "id"], "left_anti")
    last = rows.groupBy("qid").agg(F.max("pos").alias("last"))
    mark = F.concat(F.lit("[NOWELIZACJA"), F.when(F.col("amendment_date").isNotNull(), F.concat(F.lit(" od "), F.col("amendment_date"))).otherwise(""), F.lit("] "))
    new = found.join(last, "qid").select(
        "qid", "id", (F.col("last") + F.row_number().over(W.partitionBy("qid").orderBy("id"))).alias("pos"), "external_id", F.lit("act").alias("doc_type"),
        F.lit(None).cast("string").alias("article_no"), F.concat(mark, "text").alias("text"), "amendment_date", F.lit(STRUCTURAL_SCORE).alias("score"))
    return tag_amendments(rows, unabsorbed).withColumn("score", F.lit(None).cast("double")).unionByName(new)


def source_block(rows: DataFrame, label: str = "label", text: str = "text", order: str = "pos") -> DataFrame:
    """(qid, sources, n_sources): numbered sources of each question, in order."""
    n = F.row_number().over(W.partitionBy("qid").orderBy(order))
    numbered = rows.withColumn("n", n)
    line = F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] "), F.col(label), F.lit("\n"), F.col(text), F.lit("\n\n"))
    return numbered.groupBy("qid").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("l")))), lambda s: s["l"]), "").alias("sources"), F.max("n").alias("n_sources"))


def user_message(question: Column, sources: Column) -> Column:
    return F.concat(F.lit("PYTANIE:\n"), question, F.lit("\n\nŹRÓDŁA:\n"), F.coalesce(sources, F.lit("")))


def coalesce_roles(messages: DataFrame, key: str, order: str, role: str = "role", text: str = "text") -> DataFrame:
    """Neighbours of the same role become one message, joined by a blank line."""
    w = W.partitionBy(key).orderBy(order)
    change = F.when(F.col(role).eqNullSafe(F.lag(role).over(w)), 0).otherwise(1)
    islands = messages.withColumn("_c", change).withColumn("island", F.sum("_c").over(w))
    return islands.groupBy(key, "island", role).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda s: s[text]), "\n\n").alias(text), F.min(order).alias(order))


def grounded_prompt(questions: DataFrame, rows: DataFrame, history: DataFrame | None = None, system: str = SYSTEM_RULES) -> DataFrame:
    """(qid, messages): ordered array of (role, content), roles strictly alternating after the system message.

    questions (qid, question); rows (qid, pos, label, text); history (qid,
    turn, question, answer): the last four turns, answers without markers.
    """
    block = source_block(rows)
    last = questions.join(block, "qid", "left").select("qid", F.lit(1 << 40).alias("at"), F.lit("user").alias("role"), user_message(F.col("question"), F.col("sources")).alias("text"))
    parts = last
    if history is not None:
        recent = history.withColumn("r", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("turn")))).where(F.col("r") <= HISTORY_TURNS)
        recent = recent.where(F.length(F.trim("question")) > 0)
        asked = recent.select("qid", (F.col("turn").cast("long") * 2).alias("at"), F.lit("user").alias("role"), F.col("question").alias("text"))
        told = recent.where(F.length(F.trim("answer")) > 0).select(
            "qid", (F.col("turn").cast("long") * 2 + 1).alias("at"), F.lit("assistant").alias("role"), sanitize_history(F.col("answer")).alias("text"))
        parts = last.unionByName(asked).unionByName(told)
    merged = coalesce_roles(parts, "qid", "at")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("island", "role", "text"))), lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content")))
    head = F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")))
    return merged.groupBy("qid").agg(F.concat(head, ordered).alias("messages"))


def complete(prompts: DataFrame, model: Callable[[list[dict]], str | tuple[str, int]], in_flight: int = 4, attempts: int = 3, pause: float = 0.2) -> DataFrame:
    """Adds answer, answer_tokens, model_error and model_attempts.

    Each task has at most ``in_flight`` calls open; answers keep their rows. A
    call is repeated after an error with growing pauses; the last error is kept
    and leaves the answer null. The model returns the answer, or the answer and
    the tokens it used; tokens are estimated as a quarter of the characters.
    """
    def call(messages) -> tuple:
        error = None
        for k in range(attempts):
            try:
                got = model([dict(m) for m in messages])
                text, used = got if isinstance(got, tuple) else (got, -(-len(got) // 4))
                return text, used, None, k + 1
            except Exception as e:  # noqa: BLE001  the row's error
                error = str(e)
                if k + 1 < attempts:
                    time.sleep(pause * 2**k)
        return None, None, error, attempts

    @F.pandas_udf("struct<answer:string,tokens:bigint,error:string,attempts:int>")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(in_flight) as pool:
            for messages in batches:
                out = pd.DataFrame(list(pool.map(call, messages)), columns=["answer", "tokens", "error", "attempts"])
                yield out.astype({"tokens": "Int64", "attempts": "int32"})

    out = prompts.withColumn("_told", ask(F.col("messages")))
    return out.withColumns({"answer": F.col("_told.answer"), "answer_tokens": F.col("_told.tokens"), "model_error": F.col("_told.error"), "model_attempts": F.col("_told.attempts")}).drop("_told")


def validate(answers: DataFrame, answer: str = "answer", context: str = "sources", n: str = "n_sources") -> DataFrame:
    return answers.withColumn("check", citation_check(F.col(answer), F.coalesce(F.col(context), F.lit("")), F.coalesce(F.col(n), F.lit(0))))


def event_stream(results: DataFrame) -> DataFrame:
    """(qid, seq, event, data): sources, tokens and done; abstain and done; or error, in order.

    results (qid, abstained, sources, answer, error).
    """
    pieces = F.filter(F.split("answer", r"(?<=\s)"), lambda p: p != "")

    def ev(name, data):
        return F.struct(F.lit(name).alias("event"), data.alias("data"))

    done = F.array(ev("done", F.lit("")))
    events = F.when(F.col("error").isNotNull(), F.array(ev("error", F.col("error")))).when(
        F.col("abstained"), F.concat(F.array(ev("abstain", F.lit(""))), done)).otherwise(
        F.concat(F.array(ev("sources", F.coalesce("sources", F.lit("")))), F.transform(pieces, lambda p: ev("token", p)), done))
    return results.select("qid", F.posexplode(events).alias("seq", "e")).select("qid", "seq", "e.event", "e.data")
