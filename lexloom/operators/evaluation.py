"""Scores of retrieval and answers against labelled question sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import answer_letter, collapse, same_unit
from .retrieval import STRUCTURAL_SCORE

#: Categories whose questions the corpus answers.
ANSWERABLE = ["InCorpus", "Freshness"]


def grid(lo: float = 0.30, hi: float = 0.90, step: float = 0.05) -> list[float]:
    """Thresholds by repeated addition, so ties fall as they do in sequence."""
    out, t = [], lo
    while t <= hi + 1e-9:
        out.append(t)
        t += step
    return out


def same_ci(a: Column, b: Column) -> Column:
    return F.coalesce(F.lower(a) == F.lower(b), F.lit(False))


def locator_matches(item: str, row: str) -> Column:
    """An expected case number decides alone; else id and article, either a wildcard if missing."""
    def want(n):
        return F.col(f"{item}.{n}")

    def have(n):
        return F.col(f"{row}.{n}")

    case = F.coalesce(F.lower(collapse(want("expected_case"))) == F.lower(collapse(have("case_number"))), F.lit(False))
    eli = want("expected_eli").isNull() | same_ci(want("expected_eli"), have("eli"))
    article = want("expected_article").isNull() | same_ci(want("expected_article"), have("article"))
    return F.when(want("expected_case").isNotNull(), case).otherwise(eli & article)


def score_items(items: DataFrame, observations: DataFrame, retrieved: DataFrame) -> DataFrame:
    """One verdict row per item; measures that do not apply are null.

    items (id, category, should_abstain, needs_lawyer, expected_*); observations
    (id, max_similarity, would_abstain, citations_clean, abstained); retrieved
    (id, eli, article, case_number).
    """
    found = items.alias("i").join(retrieved.alias("r"), "id").groupBy("id").agg(
        F.max(locator_matches("i", "r")).alias("found"), F.max(same_ci(F.col("i.expected_amendment"), F.col("r.eli"))).alias("fresh"))
    df = items.join(observations, "id").join(found, "id", "left")
    expected = F.coalesce("expected_eli", "expected_article", "expected_case").isNotNull()
    hit = F.when(~F.col("should_abstain") & ~F.col("needs_lawyer") & expected, F.coalesce("found", F.lit(False)))
    answered = F.col("citations_clean").isNotNull() | F.col("abstained").isNotNull()
    trap = F.when((F.col("category") == "Trap") & answered, F.coalesce("abstained", F.lit(False)) | F.coalesce("citations_clean", F.lit(False)))
    chat = F.when(~F.col("needs_lawyer") & F.col("abstained").isNotNull(), F.col("abstained") == F.col("should_abstain"))
    fresh = F.when((F.col("category") == "Freshness") & F.col("expected_amendment").isNotNull(), F.coalesce("fresh", F.lit(False)))
    return df.select("id", "category", "should_abstain", "max_similarity", hit.alias("hit"), (F.col("would_abstain") == F.col("should_abstain")).alias("abstention_ok"),
                     trap.alias("no_hallucination"), chat.alias("chat_ok"), fresh.alias("fresh_hit"))


def report(verdicts: DataFrame, threshold: float) -> DataFrame:
    """One row. Ratios without a denominator are null; abstention accuracy and mean similarities are then 0."""
    def share(c):
        return F.avg(F.col(c).cast("double"))

    known = F.col("category").isin(ANSWERABLE)
    return verdicts.agg(
        F.count("*").alias("total"), F.lit(threshold).alias("threshold"), share("hit").alias("recall_at_k"),
        F.coalesce(share("abstention_ok"), F.lit(0.0)).alias("abstention_accuracy"), share("no_hallucination").alias("anti_hallucination"),
        share("chat_ok").alias("chat_abstention_accuracy"), share("fresh_hit").alias("freshness_recall"),
        F.coalesce(F.avg(F.when(known, F.col("max_similarity"))), F.lit(0.0)).alias("mean_sim_in"),
        F.coalesce(F.avg(F.when(~known, F.col("max_similarity"))), F.lit(0.0)).alias("mean_sim_out"),
        F.count("hit").alias("scored_recall"), F.count("no_hallucination").alias("scored_traps"), F.count("chat_ok").alias("scored_chat"),
        F.count("fresh_hit").alias("scored_freshness"))


def best_threshold(points: DataFrame, lo: float = 0.30, hi: float = 0.90, step: float = 0.05) -> DataFrame:
    """(threshold, accuracy) of "abstain if similarity < t"; the first best t wins.

    One pass: all thresholds are conditional counts of the same aggregate.
    """
    ts = grid(lo, hi, step)
    right = [F.count_if((F.col("max_similarity") < t) == F.col("should_abstain")).alias(f"t{i}") for i, t in enumerate(ts)]
    counts = points.agg(F.count("*").alias("n"), *right)
    options = F.array(*[F.struct(F.coalesce(F.try_divide(F.col(f"t{i}"), F.col("n")), F.lit(0.0)).alias("accuracy"), F.lit(-i).alias("first"), F.lit(round(t, 2)).alias("threshold"))
                        for i, t in enumerate(ts)])
    return counts.select(F.array_max(options).alias("b")).select("b.threshold", "b.accuracy")


def similarity_diagnostics(points: DataFrame, digits: int = 4) -> DataFrame:
    """Per category: n, mean, min, max and distinct rounded similarities.

    Rounded as SQL rounds doubles: the scaled double, not its decimal digits, decides ties.
    """
    rounded = F.round(F.col("max_similarity") * 10.0**digits) / 10.0**digits
    return points.groupBy("category").agg(
        F.count("*").alias("n"), F.avg("max_similarity").alias("mean"), F.min("max_similarity").alias("min"), F.max("max_similarity").alias("max"),
        F.countDistinct(rounded).alias("distinct_values"))


def separable(points: DataFrame) -> DataFrame:
    """Whether the least similarity of answerable questions exceeds the greatest of the others."""
    known = F.col("category").isin(ANSWERABLE)
    return points.agg(F.min(F.when(known, F.col("max_similarity"))).alias("min_in"), F.max(F.when(~known, F.col("max_similarity"))).alias("max_out")).withColumn(
        "separable", F.coalesce(F.col("min_in") > F.col("max_out"), F.lit(False)))


def exam_answers(answers: DataFrame) -> DataFrame:
    """Adds letter and correct to (nr, mode, answer, key)."""
    return answers.withColumn("letter", answer_letter(F.col("answer"))).withColumn("correct", F.coalesce(F.col("letter") == F.col("key"), F.lit(False)))


def mode_accuracy(answers: DataFrame) -> DataFrame:
    return answers.groupBy("mode").agg(F.count("*").alias("n"), F.count_if("correct").alias("right"), F.avg(F.col("correct").cast("double")).alias("accuracy"),
                                       F.count_if(F.col("letter").isNull()).alias("unanswered"))


def group_accuracy(answers: DataFrame, by: str) -> DataFrame:
    return answers.groupBy(by).agg(F.count("*").alias("n"), F.avg(F.col("correct").cast("double")).alias("accuracy")).orderBy(F.desc("n"), F.asc(by))


def letter_distribution(answers: DataFrame) -> DataFrame:
    """Per mode and for the key: how often each letter was given."""
    given = answers.select("mode", "letter").unionByName(answers.select(F.lit("key").alias("mode"), F.col("key").alias("letter")))
    return given.groupBy("mode").pivot("letter", ["A", "B", "C"]).agg(F.count(F.lit(1))).fillna(0, ["A", "B", "C"])


def basis_path(rows: DataFrame, article: str = "article", tie: str | None = None) -> DataFrame:
    """(nr, hit, path) of the first retrieved row on the expected article: structural, dense or lexical.

    ``tie``: a column that orders rows of equal rank.
    """
    ok = F.col("nr").isNotNull() & same_unit(F.col("row_article"), F.col(article))
    path = F.when(F.col("score") == STRUCTURAL_SCORE, "structural").when(F.col("sim").isNotNull(), "dense").otherwise("lexical")
    first = F.min_by(path, F.when(ok, F.struct("rank", *([tie] if tie else []))))
    return rows.groupBy("nr").agg(first.alias("path")).select("nr", F.col("path").isNotNull().alias("hit"), "path")


def oracle_chunks(keys: DataFrame, chunks: DataFrame, limit: int = 8) -> DataFrame:
    """(nr, id, text) of the exact article of the answer key; rows carry no locator."""
    hits = chunks.join(keys.select("nr", "external_id", "article"), "external_id").where(same_unit(F.col("article_no"), F.col("article")))
    hits = hits.withColumn("_n", F.row_number().over(W.partitionBy("nr").orderBy("chunk_index", "id"))).where(F.col("_n") <= limit)
    return hits.select("nr", "id", "text")
