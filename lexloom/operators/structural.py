"""Lookup of cited units and handling of follow-up questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.citations import ALIASES, canonical_title, citations
from ..functions.text import trigrams
from .retrieval import small_side

CITED = 4
PER_UNIT = 20
LEAST_SIMILARITY = 0.15


def cited_units(queries: DataFrame, text: str = "question", limit: int = CITED) -> DataFrame:
    """(qid, n, article, paragraph, act_hint): the first cited units of each question."""
    return queries.select("qid", F.posexplode(F.slice(citations(F.col(text)), 1, limit)).alias("n", "c")).select("qid", "n", "c.*")


def ordered_grams(text: Column) -> Column:
    """Trigrams in the order of their hashes, which is the same for every text."""
    return F.transform(F.array_sort(F.transform(trigrams(text), lambda g: F.struct(F.xxhash64(g).alias("h"), g.alias("g")))), lambda x: x["g"])


def prefix_length(size: Column, least: float) -> Column:
    """How many of a set's first elements must hold one of every set of Jaccard similarity ``least`` or more."""
    return F.greatest(size - F.ceil(size * F.lit(least)) + 1, F.lit(0)).cast("int")


def similar_titles(hints: DataFrame, acts: DataFrame, least: float = LEAST_SIMILARITY, digits: int = 9, n_hints: int | None = None) -> DataFrame:
    """(hint, external_id, s): all pairs of trigram similarity ``least`` or more, by a prefix-filtered join.

    hints (hint), acts (external_id, title). Two sets that similar share one of
    their first trigrams in a common order, and their sizes differ by a factor of
    1 / ``least`` at most; only such pairs are compared.
    """
    low = least - 10.0 ** -digits
    grams = lambda df, col, *keep: df.select(*keep, ordered_grams(F.col(col)).alias("g")).select(*keep, "g", F.size("g").alias("n"))
    first = lambda df: df.withColumn("first", F.explode(F.slice("g", 1, prefix_length(F.col("n"), low))))
    h = first(grams(hints.select("hint").distinct(), "hint", "hint")).withColumnsRenamed({"g": "hg", "n": "hn"})
    pairs = first(grams(acts, "title", "external_id")).join(small_side(h, n_hints), "first").where((F.col("n") >= F.col("hn") * low) & (F.col("hn") >= F.col("n") * low))
    shared = F.size(F.array_intersect("g", "hg"))
    scored = pairs.withColumn("s", F.round(shared / (F.col("n") + F.col("hn") - shared), digits)).where(F.col("s") >= least)
    return scored.groupBy("hint", "external_id").agg(F.max("s").alias("s"))


def resolve_acts(hints: DataFrame, acts: DataFrame, n_hints: int | None = None) -> DataFrame:
    """(hint, external_id): hints (hint), acts (external_id, title).

    A known abbreviation takes the shortest title that holds its canonical
    name; any other hint the title of greatest trigram similarity, if that is
    enough. Titles are looked through for the fixed canonical names once, and the
    names they hold are joined; hints are broadcast only for a stated batch.
    """
    h = hints.select("hint").where("hint IS NOT NULL").distinct().withColumn("name", canonical_title(F.col("hint")))
    names = F.filter(F.array(*[F.lit(n) for n in sorted(set(ALIASES.values()))]), lambda n: F.contains(F.lower("title"), F.lower(n)))
    named = acts.select("external_id", "title", F.explode(names).alias("name"))
    best = named.groupBy("name").agg(F.min_by("external_id", F.struct(F.length("title"), "external_id")).alias("external_id"))
    known = h.where("name IS NOT NULL").join(best, "name").select("hint", "external_id")
    fuzzy = similar_titles(h.where("name IS NULL"), acts, n_hints=n_hints).groupBy("hint").agg(F.min_by("external_id", F.struct(-F.col("s"), "external_id")).alias("external_id"))
    return known.unionByName(fuzzy)


def structural_lookup(cited: DataFrame, resolved: DataFrame, chunks: DataFrame, per_unit: int = PER_UNIT) -> DataFrame:
    """(qid, id, pos) of chunks of cited units, whatever filters the search has.

    chunks (id, external_id, article_no, chunk_index); article numbers are
    compared with case.
    """
    wanted = cited.join(resolved, cited["act_hint"] == resolved["hint"]).select("qid", "n", "external_id", F.col("article").alias("article_no"))
    hits = chunks.select("id", "external_id", "article_no", "chunk_index").join(wanted, ["external_id", "article_no"])
    own = W.partitionBy("qid", "n").orderBy("chunk_index", "id")
    hits = hits.withColumn("r", F.row_number().over(own)).where(F.col("r") <= per_unit)
    return hits.select("qid", "id", F.row_number().over(W.partitionBy("qid").orderBy("n", "r")).alias("pos"))


def followup_text(turns: DataFrame, key: str = "conv_id", order: str = "turn", text: str = "text", previous: int = 2) -> DataFrame:
    """Adds ``contextual``: the last non-blank earlier questions and the question, joined by blanks."""
    w = W.partitionBy(key).orderBy(order)
    asked = turns.where(F.length(F.trim(text)) > 0)
    parts = [F.lag(text, i).over(w) for i in range(previous, 0, -1)]
    return asked.withColumn("contextual", F.concat_ws(" ", *parts, F.col(text)))


def pick_contextual(raw: Column, contextual: Column, margin: float = 0.02) -> Column:
    """Whether the contextual variant is used."""
    return raw <= contextual + margin
