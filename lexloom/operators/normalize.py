"""Raw documents to normalized documents with segments.

Judgments are cut by column expressions; HTML and statutes go through
``mapInPandas`` with the parsers of ``html`` and ``acts``.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T
from ..sources.workspace import short_batches
from . import acts
from .html import html_to_text

#: Headings that open the ruling and the reasons.
RULINGS = ["WYROK", "POSTANOWIENIE", "UCHWAŁA", "ZARZĄDZENIE"]
REASONS = "UZASADNIENIE"
#: Form lines that carry no content.
FORM_PREFIXES = ["Zwięźle o powodach", "STANOWISKO SĄDU ODWOŁAWCZEGO"]
FORM_FILLER = "Nie dotyczy"
#: Rows that a task sorts, about.
TASK_ROWS = 500_000


def with_plain_text(df: DataFrame, html_col: str, out_col: str = "plain_text", errors: str | None = None) -> DataFrame:
    """Adds the text of an HTML column; with ``errors``, what a page raised, as a column instead of the job's end."""
    short_batches(df.sparkSession)

    @F.pandas_udf("struct<text:string,error:string>")
    def convert(html: pd.Series) -> pd.DataFrame:
        rows = []
        for h in html:
            try:
                rows.append((html_to_text(h), None))
            except Exception as e:  # noqa: BLE001  the page's error is its row's
                if errors is None:
                    raise
                rows.append((None, str(e)))
        return pd.DataFrame(rows, columns=["text", "error"])

    out = df.withColumn("_page", convert(F.col(html_col))).withColumn(out_col, F.col("_page.text"))
    return (out if errors is None else out.withColumn(errors, F.col("_page.error"))).drop("_page")


def strip_form(text: Column) -> Column:
    """Drops check-box lines, fixed labels and fillers; at most one blank line in a row."""
    def keep(line: Column) -> Column:
        t = F.lower(T.strip(line))
        out = ~F.regexp_like(line, F.lit(r"(?U)^\s*[☐☒]")) & (t != FORM_FILLER.lower())
        for p in FORM_PREFIXES:
            out = out & ~F.startswith(t, F.lit(p.lower()))
        return out

    kept = F.array_join(F.filter(F.split(text, "\n"), keep), "\n")
    return T.strip(F.regexp_replace(kept, "\n{3,}", "\n\n"))


def judgment_sections(text: Column) -> Column:
    """Array of (label, char_start, text): head, ruling and reasons, else the whole document.

    If the reasons come before the ruling, the ruling runs to the end; if there
    is no ruling, what precedes the reasons is dropped.
    """
    def at(word):
        p = F.locate(word, text)
        return F.when(p > 0, p - 1)

    ruling, reasons, end = F.least(*[at(w) for w in RULINGS]), at(REASONS), F.length(text)
    ruling_end = F.when(reasons > ruling, reasons).otherwise(end)

    def part(label, start, stop):
        body = T.strip(F.substr(text, start + 1, stop - start))
        body = strip_form(body) if label == "uzasadnienie" else body
        return F.when((stop > start) & (F.length(body) > 0), F.struct(F.lit(label).alias("label"), start.cast("int").alias("char_start"), body.alias("text")))

    none = ruling.isNull() & reasons.isNull()
    parts = F.array(
        F.when(none, part("document", F.lit(0), end)), F.when(ruling > 0, part("komparycja", F.lit(0), ruling)),
        F.when(ruling.isNotNull(), part("sentencja", ruling, ruling_end)), F.when(reasons.isNotNull(), part("uzasadnienie", reasons, end)))
    return F.array_compact(parts)


PAYLOAD = """struct<courtType:string, judgmentType:string, judgmentDate:string, courtCases:array<struct<caseNumber:string>>,
  division:struct<name:string, court:struct<name:string>>, judges:array<struct<name:string>>, keywords:array<string>,
  referencedRegulations:array<struct<journalTitle:string, journalYear:int, journalNo:int, journalEntry:int, text:string>>>"""


def normalize_judgments(raw: DataFrame, today: Column | None = None) -> DataFrame:
    """raw (source, external_id, raw_content, payload JSON, source_url) to documents with sections; ``error``: what the parser raised."""
    today = F.current_date() if today is None else today
    df = with_plain_text(raw, "raw_content", errors="error").withColumn("p", F.from_json("payload", PAYLOAD))
    df = df.withColumn("d", T.judgment_date(F.col("p.judgmentDate"), F.col("plain_text"), today))
    case, court = F.try_element_at("p.courtCases", F.lit(1))["caseNumber"], F.col("p.division.court.name")
    names = F.filter(F.transform(F.coalesce("p.judges", F.array().cast("array<struct<name:string>>")), lambda j: j["name"]), lambda n: F.length(T.strip(n)) > 0)
    return df.select(
        "source", "external_id", F.lit("judgment").alias("doc_type"), T.title_of(F.col("p.judgmentType"), court, case).alias("title"), "source_url",
        T.content_hash(F.col("raw_content")).alias("content_hash"), F.col("p.courtType").alias("court_type"), F.col("d.date").alias("judgment_date"),
        F.lit(None).cast("boolean").alias("in_force"), F.col("d.issues").alias("quality_issues"), "plain_text",
        F.to_json(F.struct(case.alias("caseNumber"), court.alias("court"), F.col("p.division.name").alias("division"), F.col("p.judgmentType"),
                           names.alias("judges"), F.col("p.keywords"), F.col("p.referencedRegulations"))).alias("typed_metadata"),
        judgment_sections(F.col("plain_text")).alias("segments"), "error")


ACT_PAYLOAD = """struct<title:string, displayAddress:string, type:string, status:string, inForce:string, changeDate:string,
  keywords:array<string>, keywordsNames:array<string>, references:map<string, array<struct<id:string, date:string>>>>"""
#: Reference lists in an act's metadata.
CONSOLIDATED, AMENDING = "Inf. o tekście jednolitym", "Akty zmieniające"


def newest_consolidated(references: Column) -> Column:
    """Id of the newest consolidated text by (year, position)."""
    ids = F.filter(F.transform(F.coalesce(F.try_element_at(references, F.lit(CONSOLIDATED)), F.array().cast("array<struct<id:string,date:string>>")),
                               lambda r: F.struct(T.eli_key(F.concat(F.lit("x/"), r["id"])).alias("key"), r["id"].alias("id"))), lambda r: r["key"].isNotNull())
    return F.array_max(ids)["id"]


def unabsorbed_amendments(references: Column, consolidated: Column) -> Column:
    """Amending acts after the consolidated text: array of (eli_id, effective_date)."""
    base = T.eli_key(F.concat(F.lit("x/"), consolidated))
    rows = F.coalesce(F.try_element_at(references, F.lit(AMENDING)), F.array().cast("array<struct<id:string,date:string>>"))
    # the key as a variable of a lambda: inside the filter it would be found anew, over all references, for each row
    later = F.element_at(F.transform(F.array(base), lambda b: F.filter(rows, lambda r: T.eli_key(F.concat(F.lit("x/"), r["id"])) > b)), 1)
    return F.transform(later, lambda r: F.struct(r["id"].alias("eli_id"), r["date"].alias("effective_date")))


def with_act_segments(df: DataFrame, content_col: str, format_col: str, title_col: str) -> DataFrame:
    """Adds ``segments``, ``segment_issues`` and ``error`` (what the parser raised) from HTML or flat PDF text."""
    schema = f"struct<segments:array<{acts.SEGMENT}>,issues:array<string>,error:string>"

    short_batches(df.sparkSession)

    @F.pandas_udf(schema)
    def cut(content: pd.Series, kind: pd.Series, title: pd.Series) -> pd.DataFrame:
        out = []
        for c, k, t in zip(content, kind, title, strict=True):
            try:
                rows, issues = acts.mark_variants(acts.act_text_segments(c, t) if k == "pdf-text" else acts.act_html_segments(c, t))
            except Exception as e:  # noqa: BLE001  the document's error is its row's
                out.append(([], [], str(e)))
                continue
            if not rows:
                issues = ["Nie znaleziono jednostek (Art./§) w tekście PDF — sprawdź ekstrakcję/strukturę." if k == "pdf-text"
                          else "Nie znaleziono artykułów (div.unit_arti) — sprawdź strukturę text.html.", *issues]
            out.append((rows, issues, None))
        return pd.DataFrame(out, columns=["segments", "issues", "error"])

    return df.withColumn("cut", cut(F.col(content_col), F.col(format_col), F.col(title_col))).withColumns(
        {"segments": F.col("cut.segments"), "segment_issues": F.col("cut.issues"), "error": F.col("cut.error")}).drop("cut")


def normalize_acts(raw: DataFrame) -> DataFrame:
    """raw (source, external_id, raw_content, content_format, payload JSON, source_url) to documents with units."""
    df = raw.withColumn("p", F.from_json("payload", ACT_PAYLOAD)).withColumn("title", F.coalesce("p.title", "external_id"))
    df = with_act_segments(df.withColumn("short", T.short_title(F.col("title"))), "raw_content", "content_format", "short")
    df = df.withColumn("consolidated", newest_consolidated(F.col("p.references")))
    keywords = F.when(F.size(F.coalesce("p.keywordsNames", F.array().cast("array<string>"))) > 0, F.col("p.keywordsNames")).otherwise(F.col("p.keywords"))
    flag = F.try_variant_get(F.try_parse_json("payload"), "$.inForce", "variant")
    force = T.in_force(F.col("p.inForce"), F.schema_of_variant(flag))
    meta = F.struct(
        F.col("p.type").alias("actType"), F.col("p.status"), force.alias("inForce"), F.col("external_id").alias("eliId"), F.col("p.displayAddress"),
        "title", F.col("p.changeDate"), F.col("consolidated").alias("consolidatedTextId"),
        unabsorbed_amendments(F.col("p.references"), F.col("consolidated")).alias("unabsorbedAmendments"), keywords.alias("keywords"))
    return df.select(
        "source", "external_id", F.lit("act").alias("doc_type"), "title", "source_url", T.content_hash(F.col("raw_content")).alias("content_hash"),
        F.lit(None).cast("string").alias("court_type"), F.lit(None).cast("date").alias("judgment_date"), force.alias("in_force"),
        F.col("segment_issues").alias("quality_issues"), F.array_join(F.col("segments.text"), "\n\n").alias("plain_text"),
        F.to_json(meta).alias("typed_metadata"), "segments", "error")


def mark_duplicate_units(units: DataFrame, doc: str = "doc_id", order: str = "pos", task_rows: int = TASK_ROWS) -> DataFrame:
    """Relational form of the variant marks: adds ``variant`` (null for unique units).

    A task sorts about ``task_rows`` rows, whatever the size of the table.
    """
    tasks = max(int(units.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-units.count() // task_rows))
    # by a hash of the unit: constant columns among the keys would bring a second exchange
    units = units.withColumn("_unit", F.xxhash64(doc, "article", "paragraph", "point")).repartition(tasks, "_unit")
    key = W.partitionBy("_unit", doc, "article", "paragraph", "point")
    n = F.count("*").over(key)
    return units.withColumn("variant", F.when((n > 1) & F.col("article").isNotNull(), F.format_string(
        " (wariant %d/%d)", F.row_number().over(key.orderBy(order)), n))).drop("_unit")


def quality_report(docs: DataFrame, by: str = "source") -> DataFrame:
    """Documents, empty ones, ones with issues, segments and their mean length, per source."""
    lengths = F.aggregate("segments", F.lit(0).cast("long"), lambda a, s: a + F.length(s["text"]))
    return docs.groupBy(by).agg(
        F.count("*").alias("docs"), F.count_if(F.size("segments") == 0).alias("empty"), F.count_if(F.size("quality_issues") > 0).alias("with_issues"),
        F.sum(F.size("segments")).alias("segments"), F.try_divide(F.sum(lengths), F.sum(F.size("segments"))).alias("mean_segment_length"))
