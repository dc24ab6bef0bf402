"""The registered queries of this subpackage and their SQL.

Each query applies its operator to the whole table and derives digest columns
from the operator's outputs. Tokenizer files are those of ``public_tokenizers``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .paragraph_dedup import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents")).where("passage").select(
        F.col("id").alias("doc_id"), "line", "start", "length", "words", "run_words", "whole", "cluster", "cluster_size", F.col("keep_id").alias("keep_doc_id"), "removed")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, fold, scored, threshold

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return scored(docs, model, "score").select(
        "doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
        threshold(model, F.col("lang")).alias("threshold"), (F.col("score") >= threshold(model, F.col("lang"))).alias("rejected"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import place, tokenize_pieces

    pieces = tokenize_pieces(table(spark, sf_dir, "documents"), tokenizer_file(), 1024, 2)
    digested = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return place(digested, 1024).select(
        F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_contamination

    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat_format import format_windows, read_loss, read_turns

    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    windows = format_windows(turns)
    own = F.filter(read_turns(F.col("text")), lambda t, i: i >= F.col("repeated"))
    read = windows.select(
        "conv_id", "first_turn", F.length("text").cast("long").alias("chars"), F.size(own).cast("long").alias("n"),
        F.array_join(F.transform(own, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("turns"),
        read_loss(F.col("text"), F.col("loss")).alias("loss"))
    joined = read.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.array_sort(F.collect_list(F.struct("first_turn", "turns", "loss"))).alias("w"))
    loss = F.array_join(F.col("w.loss"), "")
    return joined.select(
        "conv_id", "n_turns", F.sha2(F.array_join(F.col("w.turns"), ""), 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_mixing import score_texts

    return score_texts(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_count import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_file()).select(
        F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_duplicates

    return exact_duplicates(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


#: Rules of the registered url query: (host, path, verdict).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import filter_urls

    return filter_urls(table(spark, sf_dir, "pages"), RULES, "allow").select(
        F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


def op11_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .blob_ledger import BASE, RULES, findings, update
    from .common import fresh_path

    docs, ledger = table(spark, sf_dir, "documents").select("doc_id", "text"), fresh_path(spark, "ledger")
    update(docs, RULES, ledger)
    found = findings(docs, RULES, ledger)
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    digest = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(r.kind) for r in BASE], F.sha2(digest(base), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .filter_audit import filter_audit

    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def micros(ts: str, kind: str):
    """Microseconds of a time with or without a zone."""
    if kind == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})")
    return F.unix_micros(ts)


def op13_row_pattern_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .row_patterns import match_rows

    clicks = table(spark, sf_dir, "clicks")
    cents = F.when(F.abs("value") < 9e16, F.floor(F.col("value") * 100 + 0.5))
    return match_rows(
        clicks, F.col("client_id"), micros("ts", dict(clicks.dtypes)["ts"]), F.col("click_id"), cents, F.col("kind") != "error", F.col("kind") == "purchase",
    ).select(F.col("key").alias("client_id"), F.col("match_no").cast("long").alias("match_no"), "first_id", "last_id", "n_rows", "sum_cents", "labels_sha256")


QUERIES = {
    f.__name__: f
    for f in (op1_substring_dedup, op2_toxicity, op3_best_fit_packing, op4_benchmark_decontamination, op5_chat_formatting,
              op6_simhash_near_dedup, op7_lm_scoring, op8_token_counts, op9_exact_dedup, op10_url_filters,
              op11_secret_scans, op12_filter_audit, op13_row_pattern_matching)
}

def _secrets_sql() -> str:
    """Spans from the texts between matches: a match starts after all texts and matches before it."""
    from .blob_ledger import BASE, RULES, spelled

    found = []
    for rank, r in enumerate(RULES):
        pattern = spelled(r).replace("'", "''")
        found.append(f"""
          SELECT rn, {rank} AS rank, '{r.kind}' AS kind, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {r.group}) AS g, regexp_split_to_array(t, '{pattern}') AS s, {r.least} AS least FROM d""")
    digest = "string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, rank)"
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in BASE)
    return f"""
        WITH d AS (SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS t FROM documents),
             f AS ({" UNION ALL ".join(found)}),
             i AS (SELECT rn, rank, kind, least, m, g, s, unnest(range(1, len(m) + 1)) AS i FROM f),
             p AS (SELECT rn, rank, kind, (list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS a, length(m[i]) AS n
                   FROM i WHERE length(g[i]) >= least),
             x AS (SELECT rn, rank, kind, a, a + n AS z FROM p),
             b AS (SELECT rn, {counts}, {digest} FILTER (WHERE rank < {len(BASE)}) AS base, {digest} AS spans FROM x GROUP BY rn)
        SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM d LEFT JOIN b USING (rn)
    """


#: All orders of five filters; bits of the filter and of those before it.
_AUDIT_SQL = """
    WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS lo FROM documents),
         l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
         w AS (SELECT doc_id, part, t, lo, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
         m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
                 (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 2 * length(t))::INT
                 + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > lo, false)::INT AS mask
               FROM w LEFT JOIN l USING (doc_id)),
         c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
         k(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
         o AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM k a, k b, k c, k d, k e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
         s AS (SELECT o, s, substr(o, s, 1) AS letter, 1 << (ascii(substr(o, s, 1)) - 65) AS bit,
                 list_sum(list_transform(range(1, 6), lambda j: CASE WHEN j < s THEN 1 << (ascii(substr(o, j, 1)) - 65) ELSE 0 END))::INT AS before
               FROM o, (SELECT unnest(range(1, 6))::INT AS s)),
         r AS (SELECT part, o, s, letter,
                 coalesce(sum(n) FILTER (WHERE mask & (before | bit) = 0), 0) AS kept, coalesce(sum(n) FILTER (WHERE mask & before = 0 AND mask & bit <> 0), 0) AS removed,
                 coalesce(sum(n) FILTER (WHERE mask & before <> 0 AND mask & bit <> 0), 0) AS redundant, coalesce(sum(n) FILTER (WHERE mask = bit), 0) AS unique_fails,
                 coalesce(sum(good) FILTER (WHERE mask & before = 0 AND mask & bit <> 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (WHERE mask & before = 0 AND mask & bit <> 0), 0) AS toxic_lost
               FROM c, s GROUP BY part, o, s, letter)
    SELECT part, o AS filter_order, s AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
           good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
    FROM r
"""

#: A match stays in its segment, a run of rows that D, U or P can reach; its end is the first P above A that D and U lead to.
_PATTERN_SQL = """
    WITH RECURSIVE c AS (SELECT DISTINCT * FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL),
         o AS (SELECT client_id, click_id, kind, ts, CASE WHEN abs(value) < 9e16 THEN floor(100 * value + 0.5)::BIGINT END AS cents,
                 row_number() OVER (PARTITION BY client_id ORDER BY ts, click_id) AS n FROM c),
         f AS (SELECT *, lag(cents) OVER w AS before, coalesce(cents IS NOT NULL AND lag(cents) OVER w IS NOT NULL AND ts - lag(ts) OVER w <= INTERVAL 10 MINUTE, false) AS near
               FROM o WINDOW w AS (PARTITION BY client_id ORDER BY n)),
         g AS (SELECT *, near AND coalesce(kind = 'purchase', false) AS p, near AND coalesce(kind <> 'error', false) AND cents <> before AS du FROM f),
         s AS (SELECT *, sum((NOT (p OR du))::INT) OVER w AS seg, sum((NOT du)::INT) OVER w AS stops FROM g WINDOW w AS (PARTITION BY client_id ORDER BY n)),
         e AS (SELECT a.client_id, a.seg, a.n AS a, min(b.n) AS z FROM s a JOIN s b ON a.client_id = b.client_id AND a.seg = b.seg AND b.n > a.n
               WHERE b.p AND b.cents >= a.cents AND b.stops - (NOT b.du)::INT = a.stops GROUP BY a.client_id, a.seg, a.n),
         j AS (SELECT x.client_id, x.seg, x.a, x.z, min(y.a) AS later FROM e x LEFT JOIN e y ON x.client_id = y.client_id AND x.seg = y.seg AND y.a > x.z GROUP BY x.client_id, x.seg, x.a, x.z),
         m AS (SELECT * FROM j WHERE (client_id, seg, a) IN (SELECT client_id, seg, min(a) FROM e GROUP BY client_id, seg)
               UNION ALL SELECT j.* FROM m JOIN j ON m.client_id = j.client_id AND m.seg = j.seg AND m.later = j.a),
         r AS (SELECT m.client_id, m.a, count(*) AS n_rows, sum(cents)::BIGINT AS sum_cents, min_by(click_id, n) AS first_id, max_by(click_id, n) AS last_id,
                 sha256(string_agg(CASE WHEN n = m.a THEN 'A' WHEN n = m.z THEN 'P' WHEN cents < before THEN 'D' ELSE 'U' END, '' ORDER BY n)) AS labels_sha256
               FROM m JOIN s ON m.client_id = s.client_id AND n BETWEEN m.a AND m.z GROUP BY m.client_id, m.a)
    SELECT client_id, row_number() OVER (PARTITION BY client_id ORDER BY a) AS match_no, first_id, last_id, n_rows, sum_cents, labels_sha256 FROM r
"""

SQL = {
    "op9_exact_dedup": """
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
        FROM (SELECT doc_id, coalesce(text, '') AS t,
                     max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
                     count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size
              FROM documents)
    """,
    "op10_url_filters": """
        WITH rules(rule_host, rule_path, rule_verdict) AS (
               VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
             cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
             parts AS (SELECT page_id,
                         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
                       FROM cut)
        SELECT page_id, host, path,
               max_by(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
               coalesce(max_by(rule_verdict, length(rule_host || rule_path)), 'allow') AS verdict
        FROM parts LEFT JOIN rules
          ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
        GROUP BY page_id, host, path
    """,
    "op11_secret_scans": _secrets_sql(),
    "op12_filter_audit": _AUDIT_SQL,
    "op13_row_pattern_matching": _PATTERN_SQL,
}
