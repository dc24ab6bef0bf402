"""Further registered queries: normalization, sources, conversations and evaluation over the given tables.

As in ``catalog``, columns of the given tables stand in for the engine's.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import literal, query  # noqa: F401  literal: for callers of this module
from .functions import text as T
from .operators import conversations, embedding, evaluation, grounding, ingest, normalize
from .operators.retrieval import STRUCTURAL_SCORE
from .sources import api, stores
from .sources.workspace import shared_folder

#: A judgment's text by its number modulo five: no heading; ruling after a head; ruling and reasons with form lines; reasons alone; reasons before the ruling.
JUDGMENT_SQL = """CASE doc_id % 5 WHEN 0 THEN coalesce(text, '') WHEN 1 THEN 'Sygn. akt ' || doc_id || chr(10) || 'WYROK' || chr(10) || coalesce(text, '')
    WHEN 2 THEN 'POSTANOWIENIE ' || doc_id || ' UZASADNIENIE' || chr(10) || ' ☐ pole' || chr(10) || 'Nie dotyczy ' || chr(10) || chr(10) || chr(10) || coalesce(text, '')
    WHEN 3 THEN 'UZASADNIENIE' || coalesce(text, '') ELSE 'A UZASADNIENIE b UCHWAŁA c ' || doc_id END"""


@query(f"""WITH d AS (SELECT doc_id, {JUDGMENT_SQL} AS t FROM documents),
  w AS (SELECT *, nullif(least(coalesce(nullif(strpos(t, 'WYROK'), 0), 1000000000), coalesce(nullif(strpos(t, 'POSTANOWIENIE'), 0), 1000000000),
      coalesce(nullif(strpos(t, 'UCHWAŁA'), 0), 1000000000), coalesce(nullif(strpos(t, 'ZARZĄDZENIE'), 0), 1000000000)), 1000000000) - 1 AS a, nullif(strpos(t, 'UZASADNIENIE'), 0) - 1 AS r, length(t) AS n FROM d),
  p AS (SELECT doc_id, 0 AS o, 'document' AS label, 0 AS x, n AS y, t FROM w WHERE a IS NULL AND r IS NULL
    UNION ALL SELECT doc_id, 1, 'komparycja', 0, a, t FROM w WHERE a > 0
    UNION ALL SELECT doc_id, 2, 'sentencja', a, CASE WHEN r > a THEN r ELSE n END, t FROM w WHERE a IS NOT NULL
    UNION ALL SELECT doc_id, 3, 'uzasadnienie', r, n, t FROM w WHERE r IS NOT NULL),
  s AS (SELECT doc_id, o, label, x, trim(regexp_replace(substr(t, x + 1, y - x), '^\\s+|\\s+$', '', 'g')) AS body FROM p),
  f AS (SELECT doc_id, o, label, x, CASE WHEN label <> 'uzasadnienie' THEN body ELSE regexp_replace(regexp_replace(array_to_string(list_filter(string_split(body, chr(10)),
      lambda l: NOT regexp_matches(l, '^\\s*[☐☒]') AND lower(trim(l)) <> 'nie dotyczy'), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') END AS body FROM s)
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY o) - 1 AS k, label, x::BIGINT AS char_start, sha256(body) AS text_sha256 FROM f WHERE length(body) > 0""")
def judgment_sections(t, spark):
    d = t("documents").select("doc_id", F.expr(JUDGMENT_SQL.replace("chr(10)", "'\\n'")).alias("t"))
    s = d.select("doc_id", F.posexplode(normalize.judgment_sections(F.col("t"))).alias("k", "s"))
    return s.select("doc_id", "k", "s.label", "s.char_start", F.sha2("s.text", 256).alias("text_sha256"))


MONTHS_SQL = "[" + ", ".join(f"'{m}'" for m in T.MONTHS) + "]"
RAW_DATE = "CASE o_orderkey % 5 WHEN 0 THEN {iso} WHEN 1 THEN '1850-01-01' WHEN 2 THEN 'brak' WHEN 3 THEN '' END"


@query(f"""WITH o AS (SELECT o_orderkey, {RAW_DATE.format(iso="strftime(o_orderdate, '%Y-%m-%d')")} AS raw,
    CASE WHEN o_orderkey % 3 = 0 THEN '' WHEN o_orderkey % 7 = 0 THEN 'dnia 31 lutego 2001 r.' ELSE 'w dniu: dnia  ' || day(o_orderdate) || ' ' || {MONTHS_SQL}[month(o_orderdate)] || ' ' || year(o_orderdate) || ' r.' END AS text, o_orderdate::DATE AS d FROM orders),
  v AS (SELECT *, try_strptime(raw, '%Y-%m-%d')::DATE AS given, CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 7 <> 0 THEN d END AS found FROM o),
  k AS (SELECT *, coalesce(year(given) >= 1990 AND given <= DATE '2026-01-01', false) AS ok, coalesce(year(found) >= 1990 AND found <= DATE '2026-01-01', false) AS fok FROM v)
  SELECT o_orderkey, CASE WHEN ok THEN given WHEN fok THEN found END AS date, CASE WHEN ok THEN 0 ELSE coalesce((length(raw) > 0)::INT, 0) + fok::INT END::BIGINT AS n_issues FROM k""")
def judgment_dates(t, spark):
    o = t("orders").withColumn("d", F.col("o_orderdate").cast("date"))
    written = F.concat(F.lit("w dniu: dnia  "), F.day("d").cast("string"), F.lit(" "), F.element_at(F.array(*map(F.lit, T.MONTHS)), F.month("d")), F.lit(" "), F.year("d").cast("string"), F.lit(" r."))
    text = F.when(F.col("o_orderkey") % 3 == 0, "").when(F.col("o_orderkey") % 7 == 0, "dnia 31 lutego 2001 r.").otherwise(written)
    found = T.judgment_date(F.expr(RAW_DATE.format(iso="date_format(d, 'yyyy-MM-dd')")), text, F.lit("2026-01-01").cast("date"))
    return o.select("o_orderkey", found.alias("j")).select("o_orderkey", "j.date", F.size("j.issues").alias("n_issues"))


TITLE_PARTS = ["CASE WHEN c_custkey % 3 = 0 THEN '  ' ELSE c_mktsegment END", "CASE WHEN c_custkey % 4 <> 0 THEN c_name END", "CASE WHEN c_custkey % 6 <> 0 THEN 'I C ' || c_custkey END"]


@query(f"""SELECT c_custkey, coalesce(nullif(concat_ws(' ', nullif({TITLE_PARTS[0]}, '  '), {TITLE_PARTS[1]}, {TITLE_PARTS[2]}), ''), 'Orzeczenie') AS title FROM customer""")
def judgment_titles(t, spark):
    return t("customer").select("c_custkey", T.title_of(*map(F.expr, TITLE_PARTS)).alias("title"))


ACT_TITLE = """CASE p_partkey % 5 WHEN 0 THEN 'Ustawa z dnia 5 maja 1999 r. o ' || p_name || '.' WHEN 1 THEN 'Obwieszczenie w sprawie ogłoszenia jednolitego tekstu ustawy - ' || p_name
    WHEN 2 THEN p_name || ' - ' || p_brand || '.' WHEN 3 THEN p_name || ' – ' || p_brand ELSE p_name END"""


@query(f"""WITH a AS (SELECT p_partkey, p_partkey % 5 AS k, p_name, p_brand FROM part)
  SELECT p_partkey, CASE k WHEN 0 THEN 'o ' || p_name WHEN 1 THEN p_name WHEN 2 THEN p_brand WHEN 3 THEN p_brand ELSE p_name END AS short FROM a""")
def short_titles(t, spark):
    return t("part").select("p_partkey", T.short_title(F.expr(ACT_TITLE)).alias("short"))


ADDRESS = "CASE o_orderkey % 5 WHEN 0 THEN 'DU/' || {y} || '/' || o_orderkey WHEN 1 THEN 'x/' || {y} WHEN 2 THEN 'a/b/c' WHEN 3 THEN 'https://e/DU/' || {y} || '/' || o_custkey ELSE 'MP/2001/5x' END"


@query(f"""WITH a AS (SELECT o_orderkey, string_split({ADDRESS.format(y="year(o_orderdate)")}, '/') AS p FROM orders),
  k AS (SELECT o_orderkey, len(p) AS n, try_cast(p[-2] AS INT) AS y, try_cast(p[-1] AS INT) AS q FROM a)
  SELECT o_orderkey, CASE WHEN n >= 3 AND q IS NOT NULL THEN y END::BIGINT AS year, CASE WHEN n >= 3 AND y IS NOT NULL THEN q END::BIGINT AS pos FROM k""")
def eli_keys(t, spark):
    return t("orders").select("o_orderkey", T.eli_key(F.expr(ADDRESS.format(y="year(o_orderdate)"))).alias("k")).select("o_orderkey", "k.year", "k.pos")


@query("""SELECT l_orderkey, l_linenumber, lower(regexp_replace(l_returnflag || '. ' || l_linenumber, '[^A-Za-z0-9]', '', 'g')) = lower(regexp_replace(lower(l_linestatus) || l_linenumber, '[^A-Za-z0-9]', '', 'g')) AS same,
    contains(lower(CASE WHEN l_linenumber % 3 = 0 THEN 'Nie MAM wystarczających źródeł, aby' ELSE l_returnflag END), 'nie mam wystarczających źródeł') AS refused FROM lineitem""")
def unit_and_refusal(t, spark):
    number = F.col("l_linenumber").cast("string")
    answer = F.when(F.col("l_linenumber") % 3 == 0, "Nie MAM wystarczających źródeł, aby").otherwise(F.col("l_returnflag"))
    return t("lineitem").select("l_orderkey", "l_linenumber", T.same_unit(F.concat("l_returnflag", F.lit(". "), number), F.concat(F.lower("l_linestatus"), number)).alias("same"), T.is_refusal(answer).alias("refused"))


@query("""WITH i AS (SELECT doc_id AS id, CASE lang WHEN 'en' THEN 'InCorpus' WHEN 'fr' THEN 'Trap' WHEN 'de' THEN 'Freshness' ELSE 'OutOfCorpus' END AS category, lang = 'es' AS sa, doc_id % 11 = 0 AS nl,
      CASE WHEN doc_id % 4 <> 3 THEN 'DU/' || doc_id % 10 END AS ee, CASE WHEN doc_id % 4 = 1 THEN (doc_id % 7)::VARCHAR END AS ea, CASE WHEN doc_id % 9 = 0 THEN 'I C ' || doc_id % 4 END AS ec, 'du/' || doc_id % 5 AS em, doc_id FROM documents),
  r AS (SELECT doc_id AS id, 'du/' || (doc_id + k) % 10 AS eli, (doc_id * k % 7)::VARCHAR AS article, 'i c  ' || (doc_id + k) % 3 AS c FROM documents, (SELECT unnest([1, 2, 10]) AS k)),
  m AS (SELECT i.id, bool_or(CASE WHEN ec IS NOT NULL THEN lower(ec) = lower(regexp_replace(c, '\\s+', ' ', 'g')) ELSE (ee IS NULL OR lower(ee) = lower(eli)) AND (ea IS NULL OR ea = article) END) AS f, bool_or(em = eli) AS fr FROM i JOIN r USING (id) GROUP BY i.id)
  SELECT id, CASE WHEN NOT sa AND NOT nl AND (ee IS NOT NULL OR ea IS NOT NULL OR ec IS NOT NULL) THEN f END AS hit, (doc_id % 2 = 0) = sa AS abstention_ok,
    CASE WHEN category = 'Trap' AND (doc_id % 3 <> 0 OR doc_id % 5 <> 0) THEN coalesce(CASE WHEN doc_id % 5 <> 0 THEN doc_id % 5 = 1 END, false) OR coalesce(CASE WHEN doc_id % 3 <> 0 THEN doc_id % 3 = 1 END, false) END AS no_hallucination,
    CASE WHEN NOT nl AND doc_id % 5 <> 0 THEN (doc_id % 5 = 1) = sa END AS chat_ok, CASE WHEN category = 'Freshness' THEN fr END AS fresh_hit FROM i JOIN m USING (id)""")
def golden_scoring(t, spark):
    d = t("documents").withColumn("id", F.col("doc_id"))
    n, text = F.col("doc_id"), lambda c: c.cast("string")
    items = d.select("id", F.when(F.col("lang") == "en", "InCorpus").when(F.col("lang") == "fr", "Trap").when(F.col("lang") == "de", "Freshness").otherwise("OutOfCorpus").alias("category"),
                     (F.col("lang") == "es").alias("should_abstain"), (n % 11 == 0).alias("needs_lawyer"), F.when(n % 4 != 3, F.concat(F.lit("DU/"), text(n % 10))).alias("expected_eli"),
                     F.when(n % 4 == 1, text(n % 7)).alias("expected_article"), F.when(n % 9 == 0, F.concat(F.lit("I C "), text(n % 4))).alias("expected_case"), F.concat(F.lit("du/"), text(n % 5)).alias("expected_amendment"))
    obs = d.select("id", F.lit(0.5).alias("max_similarity"), (n % 2 == 0).alias("would_abstain"), F.when(n % 3 != 0, n % 3 == 1).alias("citations_clean"), F.when(n % 5 != 0, n % 5 == 1).alias("abstained"))
    got = d.select("id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(10))).alias("k")).select(
        "id", F.concat(F.lit("du/"), text((F.col("id") + F.col("k")) % 10)).alias("eli"), text(F.col("id") * F.col("k") % 7).alias("article"), F.concat(F.lit("i c  "), text((F.col("id") + F.col("k")) % 3)).alias("case_number"))
    return evaluation.score_items(items, obs, got).select("id", "hit", "abstention_ok", "no_hallucination", "chat_ok", "fresh_hit")


@query("""WITH m AS (SELECT conv_id, max(turn) AS last FROM conversations WHERE conv_id % 7 = 3 GROUP BY conv_id)
  SELECT conv_id, last::BIGINT AS last FROM (SELECT *, row_number() OVER (ORDER BY last DESC, conv_id) AS n FROM m) WHERE n <= 50""")
def conversation_feed(t, spark):
    """The fifty conversations of one user with the latest messages."""
    own = t("conversations").groupBy("conv_id").agg(F.max("turn").alias("updated_at")).withColumn("user_id", F.col("conv_id") % 7)
    return conversations.conversation_list(own, 3).select("conv_id", F.col("updated_at").alias("last"))


VERDICT_SQL = "CASE turn % 5 WHEN 0 THEN 'up' WHEN 1 THEN 'down' WHEN 2 THEN 'wrong-answer' WHEN 3 THEN 'needless-refusal' ELSE 'bogus' END"


@query(f"""WITH m AS (SELECT conv_id * 1000 + turn AS message_id, conv_id, turn, conv_id % 7 AS owner FROM conversations),
  f AS (SELECT conv_id * 1000 + turn // 2 AS message_id, CASE WHEN turn % 3 = 0 THEN 99 ELSE conv_id % 7 END AS user_id, {VERDICT_SQL} AS verdict, turn AS created_at FROM conversations)
  SELECT message_id, user_id, arg_max(verdict, (created_at, verdict)) AS verdict FROM f JOIN m USING (message_id) WHERE user_id = owner AND verdict <> 'bogus' GROUP BY message_id, user_id""")
def feedback_guard(t, spark):
    c = t("conversations")
    parents = c.select("conv_id", (F.col("conv_id") % 7).alias("user_id")).distinct()
    messages = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("message_id"), "conv_id")
    feedback = c.select((F.col("conv_id") * 1000 + F.floor(F.col("turn") / 2)).alias("message_id"), F.when(F.col("turn") % 3 == 0, 99).otherwise(F.col("conv_id") % 7).alias("user_id"),
                        F.expr(VERDICT_SQL).alias("verdict"), F.col("turn").alias("created_at"))
    return conversations.accepted_feedback(feedback, messages, parents)


@query("""SELECT doc_id, CASE WHEN contains(text, 'ring') THEN 1.0 ELSE 0.1 END::DOUBLE AS rerank_score FROM documents""")
def rerank_scores(t, spark):
    """All documents as candidates, twenty to a question."""
    c = t("documents").select("doc_id", F.floor(F.col("doc_id") / 20).alias("qid"), F.lit("q").alias("question"), F.coalesce("text", F.lit("")).alias("text"))
    return embedding.rerank(c, embedding.substring_reranker("ring")).select("doc_id", "rerank_score")


@query("""SELECT source, doc_id::VARCHAR AS external_id FROM documents ANTI JOIN labels USING (doc_id)""")
def missing_documents(t, spark):
    listing = t("documents").select("source", F.col("doc_id").cast("string").alias("external_id"))
    stored = t("documents").join(t("labels").select("doc_id"), "doc_id").select("source", F.col("doc_id").cast("string").alias("external_id"))
    return ingest.fetch_missing(listing, stored)


@query("""WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderstatus END AS ct, o_orderpriority AS c, CASE WHEN o_orderkey % 7 = 0 THEN 'junk' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS d FROM orders)
  SELECT o_orderkey FROM o WHERE (ct IS NULL OR lower(ct) = 'f') AND starts_with(lower(c), '1-') AND (try_strptime(d, '%Y-%m-%d') IS NULL OR try_strptime(d, '%Y-%m-%d')::DATE BETWEEN DATE '1995-01-01' AND DATE '2001-01-01')""")
def court_slice(t, spark):
    o = t("orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus")).alias("court_type"), F.col("o_orderpriority").alias("court"),
                           F.when(F.col("o_orderkey") % 7 == 0, "junk").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("judgment_date"))
    return api.in_slice(o, "f", "1-", "1995-01-01", "2001-01-01").select("o_orderkey")


@query("""WITH e AS (SELECT CASE WHEN p_partkey % 9 = 0 THEN ' ' WHEN p_partkey % 2 = 0 THEN 'DU/' || p_size || '/' || p_partkey % 50 ELSE ' du/' || p_size || '/' || p_partkey % 50 END AS eli, p_brand, p_type FROM part),
  k AS (SELECT trim(eli) AS eli FROM e WHERE trim(eli) <> '' AND lower(p_brand) IN ('brand#11', 'brand#12', 'brand#13') UNION ALL SELECT 'MP/1/1')
  SELECT min(eli) AS eli FROM k GROUP BY lower(eli)""")
def discovered_addresses(t, spark):
    number = F.concat(F.col("p_size").cast("string"), F.lit("/"), (F.col("p_partkey") % 50).cast("string"))
    eli = F.when(F.col("p_partkey") % 9 == 0, " ").when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("DU/"), number)).otherwise(F.concat(F.lit(" du/"), number))
    listed = t("part").select(eli.alias("eli"), "p_brand", "p_type")
    return api.act_addresses(listed.where(api.should_include(F.col("eli"), F.col("p_brand"), F.col("p_type"), ["Brand#11", "BRAND#12", "brand#13"], [])), ["MP/1/1"])


@query("""WITH r AS (SELECT l_orderkey AS nr, l_linenumber AS rank, l_returnflag = 'R' AS st, l_linestatus = 'F' AS dn FROM lineitem WHERE l_linenumber = 1 + l_orderkey % 3),
  f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY nr ORDER BY rank) AS n FROM r) WHERE n = 1)
  SELECT k.nr, f.nr IS NOT NULL AS hit, CASE WHEN f.nr IS NULL THEN NULL WHEN st THEN 'structural' WHEN dn THEN 'dense' ELSE 'lexical' END AS path FROM (SELECT DISTINCT l_orderkey AS nr FROM lineitem) k LEFT JOIN f USING (nr)""")
def basis_paths(t, spark):
    """Rows of equal rank keep the order of the table."""
    stored = F.struct("_metadata.file_path", "_metadata.row_index").alias("stored")
    rows = t("lineitem").select(stored, F.col("l_orderkey").alias("nr"), F.col("l_linenumber").alias("rank"), F.concat(F.col("l_linenumber").cast("string"), F.lit(".")).alias("row_article"),
                                (1 + F.col("l_orderkey") % 3).cast("string").alias("article"), F.when(F.col("l_returnflag") == "R", F.lit(STRUCTURAL_SCORE)).otherwise(0.1).alias("score"),
                                F.when(F.col("l_linestatus") == "F", 0.5).alias("sim"))
    return evaluation.basis_path(rows, tie="stored")


@query("""WITH h AS (SELECT s_suppkey AS nr, l_orderkey * 10 + l_linenumber AS id, row_number() OVER (PARTITION BY s_suppkey ORDER BY l_orderkey, l_orderkey * 10 + l_linenumber) AS n
    FROM supplier JOIN lineitem ON l_suppkey = s_suppkey AND l_linenumber = 1 + s_suppkey % 7) SELECT nr, id FROM h WHERE n <= 8""")
def oracle_units(t, spark):
    """Up to eight chunks of each answer key's article."""
    keys = t("supplier").select(F.col("s_suppkey").alias("nr"), F.col("s_suppkey").alias("external_id"), F.concat(F.lit("("), (1 + F.col("s_suppkey") % 7).cast("string"), F.lit(")")).alias("article"))
    chunks = t("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_suppkey").alias("external_id"), F.col("l_linenumber").cast("string").alias("article_no"),
                                  F.col("l_orderkey").alias("chunk_index"), F.lit("t").alias("text"))
    return evaluation.oracle_chunks(keys, chunks).select("nr", "id")


@query("""SELECT source, doc_id::VARCHAR AS external_id, sha256(CASE WHEN lang = 'fr' THEN 'new ' || coalesce(text, '') ELSE coalesce(text, '') END) AS raw_sha256 FROM documents""")
def raw_store(t, spark):
    """Documents written to a raw store, French ones twice: the latest version of each is read."""
    root = shared_folder(spark, "raw")
    raw = t("documents").select("source", F.col("doc_id").cast("string").alias("external_id"), F.coalesce("text", F.lit("")).alias("raw_content"), "lang")
    stores.write_raw(raw.drop("lang"), root)
    stores.write_raw(raw.where("lang = 'fr'").withColumn("raw_content", F.concat(F.lit("new "), "raw_content")).drop("lang"), root)
    return stores.read_raw(spark, root).select("source", "external_id", F.sha2("raw_content", 256).alias("raw_sha256"))


@query("""SELECT o_custkey::VARCHAR AS act, lower('DU/' || o_orderpriority) AS amendment, max(strftime(o_orderdate, '%Y-%m-%d')) AS effective_date FROM orders WHERE o_orderstatus = 'O' GROUP BY ALL""")
def amendment_map(t, spark):
    a = F.struct(F.concat(F.lit("DU/"), "o_orderpriority").alias("eli_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("effective_date"))
    acts = t("orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").cast("string").alias("external_id"), F.array(a).alias("unabsorbed"))
    return grounding.unabsorbed_map(acts)


@query("""WITH u AS (SELECT l_suppkey AS doc_id, CASE WHEN l_linenumber <> 7 THEN l_linenumber::VARCHAR END AS article, l_returnflag AS paragraph, l_orderkey * 10 + l_linenumber AS pos FROM lineitem),
  n AS (SELECT *, count(*) OVER w AS n, row_number() OVER (w ORDER BY pos) AS k FROM u WINDOW w AS (PARTITION BY doc_id, article, paragraph))
  SELECT doc_id, pos, CASE WHEN n > 1 AND article IS NOT NULL THEN ' (wariant ' || k || '/' || n || ')' END AS variant FROM n""")
def duplicate_units(t, spark):
    u = t("lineitem").select(F.col("l_suppkey").alias("doc_id"), F.when(F.col("l_linenumber") != 7, F.col("l_linenumber").cast("string")).alias("article"), F.col("l_returnflag").alias("paragraph"),
                             F.lit(None).cast("string").alias("point"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    return normalize.mark_duplicate_units(u).select("doc_id", "pos", "variant")


@query("""SELECT conv_id, turn FROM conversations WHERE conv_id = (SELECT min(conv_id) FROM conversations WHERE conv_id % 7 = 3)""")
def own_messages(t, spark):
    """Messages of one of a user's conversations; the conversation is looked up in the table."""
    c = t("conversations")
    first = c.where("conv_id % 7 = 3").agg(F.min("conv_id")).first()[0]
    parents = c.select("conv_id", (F.col("conv_id") % 7).alias("user_id")).distinct()
    messages = c.withColumnsRenamed({"turn": "created_at"}).withColumn("message_id", F.col("created_at"))
    return conversations.messages_of(parents, messages, 3, first).select("conv_id", F.col("created_at").alias("turn"))


STORED = "CASE doc_id % 4 WHEN 0 THEN '[{\"Index\":' || doc_id || ',\"Label\":\"L' || doc_id || '\"},{\"Title\":\"T\"}]' WHEN 1 THEN 'broken' WHEN 2 THEN NULL ELSE '[]' END"


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 2 ELSE 0 END::BIGINT AS n, CASE WHEN doc_id % 4 = 0 THEN doc_id || ',0' ELSE '' END AS indexes, CASE WHEN doc_id % 4 = 0 THEN 'L' || doc_id || ',' ELSE '' END AS labels FROM documents""")
def source_lists(t, spark):
    """Stored source lists with missing fields, no JSON, nulls and empty lists."""
    s = t("documents").select("doc_id", conversations.stored_sources(F.expr(STORED)).alias("s"))
    return s.select("doc_id", F.size("s").alias("n"), F.array_join(F.transform("s", lambda x: x["index"].cast("string")), ",").alias("indexes"), F.array_join(F.transform("s", lambda x: x["label"]), ",").alias("labels"))


@query("""SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'ala' WHEN 'MACHINERY' THEN 'ola' END AS owner FROM customer""")
def invite_codes(t, spark):
    return t("customer").select("c_custkey", conversations.invite({"BUILDING": "ala", "MACHINERY": "ola", "building": "ela"}, F.concat(F.lit("  "), "c_mktsegment", F.lit(" "))).alias("owner"))


@query("""SELECT doc_id::VARCHAR AS doc_id FROM documents WHERE lang = 'de' OR lang = 'fr'""")
def stale_documents(t, spark):
    """Documents with a chunk of another model (German) or of none (French)."""
    chunks = t("documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.when(F.col("lang") == "de", "old").when(F.col("lang") != "fr", "m1").alias("embedded_with"))
    return ingest.stale_documents(chunks, "m1")


@query("""SELECT source, doc_id::VARCHAR AS external_id, '[chunk] ' || lang AS failure_reason FROM documents WHERE lang = 'en'""")
def failure_report(t, spark):
    """Failures written as JSON lines and read again."""
    path = shared_folder(spark, "failures")
    d = t("documents").select("source", F.col("doc_id").cast("string").alias("external_id"), F.when(F.col("lang") == "en", "Failed").otherwise("Indexed").alias("status"), F.concat(F.lit("[chunk] "), "lang").alias("failure_reason"))
    stores.write_failures(d, path)
    return spark.read.schema("source string, external_id string, failure_reason string").json(path)
