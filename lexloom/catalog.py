"""Registered queries of the retrieval engine and their SQL.

The driver's tables stand in for the engine's: documents with embeddings are
chunks, lineitem are units of orders, events are requests. Constants such as
questions are part of a query; tables are always read whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .functions import citations as C
from .functions import text as T
from .operators import chunking, conversations, evaluation, grounding, ingest, limits, normalize, ordered, retrieval, structural, text_index, vector_index
from .plans import ingest as jobs
from .sources.snapshots import Change
from .sources.workspace import built_once, shared_folder

FLAGSHIP = "hybrid_rrf"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (table reader, spark) under its name."""
    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark)
            return out.select(*[F.col(c).cast("long").alias(c) if t in ("int", "smallint", "tinyint") else F.col(c) for c, t in out.dtypes])

        run.__name__ = f.__name__
        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


QUESTIONS = [(0, "the of and in"), (1, "the was that"), (2, "de la les"), (3, "der die in"), (4, "ring with")]
Q_VALUES = ", ".join(f"({i}, '{q}')" for i, q in QUESTIONS)


def literal(spark, rows: str, columns: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t({columns})")


def questions(t, spark) -> DataFrame:
    """Five stated questions; their vectors are those of the same number."""
    q = literal(spark, Q_VALUES, "qid, question").withColumn("qid", F.col("qid").cast("long"))
    return q.join(t("embeddings").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("query_vector")), "qid")


def chunk_table(t) -> DataFrame:
    e = t("embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return t("documents").join(e, "doc_id", "left").withColumnRenamed("doc_id", "id")


TOKENS = "list_filter(regexp_split_to_array(lower(coalesce({}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
Q_SQL = f"q(qid, question) AS (SELECT a::BIGINT, b FROM (VALUES {Q_VALUES}) v(a, b))"
DENSE_SQL = """pairs AS (SELECT q.qid, c.id, round(list_dot_product(c.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) AS sim
    FROM q JOIN embeddings e ON e.vec_id = q.qid CROSS JOIN chunks c WHERE c.embedding IS NOT NULL),
  dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, id) AS rank FROM pairs) WHERE rank <= 50)"""
CHUNKS_SQL = "chunks AS (SELECT d.doc_id AS id, d.*, e.embedding FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id)"
POSTINGS_SQL = f"""toks AS (SELECT id, {TOKENS.format('text')} AS t FROM chunks),
  stats AS (SELECT count(*)::DOUBLE AS n, avg(len(t)) AS m FROM toks),
  post AS (SELECT id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT id, len(t) AS dl, unnest(t) AS term FROM toks) GROUP BY id, term),
  terms AS (SELECT qid, unnest(t) AS term, len(t) AS n_terms FROM (SELECT qid, list_distinct({TOKENS.format('question')}) AS t FROM q))"""
LEXICAL_SQL = """freq AS (SELECT term, count(*) AS df FROM post GROUP BY term),
  hits AS (SELECT qid, id, count(*) AS hits, any_value(n_terms) AS n_terms,
      round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / m))), 9) AS score
    FROM post JOIN terms USING (term) JOIN freq USING (term) CROSS JOIN stats GROUP BY qid, id),
  lexical AS (SELECT * FROM (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM hits WHERE hits = n_terms) WHERE rank <= 50)"""
RRF_SQL = """fused AS (SELECT qid, id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS rrf, max(sim) AS sim
    FROM (SELECT qid, id, rank, sim FROM dense UNION ALL SELECT qid, id, rank, NULL FROM lexical) GROUP BY qid, id),
  best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rrf DESC, id) AS rrf_rank FROM fused) WHERE rrf_rank <= 32)"""
DEDUP_SQL = """uniq AS (SELECT * FROM (SELECT b.*, c.text, row_number() OVER (PARTITION BY qid, lower(trim(regexp_replace(c.text, '\\s+', ' ', 'g'))) ORDER BY rrf DESC, b.id) AS n
    FROM best b JOIN chunks c ON c.id = b.id) WHERE n = 1)"""
WITH = f"WITH {Q_SQL}, {CHUNKS_SQL}, {DENSE_SQL}"
WITH_LEX = f"{WITH}, {POSTINGS_SQL}, {LEXICAL_SQL}"
WITH_ALL = f"{WITH_LEX}, {RRF_SQL}, {DEDUP_SQL}"


#: Structural rows stand for cited units: the shortest documents, for every question.
ASSEMBLY_SQL = """structural AS (SELECT qid, doc_id AS id, row_number() OVER (PARTITION BY qid ORDER BY doc_id) AS pos
    FROM q JOIN documents ON n_chars = (SELECT min(n_chars) FROM documents)),
  both_ AS (SELECT qid, id, 0 AS path, pos FROM structural UNION ALL SELECT qid, id, 1, row_number() OVER (PARTITION BY qid ORDER BY rrf DESC, id) FROM uniq),
  once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, id ORDER BY path, pos) AS n FROM both_) WHERE n = 1)
  SELECT qid, id, path, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY path, pos, id) AS rank FROM once) WHERE rank <= 8"""


def shortest(t, spark, k: int = 8) -> DataFrame:
    """(qid, id, pos): the k first of the shortest documents, for every question; no later one can be among k rows."""
    least = t("documents").agg(F.min("n_chars").alias("n_chars"))
    short = t("documents").join(F.broadcast(least), "n_chars").select(F.col("doc_id").alias("id")).orderBy("id").limit(k)
    return literal(spark, Q_VALUES, "qid, question").select(F.col("qid").cast("long").alias("qid")).crossJoin(short).withColumn(
        "pos", F.row_number().over(W.partitionBy("qid").orderBy("id")))


def stored_text(t, spark) -> text_index.TextIndex:
    """The documents' text index: written by the first query that needs it, read by the others."""
    docs = t("documents").select(F.col("doc_id").alias("id"), "text")
    return text_index.open_index(spark, built_once(docs, "text-index", lambda path: text_index.build(docs, path)))


def stored_vectors(t, spark) -> vector_index.VectorIndex:
    vectors = t("embeddings").select(F.col("vec_id").alias("id"), "embedding")
    path = built_once(vectors, "vector-index", lambda path: vector_index.build(vectors, path, 16))
    return vector_index.open_index(spark, path)


def both_paths(t, spark):
    c, q = chunk_table(t), questions(t, spark)
    dense = retrieval.dense_topk(c, q, n_queries=len(QUESTIONS))
    return c, q, dense, text_index.topk(stored_text(t, spark), q, n_queries=len(QUESTIONS))


@query(f"""{WITH} SELECT id, sim, rank FROM dense WHERE qid = 0""")
def dense_topk(t, spark):
    return retrieval.dense_topk(chunk_table(t), questions(t, spark).where("qid = 0"), n_queries=1).select("id", "sim", "rank")


@query(f"{WITH} SELECT qid, id, sim, rank FROM dense")
def dense_topk_batch(t, spark):
    return retrieval.dense_topk(chunk_table(t), questions(t, spark), n_queries=len(QUESTIONS))


@query("""WITH p AS (SELECT q.vec_id AS qid, e.vec_id AS id, round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS sim
    FROM embeddings q JOIN embeddings e ON q.vec_id % 50 = 0 WHERE q.embedding IS NOT NULL AND e.embedding IS NOT NULL)
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, id) AS rank FROM p) WHERE rank <= 50""")
def dense_topk_cells(t, spark):
    """All vectors whose id is divisible by 50, against all: exact, through the stored cells."""
    q = t("embeddings").where("vec_id % 50 = 0 AND embedding IS NOT NULL").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("query_vector"))
    return vector_index.topk(stored_vectors(t, spark), q, digits=6)


@query(f"{WITH}, {POSTINGS_SQL} SELECT qid, id, count(*) AS hits FROM post JOIN terms USING (term) GROUP BY qid, id HAVING count(*) = any_value(n_terms)")
def lexical_match(t, spark):
    return text_index.match(stored_text(t, spark), questions(t, spark), n_queries=len(QUESTIONS))


@query(f"{WITH}, {POSTINGS_SQL} SELECT qid, id, count(*) AS hits FROM post JOIN terms USING (term) GROUP BY qid, id")
def lexical_match_any(t, spark):
    return text_index.match(stored_text(t, spark), questions(t, spark), "or", n_queries=len(QUESTIONS))


@query(f"{WITH_LEX} SELECT qid, id, score, rank FROM lexical")
def lexical_bm25_topk(t, spark):
    return both_paths(t, spark)[3]


@query(f"{WITH_ALL} SELECT qid, id, rrf, sim, rrf_rank FROM best")
def hybrid_rrf(t, spark):
    _, _, dense, lexical = both_paths(t, spark)
    return retrieval.top_k(retrieval.rrf(dense, lexical), 32, "qid", F.desc("rrf"), F.asc("id"), rank="rrf_rank")


@query(f"{WITH} SELECT q.qid, coalesce(max(sim), 0.0) AS max_similarity FROM q JOIN embeddings e ON e.vec_id = q.qid LEFT JOIN dense USING (qid) GROUP BY q.qid")
def retrieval_signal(t, spark):
    q = questions(t, spark)
    return q.select("qid").join(retrieval.signal(retrieval.dense_topk(chunk_table(t), q, n_queries=5)), "qid", "left").fillna(0.0, ["max_similarity"])


@query("""WITH c AS (SELECT d.doc_id AS id, d.n_chars, l.quality, l.toxic, d.lang FROM documents d LEFT JOIN labels l USING (doc_id))
  SELECT id FROM c WHERE lang = 'en' AND (lang <> 'en' OR toxic = 0) AND n_chars >= 200""")
def hybrid_filtered(t, spark):
    """Unknown force (no label) fails the filter, as in SQL."""
    docs = t("documents").join(t("labels"), "doc_id", "left").select(
        F.col("doc_id").alias("id"), F.col("lang").alias("court_type"), F.when(F.col("lang") == "en", "act").otherwise("judgment").alias("doc_type"),
        (F.col("toxic") == 0).alias("in_force"), F.col("n_chars").alias("token_count"), F.lit(None).cast("date").alias("judgment_date"))
    return retrieval.metadata_filter(docs, court_type="en", only_in_force=True, min_tokens=200).select("id")


@query("""SELECT id, key_size FROM (SELECT doc_id AS id, count(*) OVER w AS key_size, row_number() OVER (w ORDER BY n_chars DESC, doc_id) AS n FROM documents
  WINDOW w AS (PARTITION BY lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))))) WHERE n = 1""")
def text_dedup(t, spark):
    return retrieval.dedup_corpus(t("documents").select(F.col("doc_id").alias("id"), "text", F.col("n_chars").alias("score"))).select("id", "key_size")


@query(f"{WITH_ALL}, {ASSEMBLY_SQL}")
def final_assembly(t, spark):
    """Structural rows here: the shortest documents, for every question."""
    c, q, dense, lexical = both_paths(t, spark)
    best = retrieval.top_k(retrieval.rrf(dense, lexical), 32, "qid", F.desc("rrf"), F.asc("id"))
    uniq = retrieval.text_dedup(c.select("id", "text").join(F.broadcast(best), "id"))  # 32 rows a question
    ranked = uniq.withColumn("pos", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("rrf"), "id")))
    return retrieval.assemble(shortest(t, spark), ranked, 8).select("qid", "id", "path", "rank")


@query(f"""{WITH_ALL} SELECT qid, id, rank FROM (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY rrf DESC, id) AS rank FROM uniq) WHERE rank <= 8""")
def hybrid_search(t, spark):
    rows, _ = retrieval.hybrid(chunk_table(t), questions(t, spark), 8, n_queries=len(QUESTIONS), index=stored_text(t, spark))
    return rows.select("qid", "id", "rank")


@query(f"{WITH_ALL}, {ASSEMBLY_SQL}".replace(CHUNKS_SQL, CHUNKS_SQL[:-1] + " WHERE d.lang = 'en' AND d.n_chars >= 200)"))
def filtered_units(t, spark):
    """Search under filters that the structural rows, the shortest documents, do not meet."""
    c = chunk_table(t).withColumnsRenamed({"lang": "court_type", "n_chars": "token_count"})
    rows, _ = retrieval.hybrid(c, questions(t, spark), 8, n_queries=len(QUESTIONS), structural=shortest(t, spark), filters={"court_type": "en", "min_tokens": 200})
    return rows.select("qid", "id", "path", "rank")


@query("""WITH s AS (SELECT q.label, max(round(list_dot_product(a.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9)) AS m
    FROM embeddings a CROSS JOIN (SELECT label, embedding FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1) q
    WHERE a.label <> q.label GROUP BY q.label)
  SELECT label, m AS max_similarity, m < 0.3 AS abstained FROM s""")
def abstention_gate(t, spark):
    """One question per label (its first vector) against all vectors of other labels."""
    e = t("embeddings")
    q = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("v"))
    sims = e.select(F.col("label").alias("own"), "embedding").join(F.broadcast(q), F.col("own") != F.col("label"))
    s = sims.groupBy("label").agg(F.max(F.round(retrieval.dot(F.col("embedding"), F.col("v")), 9)).alias("max_similarity"), F.count("*").alias("n"))
    return s.select("label", "max_similarity", grounding.abstain(F.col("max_similarity"), F.col("n"), 0.3).alias("abstained"))


#: How a text cites, by its number modulo seven; the text itself follows.
CITING = ["'Co grozi za art. ' || n || ' k.k.? '", "'art. ' || n || ' i 95 oraz 96a Kodeksu wykroczeń. '", "'Artykuł 5, ' || n || ' i 7 kpc § 2. '", "'bez cytatu. '",
          "'Art ' || n || 'bb KSH, art. 415 § 1a kodeks cywilny. '", "'artykułu ' || n || ' k. p. a. § 3. '", "''"]
CITING_SQL = "CASE doc_id % 7 " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(CITING)) + " END"
CHAIN_SQL = "'(?i)\\bart(?:yku[\\p{L}\\p{N}_]*|\\.)?\\s*\\d+[a-zA-Z]*(?:\\s*(?:,|i|oraz)\\s*\\d+[a-zA-Z]*)*'"
ABBREVIATION_SQL = " ".join(f"WHEN regexp_matches(question, '(?i)(?:^|[^\\p{{L}}.])" + r"\.?\s?".join(a) + f"\\.?(?:$|[^\\p{{L}}])') THEN '{a}'" for a in C.ABBREVIATIONS)


@query(f"""WITH d AS (SELECT doc_id, text, doc_id::VARCHAR AS n FROM documents), q AS (SELECT doc_id AS qid, {CITING_SQL} || coalesce(text, '') AS question FROM d),
  chains AS (SELECT qid, question, unnest(regexp_extract_all(question, {CHAIN_SQL})) AS chain, generate_subscripts(regexp_extract_all(question, {CHAIN_SQL}), 1) AS k FROM q),
  numbers AS (SELECT qid, question, k, unnest(regexp_extract_all(chain, '\\d+[a-zA-Z]*')) AS article, generate_subscripts(regexp_extract_all(chain, '\\d+[a-zA-Z]*'), 1) AS i FROM chains)
  SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY k, i) - 1 AS n, article,
    coalesce(nullif(trim(regexp_replace(regexp_extract(question, '(?i)kodeks[\\p{{L}}]*(?:\\s+\\p{{L}}+){{1,2}}'), '\\s+', ' ', 'g')), ''), CASE {ABBREVIATION_SQL} END) AS act_hint
  FROM numbers""")
def citation_parse(t, spark):
    """Every document as a question that cites units."""
    d = t("documents").select("doc_id", F.col("doc_id").cast("string").alias("n"), F.coalesce("text", F.lit("")).alias("text"))
    q = d.select(F.col("doc_id").alias("qid"), F.concat(F.expr(CITING_SQL), "text").alias("question"))
    return structural.cited_units(q, limit=1 << 20).select("qid", "n", "article", "act_hint")


TRI_SQL = "list_distinct(flatten(list_transform({0}, lambda w: list_transform(range(1, len(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
HINTS = "('red large'), ('blue small'), ('steel'), ('zzz qqq')"


@query(f"""WITH h(hint) AS (VALUES {HINTS}), p AS (SELECT p_partkey, {TRI_SQL.format(TOKENS.format('p_name'))} AS a FROM part),
  g AS (SELECT hint, {TRI_SQL.format(TOKENS.format('hint'))} AS b FROM h),
  s AS (SELECT hint, p_partkey, round(len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))), 9) AS s FROM p CROSS JOIN g)
  SELECT hint, arg_min(p_partkey, (-s, p_partkey)) AS external_id FROM s WHERE s >= 0.15 GROUP BY hint""")
def act_resolve_trigram(t, spark):
    acts = t("part").select(F.col("p_partkey").alias("external_id"), F.col("p_name").alias("title"))
    return structural.resolve_acts(literal(spark, HINTS, "hint"), acts, n_hints=4)


UNITS = "(1, 0, '1', 'R'), (1, 1, '3', 'N'), (2, 0, '7', 'N'), (2, 1, '1', 'N'), (3, 0, '32', 'A'), (3, 1, '33', 'R')"


@query(f"""WITH w(qid, n, ext, art) AS (VALUES {UNITS}),
  h AS (SELECT qid, n, l_orderkey * 10 + l_linenumber AS id, row_number() OVER (PARTITION BY qid, n ORDER BY l_linenumber, l_orderkey * 10 + l_linenumber) AS r
    FROM w JOIN lineitem ON l_orderkey::VARCHAR = ext AND l_returnflag = art)
  SELECT qid::BIGINT AS qid, id, row_number() OVER (PARTITION BY qid ORDER BY n, r) AS pos FROM h WHERE r <= 20""")
def structural_lookup(t, spark):
    w = literal(spark, UNITS, "qid, n, ext, article").withColumn("act_hint", F.col("ext"))
    units = t("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").cast("string").alias("external_id"),
                                 F.col("l_returnflag").alias("article_no"), F.col("l_linenumber").alias("chunk_index"))
    resolved = w.select(F.col("ext").alias("hint"), F.col("ext").alias("external_id")).distinct()
    return structural.structural_lookup(w, resolved, units)


@query("""SELECT conv_id, turn, concat_ws(' ', lag(text, 2) OVER w, lag(text, 1) OVER w, text) AS contextual
  FROM conversations WHERE role = 'user' AND length(trim(text)) > 0 WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def followup_context(t, spark):
    return structural.followup_text(t("conversations").where("role = 'user'")).select("conv_id", "turn", "contextual")


@query("""WITH s AS (SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 0)::DOUBLE[]), 9) AS a,
    round(list_dot_product(embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 1)::DOUBLE[]), 9) AS b FROM embeddings)
  SELECT vec_id, a <= b + 0.02 AS contextual FROM s""")
def variant_choice(t, spark):
    e = t("embeddings")
    two = e.where("vec_id IN (0, 1)").groupBy().agg(F.max_by("embedding", -F.col("vec_id")).alias("a"), F.max_by("embedding", "vec_id").alias("b"))
    s = e.crossJoin(F.broadcast(two))
    return s.select("vec_id", structural.pick_contextual(F.round(retrieval.dot(F.col("embedding"), F.col("a")), 9), F.round(retrieval.dot(F.col("embedding"), F.col("b")), 9)).alias("contextual"))


@query("""WITH m AS (SELECT * FROM conversations WHERE NOT (role = 'assistant' AND length(text) < 300)),
  c AS (SELECT *, CASE WHEN role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 0 ELSE 1 END AS c FROM m),
  i AS (SELECT *, sum(c) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM c)
  SELECT conv_id, island::BIGINT AS island, role, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text, min(turn) AS turn FROM i GROUP BY conv_id, island, role""")
def role_coalesce(t, spark):
    """Short answers are left out, so that user turns meet."""
    m = t("conversations").where("NOT (role = 'assistant' AND length(text) < 300)")
    return grounding.coalesce_roles(m, "conv_id", "turn")


@query("""SELECT conv_id, turn, CASE WHEN length(c) <= 100 THEN c ELSE left(c, 100) || '…' END AS clean
  FROM (SELECT conv_id, turn, trim(regexp_replace('[1] ' || text || ' [23]', '\\[\\d+\\]', '', 'g')) AS c FROM conversations)""")
def history_sanitize(t, spark):
    marked = F.concat(F.lit("[1] "), "text", F.lit(" [23]"))
    return t("conversations").select("conv_id", "turn", T.sanitize_history(marked, 100).alias("clean"))


@query("""SELECT doc_id, CASE WHEN length(text) <= 300 THEN text ELSE left(text, 300) || '…' END AS snippet FROM documents""")
def snippet(t, spark):
    return t("documents").select("doc_id", T.snippet(F.col("text")).alias("snippet"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN concat_ws(', ', o_orderpriority, 'art. ' || o_custkey || ' § 1', 'DU/' || o_orderkey)
    WHEN o_orderstatus = 'O' THEN concat_ws(', ', o_orderpriority, strftime(o_orderdate, '%Y-%m-%d')) ELSE 'Title' END AS label FROM orders""")
def locator_label(t, spark):
    o, none = t("orders"), F.lit(None).cast("string")
    f, open_ = F.col("o_orderstatus") == "F", F.col("o_orderstatus") == "O"
    label = T.locator_label(
        F.when(f, F.col("o_orderpriority")).otherwise("Title"), F.when(f, F.concat(F.lit("DU/"), F.col("o_orderkey").cast("string"))), F.when(f, F.col("o_custkey").cast("string")),
        F.when(f, F.lit("1")), none, F.when(f, F.lit(" ")), F.when(open_, F.col("o_orderpriority")), none, F.when(open_, F.col("o_orderdate").cast("date")))
    return o.select("o_orderkey", label.alias("label"))


@query("""WITH r AS (SELECT doc_id // 8 AS qid, doc_id, lang, text, row_number() OVER (PARTITION BY doc_id // 8 ORDER BY doc_id) AS n FROM documents)
  SELECT qid, sha256('PYTANIE:' || chr(10) || 'Q ' || qid || chr(10) || chr(10) || 'ŹRÓDŁA:' || chr(10) ||
    string_agg('[' || n || '] ' || lang || chr(10) || text || chr(10) || chr(10), '' ORDER BY n)) AS prompt_sha256, max(n) AS n_sources FROM r GROUP BY qid""")
def grounded_prompt(t, spark):
    """All documents as sources, eight to a question, as many as a search returns."""
    rows = t("documents").select(F.floor(F.col("doc_id") / 8).alias("qid"), F.col("doc_id").alias("pos"), F.col("lang").alias("label"), "text")
    block = grounding.source_block(rows)
    return block.select("qid", F.sha2(grounding.user_message(F.concat(F.lit("Q "), F.col("qid").cast("string")), F.col("sources")), 256).alias("prompt_sha256"), "n_sources")


@query("""WITH a AS (SELECT item_id, text || ' Art.  5 obowiązuje. II AKo 174/22' AS context, 'Zob. [1], [3] i [1]; art. 5, art. 77 § 2 oraz II AKo 174/22 i I ACa 1/20 [9]' AS answer FROM benchmark)
  SELECT item_id, 3::BIGINT AS n_cited, 1::BIGINT AS n_outside,
    (CASE WHEN contains(lower(regexp_replace(context, '\\s+', ' ', 'g')), 'art. 77 § 2') THEN 0 ELSE 1 END
     + CASE WHEN contains(lower(regexp_replace(context, '\\s+', ' ', 'g')), 'i aca 1/20') THEN 0 ELSE 1 END)::BIGINT AS n_suspicious, false AS clean FROM a""")
def citation_validate(t, spark):
    a = t("benchmark").select("item_id", F.concat("text", F.lit(" Art.  5 obowiązuje. II AKo 174/22")).alias("sources"), F.lit(5).alias("n_sources"),
                              F.lit("Zob. [1], [3] i [1]; art. 5, art. 77 § 2 oraz II AKo 174/22 i I ACa 1/20 [9]").alias("answer"))
    c = grounding.validate(a)
    return c.select("item_id", F.size("check.cited").alias("n_cited"), F.size("check.out_of_range").alias("n_outside"), F.size("check.suspicious").alias("n_suspicious"), "check.clean")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents),
  o AS (SELECT *, coalesce(sum(length(raw) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM l)
  SELECT doc_id, line, (before + length(raw) - length(ltrim(raw)))::BIGINT AS "offset", length(trim(raw)) AS chars, len(string_split_regex(trim(raw), '\\s+')) AS words
  FROM o WHERE length(trim(raw)) > 0""")
def chunk_units(t, spark):
    u = chunking.text_units(t("documents"), "doc_id", "text")
    return u.select("doc_id", "line", "offset", F.length("text").alias("chars"), "words")


@query()
def chunk_pack(t, spark):
    segments = t("documents").select("doc_id", F.lit(0).alias("seg"), "text", F.lit(0).alias("char_start"))
    return chunking.chunk_segments(segments)


@query(f"""SELECT doc_id, len(regexp_extract_all(text, '{T.SUBSTANTIVE}')) AS words FROM documents WHERE len(regexp_extract_all(text, '{T.SUBSTANTIVE}')) >= 5""")
def degenerate_filter(t, spark):
    n = T.substantive_words(F.col("text"))
    return t("documents").select("doc_id", n.alias("words")).where("words >= 5")


@query()
def html_to_text(t, spark):
    return normalize.with_plain_text(t("pages"), "html").select("page_id", F.length("plain_text").alias("chars"), F.sha2("plain_text", 256).alias("text_sha256"))


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(t, spark):
    return t("documents").select("doc_id", T.content_hash(F.col("text")).alias("content_hash"))


@query("""WITH l AS (SELECT doc_id, source, string_split(text, chr(10)) AS s, toxic FROM documents LEFT JOIN labels USING (doc_id))
  SELECT source, count(*) AS docs, 0::BIGINT AS empty, count(*) FILTER (WHERE toxic = 1) AS with_issues, sum(len(s))::BIGINT AS segments,
    round(sum(list_sum(list_transform(s, lambda x: length(x))))::DOUBLE / sum(len(s)), 6) AS mean_segment_length FROM l GROUP BY source""")
def quality_report(t, spark):
    d = t("documents").join(t("labels"), "doc_id", "left")
    d = d.select("source", F.transform(F.split("text", "\n"), lambda x: F.struct(x.alias("text"))).alias("segments"),
                 F.when(F.col("toxic") == 1, F.array(F.lit("toxic"))).otherwise(F.array().cast("array<string>")).alias("quality_issues"))
    return normalize.quality_report(d).withColumn("mean_segment_length", F.round("mean_segment_length", 6))


SNAPSHOT_SQL = """raw AS (SELECT source, doc_id::VARCHAR AS external_id, sha256(text) AS content_hash, lang, n_chars FROM documents),
  old AS (SELECT source, external_id, CASE WHEN lang = 'fr' THEN 'changed' ELSE content_hash END AS old_hash, CASE WHEN n_chars < 200 THEN 'Failed' ELSE 'Indexed' END AS old_status,
    lang = 'de' AS stale FROM raw WHERE source <> 'src1')"""


def snapshot(t):
    """The documents, and an earlier state: one source is new, French ones changed, short ones failed, German ones are stale, Spanish ones have no chunks."""
    raw = t("documents").select("source", F.col("doc_id").cast("string").alias("external_id"), T.content_hash(F.col("text")).alias("content_hash"), "lang", "n_chars")
    docs = raw.where("source <> 'src1'").select(
        "source", "external_id", ingest.document_id().alias("doc_id"), F.when(F.col("lang") == "fr", "changed").otherwise(F.col("content_hash")).alias("content_hash"),
        F.when(F.col("n_chars") < 200, "Failed").otherwise("Indexed").alias("status"), "lang")
    chunks = docs.where("lang <> 'es'").select("doc_id", F.when(F.col("lang") == "de", F.lit(None)).otherwise("m1").alias("embedded_with"))
    return raw.drop("lang", "n_chars"), docs, chunks


@query(f"""WITH {SNAPSHOT_SQL} SELECT source, external_id, CASE WHEN old_status IS NULL THEN 'Inserted' WHEN old_status = 'Indexed' AND old_hash = content_hash AND NOT stale THEN 'Skipped'
    WHEN old_status = 'Indexed' AND old_hash = content_hash THEN 'ReEmbedded' ELSE 'Updated' END AS outcome FROM raw LEFT JOIN old USING (source, external_id)""")
def ingest_classify(t, spark):
    return ingest.classify(*snapshot(t), "m1").select("source", "external_id", "outcome")


@query(f"WITH {SNAPSHOT_SQL} SELECT external_id, old_hash AS content_hash FROM old WHERE source = 'src2' AND old_status = 'Indexed' AND NOT stale")
def skip_set(t, spark):
    _, docs, chunks = snapshot(t)
    return ingest.skip_set(docs, chunks, "src2", "m1")


@query(f"""WITH {SNAPSHOT_SQL}, o AS (SELECT source, CASE WHEN old_status IS NULL THEN 'Inserted' WHEN old_status = 'Indexed' AND old_hash = content_hash AND NOT stale THEN 'Skipped'
    WHEN old_status = 'Indexed' AND old_hash = content_hash THEN 'ReEmbedded' ELSE 'Updated' END AS outcome FROM raw LEFT JOIN old USING (source, external_id))
  SELECT source, outcome, count(*) AS n FROM o GROUP BY source, outcome""")
def ingest_summary(t, spark):
    return ingest.run_summary(ingest.classify(*snapshot(t), "m1"))


@query(f"""WITH {SNAPSHOT_SQL}, o AS (SELECT source, external_id, lang, CASE WHEN old_status IS NULL THEN 'Inserted' WHEN old_status = 'Indexed' AND old_hash = content_hash AND NOT stale THEN 'Skipped'
      WHEN old_status = 'Indexed' AND old_hash = content_hash THEN 'ReEmbedded' ELSE 'Updated' END AS outcome, old_status FROM raw LEFT JOIN old USING (source, external_id)),
  f AS (SELECT *, lang = 'en' AND outcome IN ('Inserted', 'Updated') AS failed FROM o)
  SELECT source, external_id, CASE WHEN failed THEN 'Failed' ELSE outcome END AS outcome, CASE WHEN failed THEN 'Failed' WHEN outcome = 'Skipped' OR outcome = 'ReEmbedded' THEN old_status ELSE 'Indexed' END AS status,
    CASE WHEN old_status IS NULL THEN 0 ELSE 2 END + failed::BIGINT AS attempt_count, CASE WHEN failed THEN '[normalize] no normalizer for type book' END AS failure_reason FROM f""")
def ingest_quarantine(t, spark):
    """A whole batch with documents that no normalizer takes: English ones here. Stored documents have had two attempts."""
    _, docs, chunks = snapshot(t)
    docs = docs.drop("lang").withColumn("attempt_count", F.lit(2))
    chunks = chunks.select("doc_id", F.lit("c").alias("chunk_id"), F.lit(0).alias("chunk_index"), F.lit("text").alias("text"), F.lit(None).cast("array<float>").alias("embedding"), "embedded_with")
    raw = t("documents").select("source", F.col("doc_id").cast("string").alias("external_id"), F.when(F.col("lang") == "en", "book").otherwise("judgment").alias("doc_type"),
                                F.col("text").alias("raw_content"), F.lit("html").alias("content_format"), F.lit(None).cast("string").alias("payload"), F.lit(None).cast("string").alias("source_url"))
    b = jobs.process_batch(raw, docs, chunks, lambda texts: [[1.0, 0.0] for _ in texts], 2, "m1")
    rows = ingest.upsert_documents(docs, b.documents).select("source", "external_id", "status", "attempt_count", "failure_reason")
    return b.outcomes.select("source", "external_id", "outcome").join(rows, ["source", "external_id"])


@query("""WITH l AS (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents)
  SELECT doc_id::VARCHAR AS doc_id, count(*) AS chunks, sum(length(line))::BIGINT AS chars, max(i)::BIGINT AS last_index FROM l WHERE lang <> 'de' AND (lang <> 'fr' OR i % 2 = 0) GROUP BY doc_id""")
def chunk_replacement(t, spark):
    """Two commits of a snapshot store: lines as chunks; then French documents keep every other line and German ones lose all."""
    docs = t("documents").select(F.col("doc_id").cast("string").alias("doc_id"), "lang", "text")
    lines = docs.select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("chunk_index", "text"))
    rows, first = docs.select("doc_id", "lang"), lines.drop("lang")
    store = jobs.document_store(spark, shared_folder(spark, "store"), 16)
    store.commit("query", 0, {"documents": Change(rows.select("doc_id"), rows), "chunks": Change(rows.select("doc_id"), first)})
    touched = rows.where("lang IN ('fr', 'de')")
    store.commit("query", 1, {"documents": Change(touched.select("doc_id"), touched), "chunks": Change(touched.select("doc_id"), lines.where("lang = 'fr' AND chunk_index % 2 = 0").drop("lang"))})
    return store.read("chunks").groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum(F.length("text")).alias("chars"), F.max("chunk_index").alias("last_index"))


@query(f"""WITH {SNAPSHOT_SQL} SELECT source, external_id, content_hash FROM raw UNION ALL
  SELECT source, external_id, old_hash FROM old ANTI JOIN raw USING (source, external_id)""")
def upsert(t, spark):
    raw, docs, _ = snapshot(t)
    return ingest.upsert_documents(docs.select("source", "external_id", "content_hash"), raw)


@query("""WITH r AS (SELECT user_id, event_type = 'error' AS bad, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events)
  SELECT user_id, max(n) AS longest FROM (SELECT user_id, i, count(*) FILTER (WHERE bad) AS n FROM r GROUP BY user_id, i) GROUP BY user_id""")
def fail_streak(t, spark):
    return ingest.fail_streaks(t("events"), "event_id", "user_id", "event_type = 'error'")


REFS_SQL = "SELECT o_custkey, o_orderkey, o_orderstatus, year(o_orderdate) AS y, 'DU/' || year(o_orderdate) || '/' || o_orderkey AS ref FROM orders"


def references(t):
    ref = F.struct(F.concat_ws("/", F.lit("DU"), F.year("o_orderdate").cast("string"), F.col("o_orderkey").cast("string")).alias("id"), F.lit(None).cast("string").alias("date"))
    lists = t("orders").groupBy("o_custkey").agg(F.collect_list(F.when(F.col("o_orderstatus") == "F", ref)).alias("f"), F.collect_list(F.when(F.col("o_orderstatus") != "F", ref)).alias("o"))
    return lists.select("o_custkey", F.create_map(F.lit(normalize.CONSOLIDATED), "f", F.lit(normalize.AMENDING), "o").alias("refs"))


@query(f"SELECT o_custkey, arg_max(ref, (y, o_orderkey)) FILTER (WHERE o_orderstatus = 'F') AS consolidated FROM ({REFS_SQL}) GROUP BY o_custkey")
def newest_consolidated(t, spark):
    return references(t).select("o_custkey", normalize.newest_consolidated(F.col("refs")).alias("consolidated"))


@query(f"""WITH r AS ({REFS_SQL}), c AS (SELECT o_custkey, max((y, o_orderkey)) AS k FROM r WHERE o_orderstatus = 'F' GROUP BY o_custkey)
  SELECT r.o_custkey, ref AS eli_id FROM r JOIN c USING (o_custkey) WHERE o_orderstatus <> 'F' AND (y, o_orderkey) > k""")
def unabsorbed_amendments(t, spark):
    r = references(t)
    a = r.select("o_custkey", normalize.unabsorbed_amendments(F.col("refs"), normalize.newest_consolidated(F.col("refs"))).alias("a"))
    return a.select("o_custkey", F.explode("a").alias("x")).select("o_custkey", "x.eli_id")


@query("""WITH s AS (SELECT o_custkey, list_sort(list_distinct(list(o_orderpriority) FILTER (WHERE o_orderstatus = 'F'))) AS a, list_sort(list_distinct(list(o_orderpriority) FILTER (WHERE o_orderstatus = 'O'))) AS b,
    max(o_orderpriority) FILTER (WHERE o_orderstatus = 'F') AS ca, max(o_orderpriority) FILTER (WHERE o_orderstatus = 'O') AS cb FROM orders GROUP BY o_custkey)
  SELECT o_custkey AS key, cb AS consolidated, coalesce(array_to_string(b, '|'), '') AS amendments FROM s WHERE coalesce(a, []) <> coalesce(b, []) OR ca IS DISTINCT FROM cb""")
def relink_diff(t, spark):
    def state(status):
        hit = F.when(F.col("o_orderstatus") == status, F.col("o_orderpriority"))
        return t("orders").groupBy(F.col("o_custkey").alias("key")).agg(F.max(hit).alias("consolidated"), F.collect_set(hit).alias("amendments"))

    return ingest.relink(state("F"), state("O")).withColumn("amendments", F.array_join("amendments", "|"))


@query("""WITH a(act, amendment, d) AS (VALUES ('x', 'src3', '2024-01-01'), ('y', 'src3', '2024-05-01'), ('x', 'src5', NULL), ('z', 'nothing', '2024-02-02'))
  SELECT doc_id, (SELECT max(d) FROM a WHERE amendment = source) AS amendment_date FROM documents""")
def temporal_tag(t, spark):
    u = literal(spark, "('x', 'src3', '2024-01-01'), ('y', 'src3', '2024-05-01'), ('x', 'src5', NULL), ('z', 'nothing', '2024-02-02')", "act, amendment, effective_date")
    return grounding.tag_amendments(t("documents").withColumnRenamed("source", "external_id"), u).select("doc_id", "amendment_date")


POINTS_SQL = """points AS (SELECT doc_id, l.toxic = 1 AS should_abstain, CASE WHEN l.quality = 1 THEN 'InCorpus' ELSE 'OutOfCorpus' END AS category,
    round(list_dot_product(e.embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 0)::DOUBLE[]), 6) AS s
  FROM labels l JOIN embeddings e ON e.vec_id = l.doc_id)"""


def points(t):
    e = t("embeddings")
    first = e.where("vec_id = 0").select(F.col("embedding").alias("q"))
    s = t("labels").join(e, F.col("doc_id") == F.col("vec_id")).crossJoin(F.broadcast(first))
    return s.select("doc_id", (F.col("toxic") == 1).alias("should_abstain"), F.when(F.col("quality") == 1, "InCorpus").otherwise("OutOfCorpus").alias("category"),
                    F.round(retrieval.dot(F.col("embedding"), F.col("q")), 6).alias("max_similarity"))


@query(f"""WITH {POINTS_SQL} SELECT count(*) AS total, round(avg((s >= 0.1)::INT) FILTER (WHERE category = 'InCorpus'), 6) AS recall_at_k,
    round(coalesce(avg(((s < 0.1) = should_abstain)::INT), 0), 6) AS abstention_accuracy, NULL::DOUBLE AS anti_hallucination,
    round(coalesce(avg(s) FILTER (WHERE category = 'InCorpus'), 0), 6) AS mean_sim_in, round(coalesce(avg(s) FILTER (WHERE category <> 'InCorpus'), 0), 6) AS mean_sim_out,
    count(*) FILTER (WHERE category = 'InCorpus') AS scored_recall, 0::BIGINT AS scored_traps FROM points""")
def eval_report(t, spark):
    none = F.lit(None).cast("boolean")
    v = points(t).select("category", "max_similarity", F.when(F.col("category") == "InCorpus", F.col("max_similarity") >= 0.1).alias("hit"),
                         ((F.col("max_similarity") < 0.1) == F.col("should_abstain")).alias("abstention_ok"), none.alias("no_hallucination"), none.alias("chat_ok"), none.alias("fresh_hit"))
    r = evaluation.report(v, 0.1)
    keep = ["recall_at_k", "abstention_accuracy", "anti_hallucination", "mean_sim_in", "mean_sim_out"]
    return r.select("total", *[F.round(c, 6).alias(c) for c in keep], "scored_recall", "scored_traps")


GRID_SQL = ", ".join(f"({i}, {t!r}::DOUBLE, {round(t, 2)}::DOUBLE)" for i, t in enumerate(evaluation.grid(-0.3, 0.9)))


@query(f"""WITH {POINTS_SQL}, g(i, t, r) AS (VALUES {GRID_SQL}), a AS (SELECT i, r, avg(((s < t) = should_abstain)::INT) AS acc FROM g CROSS JOIN points GROUP BY i, r)
  SELECT arg_max(r, (acc, -i)) AS threshold, round(max(acc), 9) AS accuracy FROM a""")
def best_threshold(t, spark):
    return evaluation.best_threshold(points(t), -0.3, 0.9).withColumn("accuracy", F.round("accuracy", 9))


@query(f"""WITH {POINTS_SQL} SELECT category, count(*) AS n, round(avg(s), 6) AS mean, min(s) AS min, max(s) AS max, count(DISTINCT round(s, 4)) AS distinct_values FROM points GROUP BY category""")
def similarity_diag(t, spark):
    return evaluation.similarity_diagnostics(points(t)).withColumn("mean", F.round("mean", 6))


ANSWERS_SQL = """ans AS (SELECT lang AS mode, source AS domain, nullif(regexp_extract(upper(text), '(?:^|[^\\p{L}\\d])([ABC])(?:$|[^\\p{L}\\d])', 1), '') AS letter,
    CASE quality WHEN 1 THEN 'A' WHEN 0 THEN 'B' ELSE 'C' END AS key FROM documents LEFT JOIN labels USING (doc_id))"""


def answers(t):
    a = t("documents").join(t("labels"), "doc_id", "left").select(
        F.col("lang").alias("mode"), F.col("source").alias("domain"), F.col("text").alias("answer"), F.when(F.col("quality") == 1, "A").when(F.col("quality") == 0, "B").otherwise("C").alias("key"))
    return evaluation.exam_answers(a)


@query(f"""WITH {ANSWERS_SQL}, g AS (SELECT mode, letter FROM ans UNION ALL SELECT 'key', key FROM ans)
  SELECT mode, count(*) FILTER (WHERE letter = 'A') AS A, count(*) FILTER (WHERE letter = 'B') AS B, count(*) FILTER (WHERE letter = 'C') AS C FROM g GROUP BY mode""")
def letter_pivot(t, spark):
    return evaluation.letter_distribution(answers(t))


@query(f"""WITH {ANSWERS_SQL} SELECT domain, count(*) AS n, round(avg(coalesce(letter = key, false)::INT), 9) AS accuracy FROM ans GROUP BY domain""")
def domain_accuracy(t, spark):
    return evaluation.group_accuracy(answers(t), "domain").withColumn("accuracy", F.round("accuracy", 9))


@query(f"""WITH {ANSWERS_SQL} SELECT mode, count(*) AS n, count(*) FILTER (WHERE letter = key) AS "right", round(avg(coalesce(letter = key, false)::INT), 9) AS accuracy,
  count(*) FILTER (WHERE letter IS NULL) AS unanswered FROM ans GROUP BY mode""")
def mode_accuracy(t, spark):
    return evaluation.mode_accuracy(answers(t)).withColumn("accuracy", F.round("accuracy", 9))


@query("""SELECT event_id, row_number() OVER (PARTITION BY date_trunc('hour', ts) ORDER BY ts, event_id) <= 10 AS accepted FROM events""")
def rate_fixed_window(t, spark):
    return limits.fixed_window_limit(t("events"), 10, "1 hour").select("event_id", "accepted")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
  r AS (SELECT user_id, event_id, n, [t] AS q, true AS accepted FROM e WHERE n = 1
    UNION ALL SELECT s.user_id, s.event_id, s.n, CASE WHEN len(s.q) < 3 THEN list_append(s.q, s.t) ELSE s.q END, len(s.q) < 3
      FROM (SELECT e.user_id, e.event_id, e.n, e.t, list_filter(r.q, lambda x: x >= e.t - 86400000000) AS q FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1) s)
  SELECT event_id, accepted FROM r""")
def rate_sliding_greedy(t, spark):
    return limits.sliding_limit(t("events"), 3, 86_400).select("event_id", "accepted")


@query("""WITH r AS (SELECT event_id, ts, ts::DATE AS day, user_id, length(props) AS c, row_number() OVER (PARTITION BY ts::DATE, user_id ORDER BY ts, event_id) <= 3 AS k FROM events),
  n AS (SELECT *, coalesce(sum(k::INT) OVER w, 0) AS n FROM r WINDOW w AS (PARTITION BY day ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  s AS (SELECT *, coalesce(sum(CASE WHEN k AND n < 120 THEN c ELSE 0 END) OVER w, 0) AS s FROM n WINDOW w AS (PARTITION BY day ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  SELECT strftime(day, '%Y-%m-%d') AS day, event_id, CASE WHEN s >= 2500 THEN 'chars' WHEN n >= 120 THEN 'requests' WHEN NOT k THEN 'user' ELSE 'ok' END AS verdict FROM s""")
def cost_daily(t, spark):
    e = t("events").withColumn("chars", F.length("props"))
    return limits.daily_caps(e, 2500, 120, 3).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("""WITH r AS (SELECT client_id, ts, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS opens FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL
    WINDOW w AS (PARTITION BY client_id ORDER BY ts, click_id)), s AS (SELECT *, sum(opens) OVER (PARTITION BY client_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM r)
  SELECT client_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS n FROM s GROUP BY client_id, session""")
def click_sessions(t, spark):
    """Sessions of ten minutes' silence; one client holds many of the clicks."""
    return ordered.sessions(t("clicks"), "client_id", "ts", "click_id", 600)


@query("""WITH a AS (SELECT DISTINCT 'src' || (n_nationkey % 20) AS amendment, (n_nationkey * 7 % 60)::VARCHAR || CASE WHEN n_nationkey % 5 = 0 THEN '(1)' ELSE '' END AS article FROM nation),
  d AS (SELECT doc_id, source, 'Zmienia się art art.  ' || (doc_id % 61) || ' oraz Art ' || (doc_id % 17) || 'a i art. ' || (doc_id % 23) || '(1). ' || coalesce(text, '') AS text FROM documents)
  SELECT DISTINCT doc_id, source FROM d JOIN a ON amendment = source WHERE regexp_matches(text, '(?i)\\bart\\.?\\s*' || replace(replace(article, '(', '\\('), ')', '\\)') || '\\b')""")
def amendment_mentions(t, spark):
    """Documents of amending sources that name an article of interest, in one pass over each text."""
    nation = t("nation")
    article = F.concat((F.col("n_nationkey") * 7 % 60).cast("string"), F.when(F.col("n_nationkey") % 5 == 0, "(1)").otherwise(""))
    wanted = nation.groupBy(F.concat(F.lit("src"), (F.col("n_nationkey") % 20).cast("string")).alias("source")).agg(F.collect_set(article).alias("articles"))
    text = F.concat(F.lit("Zmienia się art art.  "), (F.col("doc_id") % 61).cast("string"), F.lit(" oraz Art "), (F.col("doc_id") % 17).cast("string"), F.lit("a i art. "),
                    (F.col("doc_id") % 23).cast("string"), F.lit("(1). "), F.coalesce("text", F.lit("")))
    return t("documents").select("doc_id", "source", text.alias("text")).join(wanted, "source").where(grounding.mentions_any(F.col("text"), F.col("articles"))).select("doc_id", "source")


@query("""WITH p AS (SELECT o_custkey AS c, max(o_orderdate) AS u FROM orders GROUP BY o_custkey), k AS (SELECT c FROM p WHERE u >= TIMESTAMP '2001-06-01' - INTERVAL 183 DAYS)
  SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c FROM k)""")
def retention(t, spark):
    parents = t("orders").groupBy("o_custkey").agg(F.max("o_orderdate").cast("timestamp").alias("updated_at"))
    return conversations.cascade(t("orders"), conversations.retain(parents, "2001-06-01"), "o_custkey").select("o_orderkey")


#: Legal bases of answer keys, by the order's number modulo six.
BASES = ["'art. ' || o_custkey || '(1) k.k.'", "'art. ' || o_custkey || ' ustawy z dnia 29 lipca 2005 r. o ' || lower(o_orderpriority) || '.'", "'Art. ' || o_custkey || 'a KPC'", "'  '",
         "'Traktat, art. ' || o_custkey", "'art. ' || o_custkey || ' Konstytucji'"]
BASES_SQL = "CASE o_orderkey % 6 " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(BASES)) + " END"


@query(f"""WITH b AS (SELECT o_orderkey AS nr, {BASES_SQL} AS basis FROM orders) SELECT nr, nullif(regexp_extract(basis, '(?i)\\bart\\.\\s*(\\d+\\w*)', 1), '') AS article,
    nullif(regexp_replace(regexp_extract(basis, '(?i)ustaw[ay][^,]*?\\b(o\\s+.+)$', 1), '[. ]+$', ''), '') AS hint,
    CASE WHEN trim(basis) = '' THEN 'brak' {' '.join(f"WHEN contains(lower(basis), '{k}') THEN '{v}'" for k, v in C.DOMAINS)} ELSE 'inne' END AS domain FROM b""")
def exam_basis(t, spark):
    """Every order as an answer key with its legal basis."""
    b = t("orders").select(F.col("o_orderkey").alias("nr"), F.expr(BASES_SQL).alias("basis")).withColumn("b", C.legal_basis(F.col("basis")))
    return b.select("nr", "b.article", "b.hint", "b.domain")
