"""Queries over the driver's tables, with the same questions in SQL.

The tables stand for the lake: documents are Gold chunks (id = doc_id, texto = text, titulo = the first line,
categoria = lang, source_object = source, one address per source), the whole text of a benchmark item is a
question, and text is embedded by hashing.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamlake.functions.text import STOPWORDS, drop_stopwords, expand_terms, query_terms, tokenize
from loamlake.operators.context import pack_context
from loamlake.operators.embed import embed_documents
from loamlake.operators.evidence import context_sources
from loamlake.operators.fusion import dedup_sources, fuse
from loamlake.operators.lexical import LexicalIndex, lexical_search
from loamlake.operators.vector import vector_search
from loamlake.plans.config import RetrievalConfig
from loamlake.plans.engine import Engine

CONFIG = RetrievalConfig(author_weight=0.0)


#: Tables of texts up to this size (as Spark estimates it) are dealt to all cores; larger ones have row groups enough.
SMALL = 256 << 20


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table; a small one of long texts is dealt over all cores, as its one row group would be one task."""
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    if name in ("documents", "pages") and df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() <= SMALL:
        return df.repartition(spark.sparkContext.defaultParallelism)
    return df


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    title = F.substring_index("text", "\n", 1)
    return read(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("documento_id"), title.alias("titulo"), F.col("text").alias("texto"),
        F.concat(F.lit("https://"), "source", F.lit(".example/")).alias("url"), F.col("lang").alias("categoria"), F.col("source").alias("source_object"),
    )


def questions(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))


def engine(spark: SparkSession, sf: str) -> Engine:
    docs = chunks(spark, sf)
    # in the lake these are stored; here they are made once for all that reads them
    made = Engine(docs, embed_documents(docs, "id", "texto"), CONFIG)
    made.keep(made.vectors, StorageLevel.DISK_ONLY)
    return made


def asked(spark: SparkSession, sf: str) -> DataFrame:
    return questions(spark, sf).withColumn("terms", query_terms(F.col("question")))


# --- queries -------------------------------------------------------------------------------------------------


def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    index = LexicalIndex.build(chunks(spark, sf), CONFIG)
    q = asked(spark, sf).select("qid", expand_terms(F.col("terms")).alias("terms"))
    return lexical_search(index, q, 20, CONFIG)


def term_df(spark: SparkSession, sf: str) -> DataFrame:
    return LexicalIndex.build(chunks(spark, sf), CONFIG, keep=False).terms.select("term", "df", F.round("idf", 9).alias("idf"))


def doc_stats(spark: SparkSession, sf: str) -> DataFrame:
    w = CONFIG
    length = F.size(tokenize(F.col("titulo"))) * w.title_weight + F.size(tokenize(F.col("categoria"))) * w.category_weight + F.size(tokenize(F.col("texto"))) * w.content_weight
    return chunks(spark, sf).select("id", length.alias("len"))


def doc_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return chunks(spark, sf).select("id", F.array_join(tokenize(F.col("texto")), " ").alias("tokens"))


def query_terms_q(spark: SparkSession, sf: str) -> DataFrame:
    users = read(spark, sf, "conversations").where("role = 'user'")
    return users.select("conv_id", "turn", F.array_join(query_terms(F.col("text")), " ").alias("terms"), F.size(drop_stopwords(tokenize(F.col("text")))).alias("n_tokens"))


def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    v = read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    q = v.where("id % 10 = 0").select(F.col("id").alias("qid"), "vector")
    return vector_search(v, q, 20)


def embed_hash(spark: SparkSession, sf: str) -> DataFrame:
    vectors = embed_documents(chunks(spark, sf), "id", "texto")
    return vectors.select("id", F.posexplode("vector").alias("dim", "v")).where("v <> 0").select("id", "dim", F.col("v").cast("long").alias("v"))


def _both(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    e = engine(spark, sf)
    q = asked(spark, sf)
    near = e.keep(vector_search(e.vectors, q.select("qid", e.embedder.vector(F.col("question")).alias("vector")), 20))
    return near, lexical_search(e.index, q.select("qid", expand_terms(F.col("terms")).alias("terms")), 20, CONFIG)


def hybrid_rrf(spark: SparkSession, sf: str) -> DataFrame:
    return fuse(*_both(spark, sf), CONFIG).where("rank <= 20").select("qid", "id", F.coalesce("rank_vector", F.lit(0)).alias("rank_vector"), F.coalesce("rank_lexical", F.lit(0)).alias("rank_lexical"), "score", "rank")


def rrf_dedup_sources(spark: SparkSession, sf: str) -> DataFrame:
    hits = fuse(*_both(spark, sf), CONFIG).join(chunks(spark, sf).select("id", "url", "documento_id"), "id")
    return dedup_sources(hits, 5).select("qid", "id", "url", "score", "rank")


def retrieval_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Lexical hits of every other question are withheld, so these fall back to the vector ranking."""
    near, found = _both(spark, sf)
    return fuse(near, found.where("qid % 2 = 0"), CONFIG).where("rank <= 5").select("qid", "id", "mode", "rank")


def evidence_classify(spark: SparkSession, sf: str) -> DataFrame:
    _, classified, _ = engine(spark, sf).judge(questions(spark, sf))
    return classified.select("qid", "id", "rank", "evidence_class", F.round("term_coverage", 9).alias("term_coverage"), F.round("title_coverage", 9).alias("title_coverage"), "exact_phrase", "strong_partial")


def evidence_decision(spark: SparkSession, sf: str) -> DataFrame:
    _, _, decisions = engine(spark, sf).judge(questions(spark, sf))
    return decisions.select("qid", "n_sources", "n_direct", "n_partial", "n_weak", "n_strong_partial", "n_lexical", "n_covered", F.round("coverage", 9).alias("coverage"), "decision", "reason")


def ask(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: retrieval, evidence, context and answer of every question."""
    out = engine(spark, sf).ask(questions(spark, sf))
    return out.select("qid", "decision", "reason", "llm_skipped", F.size(F.coalesce("sources", F.array())).alias("n_public"), F.coalesce(F.array_join(F.transform("sources", lambda s: s["id"].cast("string")), ","), F.lit("")).alias("public_ids"))


def ask_answers(spark: SparkSession, sf: str) -> DataFrame:
    return engine(spark, sf).ask(questions(spark, sf)).select("qid", "answer", "llm_skipped", "used", "sources")


def context_pack(spark: SparkSession, sf: str) -> DataFrame:
    e = engine(spark, sf)
    _, classified, decisions = e.judge(questions(spark, sf))
    return pack_context(context_sources(classified, decisions, e.evidence), e.answer)


# --- SQL ------------------------------------------------------------------------------------------------------

_TOK = "regexp_extract_all(lower(strip_accents({0})), '[a-z0-9]+')"
_STOP = ", ".join(f"'{w}'" for w in sorted(STOPWORDS["shipped"]))
_DISTINCT = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"


def _tok(x: str) -> str:
    return _TOK.format(x)


#: d: chunks; q: questions with terms (no synonym occurs in them that has another entry than these tables hold).
_BASE = f"""
d AS (SELECT doc_id AS id, 'doc_' || doc_id AS documento_id, split_part(text, chr(10), 1) AS titulo, text AS texto, lang AS categoria, 'https://' || source || '.example/' AS url FROM documents),
tk AS (SELECT id, {_tok('titulo')} AS t1, {_tok('categoria')} AS t2, {_tok('texto')} AS t3 FROM d),
qt AS (SELECT item_id AS qid, {_tok('text')} AS t FROM benchmark),
q AS (SELECT qid, t, list_filter({_DISTINCT.format('t')}, lambda x: x NOT IN ({_STOP})) AS terms FROM qt)"""
_LEX = """
w AS (SELECT id, unnest(t1) AS term, 3.0 AS w FROM tk UNION ALL SELECT id, unnest(t2), 1.5 FROM tk UNION ALL SELECT id, unnest(t3), 1.0 FROM tk),
tf AS (SELECT id, term, sum(w)::DOUBLE AS tf FROM w GROUP BY ALL),
ln AS (SELECT id, 3.0::DOUBLE * len(t1) + 1.5::DOUBLE * len(t2) + 1.0::DOUBLE * len(t3) AS l FROM tk),
st AS (SELECT count(*)::DOUBLE AS n, avg(l) AS a FROM ln),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
lx0 AS (SELECT qid, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5::DOUBLE) / (tf + 1.5::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * l / a))), 9) AS score_lexical
  FROM (SELECT qid, unnest(terms) AS term FROM q) qq JOIN tf USING (term) JOIN df USING (term) JOIN ln USING (id), st GROUP BY qid, id),
lx AS (SELECT qid, id, score_lexical, row_number() OVER (PARTITION BY qid ORDER BY score_lexical DESC, id)::INTEGER AS rank_lexical FROM lx0 WHERE score_lexical > 0 QUALIFY rank_lexical <= 20)"""
_HASH = "('0x' || substr(md5(term), 1, 8))::BIGINT"


def _counts(rows: str, key: str) -> str:
    return f"SELECT {key}, {_HASH} % 64 AS d, sum(CASE WHEN ({_HASH} // 64) % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS v FROM {rows} GROUP BY ALL"


_VEC = f"""
dv AS ({_counts('(SELECT id, unnest(t3) AS term FROM tk)', 'id')}),
qv AS ({_counts('(SELECT qid, unnest(t) AS term FROM q)', 'qid')}),
dn AS (SELECT id, sum(v * v) AS n FROM dv GROUP BY id HAVING sum(v * v) > 0),
qn AS (SELECT qid, sum(v * v) AS n FROM qv GROUP BY qid HAVING sum(v * v) > 0),
vs AS (SELECT qn.qid, dn.id, round(coalesce(dot, 0) / sqrt(qn.n * dn.n), 9) AS score_vector FROM qn CROSS JOIN dn LEFT JOIN (SELECT qid, id, sum(qv.v * dv.v) AS dot FROM qv JOIN dv USING (d) GROUP BY qid, id) x ON x.qid = qn.qid AND x.id = dn.id),
vx AS (SELECT qid, id, score_vector, row_number() OVER (PARTITION BY qid ORDER BY score_vector DESC, id)::INTEGER AS rank_vector FROM vs QUALIFY rank_vector <= 20)"""
_RRF = """
fu AS (SELECT coalesce(vx.qid, lx.qid) AS qid, coalesce(vx.id, lx.id) AS id, score_vector, rank_vector, score_lexical, rank_lexical FROM vx FULL JOIN lx ON vx.qid = lx.qid AND vx.id = lx.id),
rf AS (SELECT *, CASE WHEN count(rank_lexical) OVER (PARTITION BY qid) > 0 THEN round(coalesce(1.0::DOUBLE / (60.0::DOUBLE + rank_vector), 0) + coalesce(2.0::DOUBLE / (60.0::DOUBLE + rank_lexical), 0), 12) ELSE score_vector END AS score FROM fu),
rk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, coalesce(rank_vector, 1000000000), coalesce(rank_lexical, 1000000000), id)::INTEGER AS rank FROM rf)"""
_DEDUP = """
s1 AS (SELECT rk.* EXCLUDE (rank), rank AS r0, url, titulo, texto, row_number() OVER (PARTITION BY qid, url ORDER BY rank) AS k FROM rk JOIN d USING (id)),
top AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY r0)::INTEGER AS rank FROM s1 WHERE k = 1 QUALIFY rank <= 5)"""
_EVID = f"""
e0 AS (SELECT top.*, terms, {_tok('titulo')} AS tt, {_tok('texto')} AS xt FROM top JOIN q USING (qid)),
e1 AS (SELECT *, list_filter(terms, lambda t: list_contains(tt, t) OR list_contains(xt, t)) AS cov, len(terms) AS nt,
  len(list_filter(terms, lambda t: list_contains(tt, t))) AS ct, len(list_filter(terms, lambda t: list_contains(xt, t))) AS cx,
  len(terms) > 0 AND (contains(array_to_string(tt, ' '), array_to_string(terms, ' ')) OR contains(array_to_string(xt, ' '), array_to_string(terms, ' '))) AS exact_phrase,
  rank_lexical IS NOT NULL AND coalesce(score_lexical, 0) > 0 AS lexical_hit, rank_vector IS NOT NULL AND coalesce(score_vector, 0) > 0 AS vector_hit FROM e0),
e2 AS (SELECT *, coalesce(len(cov)::DOUBLE / nullif(nt, 0), 0) AS term_coverage, coalesce(ct::DOUBLE / nullif(nt, 0), 0) AS title_coverage, coalesce(cx::DOUBLE / nullif(nt, 0), 0) AS text_coverage,
  lexical_hit AND coalesce(rank_lexical, 99) <= 10 AS top_l, vector_hit AND coalesce(rank_vector, 99) <= 5 AS top_v FROM e1),
e3 AS (SELECT *, CASE WHEN term_coverage >= 0.999 AND top_l AND (exact_phrase OR title_coverage >= 0.999 OR text_coverage >= 0.999) THEN 'direct'
  WHEN (term_coverage >= 0.6 AND (lexical_hit OR top_v)) OR (NOT lexical_hit AND top_v AND term_coverage > 0) THEN 'partial' ELSE 'weak' END AS evidence_class FROM e2),
e4 AS (SELECT *, evidence_class = 'partial' AND nt >= 2 AND len(cov) >= 2 AND term_coverage >= 0.8 AND lexical_hit AND coalesce(rank_lexical, 99) <= 3 AND rank <= 3
  AND (exact_phrase OR title_coverage >= 0.8 OR text_coverage >= 0.8 OR (nt >= 4 AND len(cov) >= 4 AND term_coverage >= 0.8 AND top_v AND lexical_hit AND coalesce(rank_lexical, 99) = 1 AND rank = 1))
  AND (top_v OR exact_phrase OR title_coverage >= 0.8) AS strong_partial FROM e3)"""
_DECIDE = """
a0 AS (SELECT qid, count(*) AS n_sources, count(*) FILTER (evidence_class = 'direct') AS n_direct, count(*) FILTER (evidence_class = 'partial') AS n_partial, count(*) FILTER (evidence_class = 'weak') AS n_weak,
  count(*) FILTER (strong_partial) AS n_strong_partial, count(*) FILTER (evidence_class <> 'weak' AND rank_lexical IS NOT NULL) AS n_lexical,
  len(list_distinct(flatten(list(cov) FILTER (evidence_class <> 'weak')))) AS n_covered FROM e4 GROUP BY qid),
b0 AS (SELECT qid, term_coverage AS bc, len(cov) AS bm, rank_lexical AS bl FROM e4 WHERE evidence_class = 'direct' OR strong_partial QUALIFY row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN evidence_class = 'direct' THEN 0 ELSE 1 END, rank) = 1),
c0 AS (SELECT q.qid, len(terms) AS nt, coalesce(n_sources, 0) AS n_sources, coalesce(n_direct, 0) AS n_direct, coalesce(n_partial, 0) AS n_partial, coalesce(n_weak, 0) AS n_weak, coalesce(n_strong_partial, 0) AS n_strong_partial, coalesce(n_lexical, 0) AS n_lexical, coalesce(n_covered, 0)::INTEGER AS n_covered, bc, bm, bl
  FROM q LEFT JOIN a0 USING (qid) LEFT JOIN b0 USING (qid)),
c1 AS (SELECT *, coalesce(n_covered::DOUBLE / nullif(nt, 0), 0) AS coverage FROM c0),
c2 AS (SELECT *, CASE WHEN n_sources = 0 THEN 'no_results' WHEN n_weak = n_sources THEN 'all_sources_weak'
  WHEN (n_direct >= 1 AND n_direct + n_strong_partial >= 2 AND coverage >= 0.6 AND n_lexical >= 1) OR (bc >= 0.8 AND bm >= 2 AND bl <= 3) THEN 'evidence_accepted'
  WHEN coverage < 0.6 THEN 'insufficient_term_coverage' WHEN n_direct < 1 THEN 'insufficient_direct_sources' WHEN n_direct + n_partial < 2 THEN 'insufficient_relevant_sources'
  WHEN n_lexical < 1 THEN 'ambiguous_matches' ELSE 'insufficient_relevant_sources' END AS reason FROM c1),
dec AS (SELECT *, CASE WHEN reason = 'evidence_accepted' THEN 'accepted' ELSE 'refused' END AS decision FROM c2)"""

_ALL = ",".join((_BASE, _LEX, _VEC, _RRF, _DEDUP, _EVID, _DECIDE))

SQL = {
    "bm25_topk": f"WITH {_BASE}, {_LEX} SELECT qid, id, score_lexical, rank_lexical FROM lx",
    "term_df": f"WITH {_BASE}, {_LEX} SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 9) AS idf FROM df, st",
    "doc_stats": f"WITH {_BASE}, {_LEX} SELECT id, l AS len FROM ln",
    "doc_tokens": f"WITH {_BASE} SELECT id, array_to_string(t3, ' ') AS tokens FROM tk",
    "query_terms": f"WITH c AS (SELECT conv_id, turn, list_filter({_tok('text')}, lambda x: x NOT IN ({_STOP})) AS t FROM conversations WHERE role = 'user') SELECT conv_id, turn, array_to_string({_DISTINCT.format('t')}, ' ') AS terms, len(t)::INTEGER AS n_tokens FROM c",
    "vector_topk": """WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT a.id AS qid, b.id, round(list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e) * list_inner_product(b.e, b.e)), 9) AS score_vector FROM v a, v b WHERE a.id % 10 = 0)
SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score_vector DESC, id)::INTEGER AS rank_vector FROM s QUALIFY rank_vector <= 20""",
    "embed_hash": f"WITH {_BASE}, {_VEC} SELECT id, d::INTEGER AS dim, v::BIGINT AS v FROM dv WHERE v <> 0",
    "hybrid_rrf": f"WITH {_BASE}, {_LEX}, {_VEC}, {_RRF} SELECT qid, id, coalesce(rank_vector, 0)::INTEGER AS rank_vector, coalesce(rank_lexical, 0)::INTEGER AS rank_lexical, score, rank FROM rk WHERE rank <= 20",
    "rrf_dedup_sources": f"WITH {_BASE}, {_LEX}, {_VEC}, {_RRF}, {_DEDUP} SELECT qid, id, url, score, rank FROM top",
    "retrieval_fallback": f"WITH {_BASE}, {_LEX.replace('WHERE score_lexical > 0 QUALIFY', 'WHERE score_lexical > 0 AND qid % 2 = 0 QUALIFY')}, {_VEC}, {_RRF} SELECT qid, id, CASE WHEN count(rank_lexical) OVER (PARTITION BY qid) > 0 THEN 'hybrid' ELSE 'hybrid_fallback_vector' END AS mode, rank FROM rk QUALIFY rank <= 5",
    "evidence_classify": f"WITH {_ALL} SELECT qid, id, rank, evidence_class, round(term_coverage, 9) AS term_coverage, round(title_coverage, 9) AS title_coverage, exact_phrase, strong_partial FROM e4",
    "evidence_decision": f"WITH {_ALL} SELECT qid, n_sources, n_direct, n_partial, n_weak, n_strong_partial, n_lexical, n_covered, round(coverage, 9) AS coverage, decision, reason FROM dec",
    "ask": f"""WITH {_ALL}, pub AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN evidence_class = 'direct' THEN 0 ELSE 1 END, rank) AS k FROM e4 JOIN dec USING (qid) WHERE evidence_class = 'direct' OR (decision = 'accepted' AND strong_partial)),
g AS (SELECT qid, count(*)::INTEGER AS n_public, string_agg(id::VARCHAR, ',' ORDER BY k) AS public_ids FROM pub GROUP BY qid)
SELECT qid, decision, reason, decision = 'refused' AS llm_skipped, coalesce(n_public, 0)::INTEGER AS n_public, coalesce(public_ids, '') AS public_ids FROM dec LEFT JOIN g USING (qid)""",
}

QUERIES = {
    "ask": ask, "ask_answers": ask_answers, "bm25_topk": bm25_topk, "term_df": term_df, "doc_stats": doc_stats, "doc_tokens": doc_tokens, "query_terms": query_terms_q, "vector_topk": vector_topk,
    "embed_hash": embed_hash, "hybrid_rrf": hybrid_rrf, "rrf_dedup_sources": rrf_dedup_sources, "retrieval_fallback": retrieval_fallback, "evidence_classify": evidence_classify,
    "evidence_decision": evidence_decision, "context_pack": context_pack,
}
