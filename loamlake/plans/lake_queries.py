"""Queries for loading, Silver, Gold, inventory and evaluation over the driver's tables, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamlake.functions import text as T
from loamlake.operators import evaluate, gold, inventory, silver
from loamlake.operators.chunks import chunk_documents
from loamlake.plans.driver_queries import read
from loamlake.sources import pages


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    title = F.substring_index("text", "\n", 1)
    return read(spark, sf, "documents").select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("documento_id"), title.alias("titulo"), F.col("lang").alias("categoria"),
        F.concat(F.lit("https://"), "source", F.lit(".example/"), F.col("doc_id").cast("string")).alias("url"), F.concat("source", F.when(F.col("doc_id") % 4 == 0, ".pdf").otherwise(".json")).alias("source_object"), F.col("text").alias("texto"),
    )


def doc_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunk_documents(_documents(spark, sf)).select("documento_id", "chunk_id", "texto")


def inventory_q(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.inventory(chunk_documents(_documents(spark, sf)))


def inventory_summary(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.inventory_summary(inventory_q(spark, sf))


def counts_by_type(spark: SparkSession, sf: str) -> DataFrame:
    return inventory_q(spark, sf).groupBy("source_type", "categoria").agg(F.count(F.lit(1)).alias("n"))


def pipeline_summary(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.pipeline_summary(chunk_documents(_documents(spark, sf)))


def manifest(spark: SparkSession, sf: str) -> DataFrame:
    docs = _documents(spark, sf)
    objects = docs.select(F.col("source_object").alias("object_name"), "documento_id", "url", T.source_type(F.col("source_object"), F.lit(None), F.col("url")).alias("source_type"))
    resolved = docs.where("pmod(length(texto), 10) = 0").select(F.col("documento_id").alias("original_documento_id"), "url", T.surrogate_id(T.normalize_url(F.col("url"))).alias("resolved_documento_id"))
    vectors = read(spark, sf, "embeddings").select(F.concat(F.lit("doc_"), F.col("vec_id").cast("string")).alias("documento_id"))
    return inventory.manifest(objects, resolved, chunk_documents(docs), vectors)


def manifest_summary(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.manifest_summary(manifest(spark, sf))


def quality_gate(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id", "left")
    url = F.when(F.col("doc_id") % 7 == 0, F.lit("ftp://x/")).when(F.col("doc_id") % 11 == 0, F.lit("")).otherwise(F.concat(F.lit("https://"), "source", F.lit(".example/")))
    issues = silver.quality_issues(phrases=("licensed under",), document_id=F.col("doc_id").cast("string"), title=F.substring_index("text", "\n", 1), published_at=F.when(F.col("quality") == 1, F.lit("2026-01-01")), category=F.col("lang"), url=url, text=F.col("text"))
    return d.select("doc_id", F.array_join(issues, ",").alias("issues"), (F.size(issues) == 0).alias("promotable"))


def canonical_hash(spark: SparkSession, sf: str) -> DataFrame:
    d = _documents(spark, sf)
    payload = T.canonical_json(document_id=F.col("documento_id"), title=F.col("titulo"), author=F.lit(""), published_at=F.lit(""), category=F.col("categoria"), url=F.col("url"), text=F.col("texto"))
    return d.select("documento_id", F.sha2(payload, 256).alias("canonical_sha256"), T.lineage_id(F.col("documento_id"), F.sha2(payload, 256)).alias("lineage_id"))


def line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "documents").select("doc_id", "text")
    return silver.dedup_lines_of(d, "doc_id", "text").select("doc_id", "text", F.col("removed").cast("long").alias("removed"))


def text_normalize(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "documents")
    return d.select("doc_id", T.normalize_markdown(F.col("text")).alias("markdown"), F.md5(T.text_identity(F.col("text"))).alias("identity"))


def exact_text_dups(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "documents").groupBy(T.text_identity(F.col("text")).alias("identity"))
    return d.agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1").select("first_id", "copies")


def safe_truncate(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", T.safe_truncate(F.col("text"), F.lit(200)).alias("short"))


def source_divergence(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbouring documents as the two sources of one article."""
    d = _documents(spark, sf).join(read(spark, sf, "documents").select("doc_id", F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("documento_id")), "documento_id")
    side = lambda rest: d.where(F.col("doc_id") % 2 == rest).select(F.concat(F.lit("a_"), F.floor(F.col("doc_id") / 2).cast("string")).alias("document_id"), F.col("titulo").alias("title"), F.lit("").alias("author"), F.lit("").alias("published_at"), F.col("categoria").alias("category"), F.lit("").alias("url"), F.col("texto").alias("text"), F.array(F.struct(F.when(F.col("doc_id") % 3 != 0, F.md5("categoria")).alias("source_content_sha256"))).alias("sources"))
    out = silver.divergence(side(0), side(1), with_similarity=False)
    return out.select("document_id", "classification", "length_difference", F.round("length_ratio", 6).alias("length_ratio"), F.coalesce(F.col("source_hash_match").cast("string"), F.lit("unknown")).alias("hash_match"), F.array_join("metadata_differences", ",").alias("metadata_differences"), F.array_join("structural_differences", ",").alias("structural_differences"))


def upsert_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as chunk records: two thirds are stored, half come again or for the first time."""
    o = read(spark, sf, "orders")
    rec = lambda df, tag: df.select(F.col("o_custkey").cast("string").alias("documento_id"), F.col("o_orderkey").cast("int").alias("chunk_id"), F.concat(F.lit(tag), F.col("o_orderpriority")).alias("texto"), F.col("o_orderstatus").alias("titulo"), *[F.lit(None).cast("string").alias(c) for c in gold.UPDATED[2:]])
    old_time, new_time = "2026-01-01 00:00:00", "2026-02-01 00:00:00"
    old = rec(o.where("o_orderkey % 3 <> 0"), "old ").withColumns({"id": F.col("chunk_id").cast("long"), "created_at": F.lit(old_time).cast("timestamp"), "updated_at": F.lit(old_time).cast("timestamp")})
    out = gold.merge(old, rec(o.where("o_orderkey % 2 = 0"), "new "), now=new_time)
    return out.select("documento_id", "chunk_id", "id", "texto", "titulo", "change", (F.col("created_at") == F.col("updated_at")).alias("fresh"))


def identity_collisions(spark: SparkSession, sf: str) -> DataFrame:
    """Pages load again under the ids of others."""
    p = read(spark, sf, "pages")
    stored = p.where("page_id % 2 = 0").select(F.concat(F.lit("p"), F.floor(F.col("page_id") / 4).cast("string")).alias("documento_id"), "url")
    incoming = p.select(F.concat(F.lit("p"), F.floor(F.col("page_id") / 3).cast("string")).alias("documento_id"), "url")
    return gold.resolve_collisions(incoming, stored)[1]


def url_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "pages").select("page_id", T.normalize_url(F.col("url")).alias("url"), T.crawl_url(F.col("url"), "https://site.example").alias("crawl_url"))


def page_links(spark: SparkSession, sf: str) -> DataFrame:
    """Every link of a page, and whether it leads to an article of the site."""
    hrefs = F.array_distinct(F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)"'), F.lit(1)))
    rows = read(spark, sf, "pages").select("page_id", F.posexplode(hrefs).alias("pos", "href"))
    full = T.crawl_url(F.concat("href", F.when(F.col("pos") % 2 == 0, "/a?x=1").otherwise("")), "https://site.example")
    return rows.select("page_id", "pos", full.alias("link"), T.is_article_url(full, "site.example").alias("article"))


def source_type_q(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("page_id") % 5 == 0, F.lit("json"))
    obj = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("x"), F.when(F.col("page_id") % 2 == 0, ".PDF").otherwise(".json")))
    return read(spark, sf, "pages").select("page_id", T.source_type(obj, kind, F.col("url")).alias("source_type"))


def page_extract(spark: SparkSession, sf: str) -> DataFrame:
    a = pages.extract_articles(read(spark, sf, "pages").select("page_id", "url", "html"))
    return a.select("page_id", "titulo", "autor", "data", "categoria", "url", F.length("conteudo").alias("html_chars"), "texto")


def page_titles(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "pages").select("page_id", pages.title_tag(F.col("html")).alias("title"), pages.canonical_link(F.col("html")).alias("canonical"))


def _cases(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents: good ones are answerable; a text over 1000 characters counts as accepted, its length as the rank."""
    d = read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id")
    rank = F.when(F.col("n_chars") % 7 < 5, (F.col("n_chars") % 7 + 1).cast("int"))
    return d.select("doc_id", (F.col("quality") == 1).alias("answerable"), (F.col("n_chars") > 1000).alias("accepted"), rank.alias("rank"))


def confusion_metrics(spark: SparkSession, sf: str) -> DataFrame:
    out = evaluate.confusion(_cases(spark, sf).withColumn("outcome", evaluate.outcome(F.col("answerable"), F.col("accepted"), F.col("rank"))))
    rates = [c for c in out.columns if c not in ("tp", "tn", "fp", "fn", "total")]
    return out.select("tp", "tn", "fp", "fn", "total", *[F.round(c, 9).alias(c) for c in rates])


def retrieval_metrics(spark: SparkSession, sf: str) -> DataFrame:
    out = evaluate.retrieval_metrics(_cases(spark, sf).where("answerable")).drop("ndcg_at_3")
    return out.select("total", *[F.round(c, 9).alias(c) for c in out.columns if c != "total"])


def latency_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Values of events by type and overall."""
    e = read(spark, sf, "events").select(F.explode(F.array(F.lit("all"), "event_type")).alias("group"), "value")
    out = evaluate.summaries(e, ["group"], "value")
    return out.select("group", "count", *[F.round(c, 6).alias(c) for c in out.columns if c not in ("group", "count")])


def pending_cases(spark: SparkSession, sf: str) -> DataFrame:
    cases, done = read(spark, sf, "benchmark").select(F.col("item_id").alias("id")), read(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    return evaluate.pending(cases, done)


def id_differences(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.id_differences(read(spark, sf, "benchmark").select(F.col("item_id").alias("id")), read(spark, sf, "labels").select(F.col("doc_id").alias("id")))


def url_status_summary(spark: SparkSession, sf: str) -> DataFrame:
    checks = read(spark, sf, "events").select(F.when(F.col("event_id") % 5 == 0, F.lit(None)).otherwise((200 + F.col("event_id") % 4 * 100).cast("int")).alias("status"))
    return inventory.url_status_summary(checks)


def staging_audit(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "documents").select("doc_id", F.col("text").alias("before"), T.squeeze(F.col("text")).alias("after"))
    return inventory.staging_audit(d).drop("before", "after")


def chunks_per_document(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.chunks_per_document(chunk_documents(_documents(spark, sf)))


# --- SQL -------------------------------------------------------------------------------------------------------

_WS = r"[\s\x0b\x{85}\x{a0}]"
_STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
_D = "d AS (SELECT doc_id, 'doc_' || doc_id AS documento_id, split_part(text, chr(10), 1) AS titulo, lang AS categoria, 'https://' || source || '.example/' || doc_id AS url, source || CASE WHEN doc_id % 4 = 0 THEN '.pdf' ELSE '.json' END AS source_object, text AS texto FROM documents)"
_CH = f"""b AS (SELECT *, {_STRIP.format('texto')} AS body FROM d),
w AS (SELECT *, unnest(range(CASE WHEN length(body) <= 1200 THEN 1 ELSE ceil((length(body) - 1200) / 1000.0)::BIGINT + 1 END)) AS i FROM b),
p AS (SELECT *, {_STRIP.format('substr(body, (i * 1000 + 1)::BIGINT, 1200)')} AS piece FROM w),
ch AS (SELECT * EXCLUDE (texto, body, piece), piece AS texto, row_number() OVER (PARTITION BY documento_id ORDER BY i)::INTEGER AS chunk_id FROM p WHERE piece <> '')"""
_INV = f"WITH {_D}, {_CH}, inv AS (SELECT documento_id, titulo, url, source_object, categoria, count(*) AS chunks, CASE WHEN source_object LIKE '%.pdf' THEN 'pdf' ELSE 'json' END AS source_type FROM ch GROUP BY ALL)"
_FOLD = "replace(replace(lower({0}), 'ß', 'ss'), 'ς', 'σ')"
_IDENT = _FOLD.format("regexp_replace(regexp_replace({0}, '\\s+', ' ', 'g'), '^ | $', '', 'g')")
_KEY = _FOLD.format("regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '^#{{1,6}}\\s+', ''), '\\[([^\\]]+)\\]\\([^)]+\\)', '\\1', 'g'), '[*_`]+', '', 'g'), '\\s+', ' ', 'g'), '^ | $', '', 'g')")
_NURL = "regexp_extract({0}, '^([A-Za-z]+):', 1).lower() || '://' || lower(regexp_extract({0}, '^[A-Za-z]+://([^/?#]*)', 1)) || CASE WHEN regexp_extract({0}, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract({0}, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) END || CASE WHEN len(list_filter(string_split(regexp_extract({0}, '\\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT lower(p) LIKE 'utm\\_%' ESCAPE '\\')) > 0 THEN '?' || array_to_string(list_transform(list_filter(string_split(regexp_extract({0}, '\\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT lower(p) LIKE 'utm\\_%' ESCAPE '\\'), lambda p: CASE WHEN contains(p, '=') THEN p ELSE p || '=' END), '&') ELSE '' END"
_CASES = "c AS (SELECT quality = 1 AS answerable, n_chars > 1000 AS accepted, CASE WHEN n_chars % 7 < 5 THEN n_chars % 7 + 1 END AS rank FROM documents JOIN labels USING (doc_id))"
_MAN = f"""WITH {_D}, {_CH}, r AS (SELECT documento_id, 'site_' || substr(sha256(url), 1, 16) AS rid FROM d WHERE length(texto) % 10 = 0),
o AS (SELECT source_object AS object_name, documento_id, url, CASE WHEN source_object LIKE '%.pdf' THEN 'pdf' ELSE 'json' END AS source_type, coalesce(rid, documento_id) AS resolved_id FROM d LEFT JOIN r USING (documento_id)),
tc AS (SELECT documento_id AS resolved_id, count(*) AS text_chunks FROM ch GROUP BY 1), vc AS (SELECT 'doc_' || vec_id AS resolved_id, count(*) AS vectors FROM embeddings GROUP BY 1),
man AS (SELECT resolved_id, object_name, documento_id, url, source_type, coalesce(text_chunks, 0) AS text_chunks, coalesce(vectors, 0) AS vectors FROM o LEFT JOIN tc USING (resolved_id) LEFT JOIN vc USING (resolved_id))"""


def _json(x: str) -> str:
    out = x
    for a, b in (("'\\'", "'\\\\'"), ("'\"'", "'\\\"'"), ("chr(10)", "'\\n'"), ("chr(9)", "'\\t'"), ("chr(13)", "'\\r'")):
        out = f"replace({out}, {a}, {b})"
    return f"'\"' || {out} || '\"'"


_PAYLOAD = " || ',' || ".join(f"'\"{k}\":' || {_json(v)}" for k, v in sorted({"document_id": "documento_id", "title": "titulo", "author": "''", "published_at": "''", "category": "categoria", "url": "url", "text": "texto"}.items()))

SQL = {
    "doc_chunks": f"WITH {_D}, {_CH} SELECT documento_id, chunk_id, texto FROM ch",
    "inventory": f"{_INV} SELECT * FROM inv",
    "inventory_summary": f"{_INV} SELECT sum(chunks)::BIGINT AS chunks, count(DISTINCT documento_id) AS documents, count(DISTINCT url) AS urls, count(DISTINCT source_object) AS source_objects FROM inv",
    "counts_by_type": f"{_INV} SELECT source_type, categoria, count(*) AS n FROM inv GROUP BY ALL",
    "pipeline_summary": f"WITH {_D}, {_CH} SELECT count(DISTINCT documento_id) AS documents, count(*) AS chunks, 0::BIGINT AS inserted, sum(length(texto))::BIGINT AS characters, count(DISTINCT source_object) AS objects FROM ch",
    "manifest": f"{_MAN} SELECT * FROM man",
    "manifest_summary": f"{_MAN} SELECT count(*) AS objects, count(*) FILTER (source_type = 'json') AS json, count(*) FILTER (source_type = 'pdf') AS pdf, count(DISTINCT url) AS urls, sum(text_chunks)::BIGINT AS text_chunks, sum(vectors)::BIGINT AS vectors, 0::BIGINT AS errors FROM man",
    "quality_gate": """WITH x AS (SELECT doc_id, text, trim(split_part(text, chr(10), 1), ' ' || chr(9)) AS title, CASE WHEN quality = 1 THEN '2026-01-01' ELSE '' END AS pub, lang, CASE WHEN doc_id % 7 = 0 THEN 'ftp://x/' WHEN doc_id % 11 = 0 THEN '' ELSE 'https://' || source || '.example/' END AS url FROM documents LEFT JOIN labels USING (doc_id)),
y AS (SELECT doc_id, list_filter([CASE WHEN title = '' THEN 'missing_title' END, CASE WHEN pub = '' THEN 'missing_published_at' END, CASE WHEN trim(lang) = '' THEN 'missing_category' END, CASE WHEN url = '' THEN 'missing_url' END, CASE WHEN trim(text, ' ' || chr(10)) = '' THEN 'missing_text' END,
  CASE WHEN url LIKE 'ftp%' THEN 'invalid_url' END, CASE WHEN contains(lower(text), 'licensed under') THEN 'known_boilerplate' END, CASE WHEN contains(text, chr(65533)) THEN 'unicode_replacement_character' END, CASE WHEN regexp_matches(text, '[\\x00-\\x08\\x0B-\\x1F\\x7F-\\x{9F}]') THEN 'invalid_control_character' END], lambda i: i IS NOT NULL) AS l FROM x)
SELECT doc_id, array_to_string(l, ',') AS issues, len(l) = 0 AS promotable FROM y""",
    "canonical_hash": f"WITH {_D}, h AS (SELECT documento_id, sha256('{{' || {_PAYLOAD} || '}}') AS s FROM d) SELECT documento_id, s AS canonical_sha256, 'silver:' || documento_id || ':' || substr(s, 1, 16) AS lineage_id FROM h",
    "line_dedup": f"""WITH l0 AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), l1 AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM l0), l2 AS (SELECT doc_id, pos, {_STRIP.format('line')} AS line FROM l1),
l3 AS (SELECT doc_id, pos, line, {_KEY.format('line')} AS k FROM l2 WHERE line <> ''), l4 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, CASE WHEN k = '' THEN chr(0) || pos ELSE k END ORDER BY pos) AS n FROM l3),
l5 AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) FILTER (n = 1) AS text, count(*) FILTER (n > 1) AS removed FROM l4 GROUP BY doc_id)
SELECT doc_id, coalesce(l5.text, '') AS text, coalesce(removed, 0)::BIGINT AS removed FROM documents LEFT JOIN l5 USING (doc_id)""",
    "text_normalize": f"""WITH a AS (SELECT doc_id, text, regexp_replace(regexp_replace(regexp_replace(text, '[ \\t]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g') AS m FROM documents),
n AS (SELECT doc_id, text, array_to_string(list_filter(list_transform(string_split(m, chr(10)), lambda x: trim(x)), lambda x: NOT regexp_matches(lower(x), '^(compartilhe:?|leia tamb[eé]m:?|veja tamb[eé]m:?|ou[cç]a:?|publicidade)$')), chr(10)) AS j FROM a)
SELECT doc_id, {_STRIP.format("regexp_replace(j, '\\n{3,}', chr(10) || chr(10), 'g')")} AS markdown, md5({_IDENT.format('text')}) AS identity FROM n""",
    "exact_text_dups": f"SELECT min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY {_IDENT.format('text')} HAVING count(*) > 1",
    "source_divergence": f"""WITH {_D}, x AS (SELECT doc_id, 'a_' || (doc_id // 2) AS document_id, regexp_replace(regexp_replace(titulo, '\\s+', ' ', 'g'), '^ | $', '', 'g') AS t, categoria AS c, regexp_replace(regexp_replace(texto, '\\s+', ' ', 'g'), '^ | $', '', 'g') AS s, CASE WHEN doc_id % 3 <> 0 THEN md5(categoria) END AS h FROM d),
y AS (SELECT a.document_id, length(b.s) - length(a.s) AS length_difference, length(a.s) AS la, round(least(length(a.s), length(b.s)) / greatest(length(a.s), length(b.s), 1), 6) AS length_ratio, CASE WHEN b.h IS NOT NULL THEN b.h IS NOT DISTINCT FROM a.h END AS m, array_to_string(list_filter([CASE WHEN a.t <> b.t THEN 'title' END, CASE WHEN a.c <> b.c THEN 'category' END], lambda i: i IS NOT NULL), ',') AS metadata_differences FROM x a JOIN x b USING (document_id) WHERE a.doc_id % 2 = 0 AND b.doc_id % 2 = 1)
SELECT document_id, CASE WHEN coalesce(m, false) AND metadata_differences = '' THEN 'equivalent' ELSE 'major' END AS classification, length_difference::INTEGER AS length_difference, length_ratio, coalesce(m::VARCHAR, 'unknown') AS hash_match, metadata_differences, CASE WHEN abs(length_difference) > greatest(200, floor(la * 0.02)) THEN 'text_length' ELSE '' END AS structural_differences FROM y""",
    "upsert_merge": """WITH o AS (SELECT o_custkey::VARCHAR AS documento_id, o_orderkey::INTEGER AS chunk_id, o_orderpriority AS p, o_orderstatus AS titulo FROM orders), m AS (SELECT *, chunk_id % 3 <> 0 AS old, chunk_id % 2 = 0 AS new FROM o WHERE chunk_id % 3 <> 0 OR chunk_id % 2 = 0),
n AS (SELECT documento_id, chunk_id, row_number() OVER (ORDER BY substr(md5(documento_id || '|' || chunk_id), 1, 3), documento_id, chunk_id) + (SELECT max(chunk_id) FROM m WHERE old) AS id FROM m WHERE NOT old)
SELECT documento_id, chunk_id, coalesce(n.id, chunk_id)::BIGINT AS id, CASE WHEN new THEN 'new ' ELSE 'old ' END || p AS texto, titulo, CASE WHEN NOT old THEN 'inserted' WHEN new THEN 'updated' ELSE 'kept' END AS change, NOT (old AND new) AS fresh FROM m LEFT JOIN n USING (documento_id, chunk_id)""",
    "identity_collisions": f"""WITH p AS (SELECT page_id, {_NURL.format('url')} AS u FROM pages), s AS (SELECT DISTINCT 'p' || (page_id // 4) AS i, u FROM p WHERE page_id % 2 = 0), n AS (SELECT 'p' || (page_id // 3) AS i, u FROM p)
SELECT DISTINCT i AS original_documento_id, 'site_' || substr(sha256(u), 1, 16) AS resolved_documento_id, u AS url FROM n WHERE i IN (SELECT i FROM s) AND (i, u) NOT IN (SELECT i, u FROM s)""",
    "url_normalize": f"SELECT page_id, {_NURL.format('url')} AS url, regexp_replace(url, '[?#].*$', '') AS crawl_url FROM pages",
    "page_links": """WITH h AS (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS a FROM pages), u AS (SELECT page_id, list_filter(a, lambda x, i: list_position(a, x) = i) AS a FROM h), r AS (SELECT page_id, unnest(a) AS href, generate_subscripts(a, 1) - 1 AS pos FROM u),
f AS (SELECT page_id, pos::INTEGER AS pos, 'https://site.example' || regexp_replace(regexp_replace(href || CASE WHEN pos % 2 = 0 THEN '/a?x=1' ELSE '' END, '#.*$', ''), '\\?.*$', '') AS link FROM r)
SELECT page_id, pos, link, len(string_split(trim(substr(link, 21), '/'), '/')) >= 2 AND NOT list_has_any(string_split(trim(substr(link, 21), '/'), '/'), ['editorias', 'tag', 'category', 'author', 'page', 'wp-content', 'feed', 'home-atualidades', 'todas-as-noticias', 'noticias']) AS article FROM f""",
    "source_type": "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN CASE WHEN page_id % 2 = 0 THEN 'pdf' ELSE 'json' END WHEN page_id % 5 = 0 THEN 'json' WHEN lower(regexp_replace(url, '\\?.*$', '')) LIKE '%.pdf' THEN 'pdf' WHEN lower(regexp_replace(url, '\\?.*$', '')) LIKE '%.json' THEN 'json' ELSE 'unknown' END AS source_type FROM pages",
    "page_titles": "SELECT page_id, regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g'), '^ | $', '', 'g') AS title, '' AS canonical FROM pages",
    "confusion_metrics": f"""WITH {_CASES}, o AS (SELECT count(*) FILTER (answerable AND accepted AND rank IS NOT NULL)::DOUBLE AS tp, count(*) FILTER (NOT answerable AND NOT accepted)::DOUBLE AS tn, count(*) FILTER (NOT answerable AND accepted)::DOUBLE AS fp, count(*) FILTER (answerable AND NOT (accepted AND rank IS NOT NULL))::DOUBLE AS fn FROM c),
r AS (SELECT *, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall, tn / nullif(tn + fp, 0) AS specificity FROM o)
SELECT tp::BIGINT AS tp, tn::BIGINT AS tn, fp::BIGINT AS fp, fn::BIGINT AS fn, (tp + tn + fp + fn)::BIGINT AS total, round((tp + tn) / (tp + tn + fp + fn), 9) AS accuracy, round(precision, 9) AS precision, round(recall, 9) AS recall, round(specificity, 9) AS specificity, round(fp / nullif(fp + tn, 0), 9) AS false_positive_rate, round(fn / nullif(fn + tp, 0), 9) AS false_negative_rate, round(2 * precision * recall / nullif(precision + recall, 0), 9) AS f1_score, round((recall + specificity) / 2, 9) AS balanced_accuracy FROM r""",
    "retrieval_metrics": f"WITH {_CASES}, a AS (SELECT rank FROM c WHERE answerable) SELECT count(*) AS total, " + ", ".join(f"round(count(*) FILTER (rank <= {k}) / count(*)::DOUBLE, 9) AS {m}_at_{k}" for m in ("hit_rate", "recall") for k in (1, 3, 5)) + ", round(sum(1.0::DOUBLE / rank) / count(*), 9) AS mrr FROM a",
    "latency_summary": """WITH e AS (SELECT unnest(['all', event_type]) AS "group", value FROM events) SELECT "group", count(value) AS count, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(min(value), 6) AS min, round(max(value), 6) AS max, round(stddev_pop(value), 6) AS stdev, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.95), 6) AS p95 FROM e GROUP BY "group" """,
    "pending_cases": "SELECT item_id AS id FROM benchmark WHERE item_id NOT IN (SELECT doc_id FROM labels)",
    "id_differences": "SELECT DISTINCT item_id AS id, 'without_truth' AS side FROM benchmark WHERE item_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT DISTINCT doc_id, 'without_question' FROM labels WHERE doc_id NOT IN (SELECT item_id FROM benchmark)",
    "url_status_summary": "WITH s AS (SELECT CASE WHEN event_id % 5 = 0 THEN NULL ELSE 200 + event_id % 4 * 100 END AS s FROM events) SELECT count(*) AS total, count(*) FILTER (s >= 200 AND s < 300) AS ok, count(*) FILTER (s >= 300 AND s < 400) AS redirects, count(*) FILTER (s >= 400) AS failed, count(*) FILTER (s IS NULL) AS unanswered FROM s",
    "staging_audit": "WITH a AS (SELECT doc_id, text AS b, regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '^ | $', '', 'g') AS a FROM documents) SELECT doc_id, length(b)::INTEGER AS chars_before, length(a)::INTEGER AS chars_after, (length(b) - length(a))::INTEGER AS chars_removed, len(list_filter(string_split(a, chr(10) || chr(10)), lambda p: trim(p) <> ''))::INTEGER AS paragraphs, (length(a) - length(replace(a, chr(65533), '')))::INTEGER AS replacement_chars FROM a",
    "chunks_per_document": f"WITH {_D}, {_CH} SELECT documento_id, count(*) AS chunks FROM ch GROUP BY documento_id",
    "safe_truncate": f"""WITH s AS (SELECT doc_id, text, {_STRIP.format('substr(text, 1, 200)').replace('^\\s+|', '')} AS c FROM documents),
r AS (SELECT *, greatest(CASE WHEN contains(c, '. ') THEN length(c) - instr(reverse(c), ' .') - 1 ELSE -1 END, CASE WHEN contains(c, chr(10)) THEN length(c) - instr(reverse(c), chr(10)) ELSE -1 END, CASE WHEN contains(c, ' ') THEN length(c) - instr(reverse(c), ' ') ELSE -1 END) AS b FROM s)
SELECT doc_id, CASE WHEN length(text) <= 200 THEN text WHEN b >= 100 THEN regexp_replace(substr(c, 1, b), '\\s+$', '') ELSE c END AS short FROM r""",
}

QUERIES = {
    "doc_chunks": doc_chunks, "inventory": inventory_q, "inventory_summary": inventory_summary, "counts_by_type": counts_by_type, "pipeline_summary": pipeline_summary, "manifest": manifest,
    "manifest_summary": manifest_summary, "quality_gate": quality_gate, "canonical_hash": canonical_hash, "line_dedup": line_dedup, "text_normalize": text_normalize, "exact_text_dups": exact_text_dups,
    "safe_truncate": safe_truncate, "source_divergence": source_divergence, "upsert_merge": upsert_merge, "identity_collisions": identity_collisions, "url_normalize": url_normalize, "page_links": page_links,
    "source_type": source_type_q, "page_extract": page_extract, "page_titles": page_titles, "confusion_metrics": confusion_metrics, "retrieval_metrics": retrieval_metrics, "latency_summary": latency_summary,
    "pending_cases": pending_cases, "id_differences": id_differences, "url_status_summary": url_status_summary, "staging_audit": staging_audit, "chunks_per_document": chunks_per_document,
}
