"""Queries for sources, sinks, pages, cleaning and evaluation, over articles and pages that are made from the driver's tables.

Each builds its inputs from whole tables in a way that makes the right result plain, so that SQL can state it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamlake.functions import editorial
from loamlake.functions import text as T
from loamlake.operators import evaluate, gold, inventory, silver
from loamlake.operators.context import REFUSAL, pack_context, source_cards
from loamlake.operators.evidence import context_sources, public_sources
from loamlake.operators.vector import payload_id
from loamlake.plans.driver_queries import SQL as DRIVER_SQL
from loamlake.plans.driver_queries import _ALL, _BASE, _DEDUP, _LEX, _RRF, _VEC, _tok, chunks, engine, questions, read
from loamlake.plans.benchmark import run_cases
from loamlake.plans.diagnostics import log_lines
from loamlake.plans.engine import public_metrics
from loamlake.plans.load import LoadRequest, run_pipeline
from loamlake.plans.lake_queries import _FOLD, _IDENT, _STRIP
from loamlake.sources import bronze, pages, pdf, sinks
from loamlake.sources.scratch import scratch


def _id() -> Column:
    return F.col("doc_id").cast("string")


def _letters(text: Column) -> Column:
    """Words of A-Z only, so that no rule of cleaning has anything to do."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z]+", " "))


_LETTERS = "trim(regexp_replace(coalesce(text, ''), '[^A-Za-z]+', ' ', 'g'))"


def _pick(n: int, *values: str | None, by: str = "doc_id") -> Column:
    """The value at doc_id modulo n."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(by) % n).cast("int") + 1)


# --- text functions --------------------------------------------------------------------------------------------


def text_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Keys of first lines that carry heading marks, a link, emphasis and invisible characters."""
    first = F.substring_index("text", "\n", 1)
    block = F.concat(F.lit("##  **"), first, F.lit("** [Mais​](http://x.y/z)!"))
    d = read(spark, sf, "documents").select("doc_id", first.alias("first"), block.alias("block"))
    return d.select(
        "doc_id", T.editorial_key(F.col("block")).alias("editorial"), T.comparable_heading(F.col("block")).alias("heading"), T.semantic_text(F.col("block")).alias("semantic"),
        T.clean_author(F.concat(F.lit(" Por "), F.col("first"), F.lit("** "))).alias("author"), T.paragraph_count(F.concat_ws("\n\n", "first", F.lit(" "), "block")).alias("paragraphs"),
        T.safe_pdf_name(F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("__"), F.lit("a b/"), _id(), _pick(3, "", "", ".PDF")))).alias("file"),
    )


def synonym_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Questions of a term that has synonyms and the language of a document."""
    q = F.concat_ws(" ", F.lit("O que sobre"), _pick(8, "Covid", "docente", "ALUNO", "usp", "IA", "pesquisa", "ESALQ", "fmrp"), "lang")
    return read(spark, sf, "documents").select("doc_id", F.array_join(T.expand_terms(T.query_terms(q)), " ").alias("terms"))


def pdf_keywords(spark: SparkSession, sf: str) -> DataFrame:
    words = F.concat(F.lit("Canonical-ID="), _id(), F.lit("; a = b=c ;;=x;skipped;lang="), "lang", F.when(F.col("doc_id") % 2 == 0, ";lang=last").otherwise(""))
    m = T.pdf_keywords(words)
    return read(spark, sf, "documents").select("doc_id", m["Canonical-ID"].alias("id"), m["a"].alias("a"), m["lang"].alias("lang"), F.size(m).alias("n"))


def repaired_text(spark: SparkSession, sf: str) -> DataFrame:
    """First lines whose accents were decoded wrongly, with entities: repaired they are as before."""
    first = F.regexp_replace(F.substring_index("text", "\n", 1), "&", "+")
    broken = F.decode(F.encode(first, "UTF-8"), "ISO-8859-1")
    kept = F.when(broken.rlike("[\u0080-\u009f]"), first).otherwise(broken)
    return read(spark, sf, "documents").select("doc_id", T.repair_exact(F.concat(kept, F.lit(" &amp; &lt;x&gt;"))).alias("text"))


# --- cleaning ----------------------------------------------------------------------------------------------------

NOTICE = "As opiniões expressas nos artigos publicados são de inteira responsabilidade de seus autores."
POLICY = "Política de uso: a reprodução de matérias é livre; fotos devem ser creditadas."


def refine_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Texts with a repeated title, a byline, notices and a policy around a body."""
    some = lambda n, block: F.when(F.col("doc_id") % n == 0, F.lit(block) if isinstance(block, str) else block)
    title = F.concat(F.lit("Título "), _id())
    body = F.concat(F.lit("Corpo "), _letters(F.col("text")))
    blocks = F.concat_ws("\n \t\n\n", some(2, F.concat(F.lit("## **Titulo** "), _id(), F.lit("!"))), some(3, "Por Ana Lima, do campus"), body, F.concat(F.lit("Fim "), _id()), some(7, "---"), some(7, POLICY), some(5, NOTICE), some(10, F.concat(F.lit("*"), F.lit(NOTICE), F.lit("*"))))
    d = read(spark, sf, "documents").select("doc_id", editorial.refined(blocks, title, F.lit("Ana Lima")).alias("r"))
    return d.select("doc_id", "r.text", F.array_join(F.transform("r.removals", lambda x: x["rule"]), ",").alias("rules"))


_PAGE_BODY = '<h2>Parte <i>x</i></h2><p>{0} <b>fim</b> <a href="http://x.y/z">ali</a>.</p><ul><li>um</li><li>dois</li></ul><nav>menu</nav><!-- c --><p>Leia também:</p>'


def _built_pages(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, url, html): articles whose fields stand in every place that extraction knows."""
    d = read(spark, sf, "documents").select("doc_id", F.concat(F.repeat(F.lit("palavra "), 40), _letters(F.col("text"))).alias("b"))
    before, after = _PAGE_BODY.split("{0}")
    content = F.concat(F.lit(before), "b", F.lit(after))
    head = F.concat(F.lit("<html><head><title> T "), _id(), F.lit(" </title>"), _pick(3, '<meta property="og:title" content=" OG ">', "", ""), _pick(5, '<meta property="article:published_time" content="2026-01-02">', "", "", "", ""), _pick(4, "", "<meta name='author' content='Por Bia Sá*'>", "", ""), F.lit("</head><body>"))
    lead = F.concat(
        _pick(3, "", "<h1>H <i>um</i></h1>", ""), _pick(5, "", "<span class='x entry-date'> 3/2/26 </span>", "<time datetime='2026-03-04'>ontem</time>", "<p>Em 05/03/2026.</p>", ""),
        _pick(4, "<p class=autor>Por Ana Lima</p>", "", "<div class=entry-meta>Por Rui Sá 05/03/2026</div>", ""), _pick(3, "<a rel='category tag' href='/c'>Ciências</a>", "<div class=breadcrumb><a href='/'>Home</a></div>", ""),
    )
    main = F.when(F.col("doc_id") % 4 == 3, F.lit("<main>curto</main>")).otherwise(
        F.concat(F.lit("<main>"), lead, _pick(4, "<div class='entry-content'>", "<div class='post-content wide'>", "<div class=elementor><div class='elementor-widget-text-editor'><div class='elementor-widget-container'>", ""), content, _pick(4, "</div>", "</div>", "</div></div></div>", ""), F.lit("</main>"))
    )
    url = F.concat(F.lit("https://s.example/"), _pick(2, "ciencias/", "nova-area/"), _id())
    return d.select("doc_id", url.alias("url"), F.concat(head, main, F.lit("</body></html>")).alias("html"))


def page_articles(spark: SparkSession, sf: str) -> DataFrame:
    return pages.extract_articles(_built_pages(spark, sf)).select("doc_id", "titulo", "autor", "data", "categoria", "texto", "url")


def listing_links(spark: SparkSession, sf: str) -> DataFrame:
    """Listing pages of post elements, or of headings only; addresses of sections are no articles."""
    section = _pick(4, "ciencias/", "tag/", "nova-area/", "page/")
    anchor = F.concat(F.lit("<a href='/"), section, F.lit("n-"), _id(), F.lit("?x=1#y'>A</a>"))
    post = F.concat(F.lit("<article class='post z'>"), anchor, F.lit("<a href='/b/c'>B</a></article>"))
    html = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("<main>"), post, post, F.lit("<article class=post><a href='https://o.example/a/b'>O</a></article></main><h3><a href='/h/i'>H</a></h3>"))).otherwise(F.concat(F.lit("<h3>"), anchor, F.lit("</h3><h3><a href='https://s.example/x/y/'>X</a></h3>")))
    found = pages.extract_links(read(spark, sf, "documents").select("doc_id", html.alias("html")), "https://s.example")
    return found.select("doc_id", F.array_join("links", ",").alias("links"))


def canonical_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Titles and canonical links of pages, the link written in either order of its attributes or missing."""
    link = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("<link rel='canonical' class=a href='"), "url", F.lit("'>"))).when(F.col("page_id") % 3 == 1, F.concat(F.lit('<LINK href="'), "url", F.lit('" rel="canonical">'))).otherwise(F.lit("<link rel='next' href='x'>"))
    p = read(spark, sf, "pages").select("page_id", F.concat(link, "html").alias("html"))
    return p.select("page_id", pages.title_tag(F.col("html")).alias("title"), pages.canonical_link(F.col("html")).alias("canonical"))


def titled_text(spark: SparkSession, sf: str) -> DataFrame:
    """A heading before texts that don't begin with it."""
    first = F.substring_index("text", "\n", 1)
    title = T.strip(F.when(F.col("doc_id") % 2 == 0, first).otherwise(F.concat(F.lit("Outro "), _id())))
    return read(spark, sf, "documents").select("doc_id", F.md5(silver.with_title(T.strip(F.col("text")), title)).alias("titled"))


# --- PDF and reconciliation --------------------------------------------------------------------------------------


def _pdf_sources(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select(
        F.concat(F.lit("a_"), F.lpad(_id(), 6, "0")).alias("document_id"), F.concat(F.lit("Documento "), _id(), F.lit(" (ação)")).alias("titulo"), F.col("source").alias("autor"), F.lit("2026-01-01").alias("data"), F.col("lang").alias("categoria"),
        F.concat(F.lit("https://s.example/"), "lang", F.lit("/"), _id()).alias("url"), F.col("text").alias("conteudo_texto"), F.sha2("text", 256).alias("source_sha"),
    )


def pdf_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as a PDF and read again: identity, metadata, and whether all of its text came back."""
    source = _pdf_sources(spark, sf)
    path = F.concat("document_id", F.lit(".pdf")).alias("path")
    # every PDF that was made comes back, be it with an error, so none needs to be made twice to tell
    back = pdf.pdf_articles(pdf.article_pdfs(source).where("error is null").select(path, "content"))
    flat = lambda c: F.regexp_replace(c, r"(?U)\s+", "")
    met = source.select(path, "conteudo_texto").join(back, F.col("path") == F.col("object_name"), "left")
    return met.select(F.substring_index("path", ".", 1).alias("id"), F.col("object_name").isNotNull().alias("made"), "document_id", "title", "author", "url", "source_content_sha256", F.contains(flat(F.col("text")), flat(F.col("conteudo_texto"))).alias("whole"), "error")


def pdf_problems(spark: SparkSession, sf: str) -> DataFrame:
    """What is wrong with PDFs of which some belong to another article, are empty or have no signature."""
    source = _pdf_sources(spark, sf).where("length(trim(conteudo_texto)) > 0")
    made = pdf.article_pdfs(source).select("document_id", "content")
    number = F.substring("document_id", 3, 6).cast("int")
    content = F.when(number % 4 == 1, F.lit(b"")).when(number % 4 == 2, F.lit(b"no PDF")).otherwise(F.col("content"))
    told = pdf.decode_pdfs(F.col("content"))
    return made.select("document_id", content.alias("content")).select("document_id", told.alias("p")).select("document_id", F.coalesce("p.error", F.lit("")).alias("error"), (F.col("p.pages") > 0).alias("pages"))


def _twins(spark: SparkSession, sf: str, side: str) -> DataFrame:
    """Canonical documents of short texts; the PDF side differs by doc_id: not, by a word, by its hash, by having none."""
    text = F.trim(F.repeat(F.concat("lang", F.lit(" "), "source", F.lit(" "), _id(), F.lit(" ")), (F.col("doc_id") % 20 + 1).cast("int")))
    sha = F.md5("text")
    if side == "pdf":
        text = F.when(F.col("doc_id") % 4 == 1, F.concat(text, F.lit(" acrescimo"))).otherwise(text)
        sha = F.when(F.col("doc_id") % 4 == 0, sha).when(F.col("doc_id") % 4 == 2, F.lit("other"))
    name = F.concat(F.lit("a_"), _id())
    d = read(spark, sf, "documents").select(
        name.alias("document_id"), F.concat(F.lit("T "), _id()).alias("title"), F.lit("Ana").alias("author"), F.lit("2026").alias("published_at"), F.col("lang").alias("category"), F.lit("https://s.example/a").alias("url"), text.alias("text"),
        F.concat(name, F.lit(f".{side}")).alias("object_name"), F.md5(name).alias("binary_sha256"), sha.alias("source_content_sha256"),
    )
    return silver.canonical(d, side)


def reconciled_sources(spark: SparkSession, sf: str) -> DataFrame:
    out = silver.reconcile(_twins(spark, sf, "json"), _twins(spark, sf, "pdf"))
    return out.select("document_id", "divergence.classification", "divergence.text_similarity", "promotable", F.array_join(F.transform("sources", lambda s: s["object_name"]), ",").alias("objects"), F.element_at("transformations", -1).alias("last_step"), F.array_join("quality_issues", ",").alias("issues"))


def pdf_canonical(spark: SparkSession, sf: str) -> DataFrame:
    """A PDF alone is never promoted."""
    return _twins(spark, sf, "pdf").select("document_id", "promotable", F.array_join("quality_issues", ",").alias("issues"), "primary_source")


# --- files and tables ----------------------------------------------------------------------------------------------


def _nation_articles(spark: SparkSession, sf: str) -> DataFrame:
    n = read(spark, sf, "nation")
    return n.select(F.col("n_name").alias("titulo"), F.lit(None).cast("string").alias("autor"), F.lit("2026").alias("data"), F.col("n_regionkey").cast("string").alias("categoria"), F.concat(F.lit("<p>"), "n_name", F.lit("</p>")).alias("conteudo"), F.concat(F.lit("https://s.example/n/"), F.col("n_nationkey").cast("string")).alias("url"))


def bronze_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Articles as numbered JSON files, published and read again."""
    folder = scratch(spark)
    sinks.publish_files(sinks.article_files(_nation_articles(spark, sf)), folder)
    return bronze.read_articles(spark, folder, ("json",))


def publish_status(spark: SparkSession, sf: str) -> DataFrame:
    """Files published twice, of which the second time some have changed."""
    folder = scratch(spark)
    files = read(spark, sf, "nation").select(F.concat("n_name", F.lit(".json")).alias("object_name"), F.encode(F.concat(F.lit("{\"n\": "), F.col("n_nationkey").cast("string"), F.lit("}")), "UTF-8").alias("content")).withColumn("object_name", F.translate("object_name", " ", "_"))
    one = sinks.publish_files(files, folder).withColumn("run", F.lit(1))
    changed = files.withColumn("content", F.when(F.length("object_name") % 2 == 0, F.encode(F.lit("{}"), "UTF-8")).otherwise(F.col("content")))
    return one.unionByName(sinks.publish_files(changed, folder).withColumn("run", F.lit(2)))


def upload_status(spark: SparkSession, sf: str) -> DataFrame:
    """Objects of several suffixes put under their prefixes; empty ones and others are refused."""
    folder = scratch(spark)
    key = F.col("n_nationkey")
    files = read(spark, sf, "nation").select(F.concat(F.lit("o"), key.cast("string"), _pick(3, ".json", ".pdf", ".txt", by="n_nationkey")).alias("object_name"), F.when(key % 5 == 0, F.lit(b"")).otherwise(F.lit(b"{}")).alias("content"))
    out = sinks.upload(files, folder)
    return out.select("object_name", "size", "status", F.substring("target", len(folder) + 2, 1000).alias("target"))


def strict_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Strict loading: reasons of each rejected file, none for the others."""
    folder = scratch(spark)
    key = F.col("n_nationkey")
    field = lambda name, value, missing: F.when(key % missing != missing - 1, value).alias(name)
    body = F.to_json(F.struct(field("titulo", F.when(key % 4 == 3, F.lit(" ")).otherwise(F.col("n_name")), 99), F.lit("").alias("autor"), F.lit("x").alias("data"), field("categoria", F.lit("c"), 5), F.lit("texto").alias("conteudo_texto"), F.when(key % 6 == 5, F.lit("ftp://x")).otherwise(F.lit("https://s.example/x")).alias("url")))
    name = F.when(key % 7 == 6, F.concat(F.lit("x"), key.cast("string"))).otherwise(F.concat(F.lit("news_"), F.lpad(key.cast("string"), 6, "0")))
    sinks.publish_files(read(spark, sf, "nation").select(F.concat(name, F.lit(".json")).alias("object_name"), F.encode(body, "UTF-8").alias("content")), folder)
    good, bad = bronze.strict_articles(spark, folder)
    return good.select("object_name", F.lit("").alias("reasons")).unionByName(bad.select("object_name", F.array_join("reasons", ",").alias("reasons")))


def jsonl_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers written as JSON lines and read again."""
    folder = scratch(spark)
    n = sinks.write_jsonl(read(spark, sf, "supplier").withColumn("note", F.lit(None).cast("string")), folder)
    back = bronze.read_jsonl(spark, folder, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double, note string")
    return back.select("s_suppkey", "s_name", "s_nationkey", "s_acctbal", F.lit(n).alias("written"))


def gold_tables(spark: SparkSession, sf: str) -> DataFrame:
    """A table made where it is missing and upserted twice; ids and changes of the second time."""
    name = f"gold_{scratch(spark)[-32:]}"
    made = gold.ensure_table(spark, name)
    rec = lambda df, tag: gold.cast_chunks(df.select(F.col("s_nationkey").cast("string").alias("documento_id"), F.col("s_suppkey").cast("int").alias("chunk_id"), F.concat(F.lit(tag), "s_name").alias("texto")))
    s = read(spark, sf, "supplier")
    gold.upsert(spark, name, rec(s.where("s_suppkey % 2 = 0"), "old "))
    changed = gold.upsert(spark, name, rec(s.where("s_suppkey % 3 = 0"), "new ")).select("documento_id", "chunk_id", "change")
    return spark.table(name).join(changed, ["documento_id", "chunk_id"], "left").select("documento_id", "chunk_id", "texto", F.coalesce("change", F.lit("kept")).alias("change"), F.lit(made).alias("made"))


def vector_points(spark: SparkSession, sf: str) -> DataFrame:
    """Points merged into stored ones; nulls leave the payload, which names the row of a point."""
    e = read(spark, sf, "embeddings").select("vec_id", "embedding")
    point = lambda df, tag: df.select(F.col("vec_id").alias("id"), "embedding", F.create_map(F.lit("tag"), F.lit(tag), F.lit("postgres_id"), F.when(F.col("vec_id") % 2 == 0, (F.col("vec_id") + 1000).cast("string"))).alias("payload"))
    stored = gold.upsert_vectors(spark.createDataFrame([], gold.VECTORS_DDL), point(e.where("vec_id % 3 <> 0"), "old"), 64).drop("change")
    out = gold.upsert_vectors(stored, point(e.where("vec_id % 5 = 0"), "new"), 64)
    return out.select("id", F.element_at("payload", F.lit("tag")).alias("tag"), F.size("payload").alias("n_payload"), payload_id(F.col("payload"), F.col("id")).alias("row_id"), "change")


def restructured_articles(spark: SparkSession, sf: str) -> DataFrame:
    """Articles whose bodies repeat title and byline, with their text beside what they had."""
    d = read(spark, sf, "documents")
    before, after = _PAGE_BODY.split("{0}")
    title = F.concat(F.lit("Título "), _id())
    html = F.concat(F.lit("<h1>"), title, F.lit("</h1><p>Por Ana Lima</p>"), F.lit(before), F.concat(F.lit("palavra "), _letters(F.col("text"))), F.lit(after))
    out = bronze.restructure(d.select("doc_id", title.alias("titulo"), F.lit("Ana Lima").alias("autor"), html.alias("conteudo")))
    return out.select("doc_id", (F.col("conteudo_html") == F.col("conteudo")).alias("same"), "conteudo_texto")


def boilerplate_removed(spark: SparkSession, sf: str) -> DataFrame:
    """Texts with a share-bar link, and some that end with the block of a programme on air."""
    block = F.when(F.col("doc_id") % 3 == 0, F.lit("\n---\n\n**Programa no Ar**\n\n[Programa no Ar](https://s.example/radio/) no ar veiculado pela Rede Exemplo, de segunda\n\na sexta")).otherwise(F.lit(""))
    text = F.concat(F.lit("[Pular barra de compartilhamento]( #main-content )\n"), F.lit("Corpo "), _letters(F.col("text")), block)
    return read(spark, sf, "documents").select("doc_id", T.strip(T.remove_boilerplate(text)).alias("text"))


def _validated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, len(whole), pdf.AT_ONCE):
            ids, wrong = [], []
            for r in whole.slice(at, pdf.AT_ONCE).to_pylist():
                number = int(r["document_id"][2:])
                wanted = r["document_id"] if number % 3 else "a_other"
                ids.append(r["document_id"])
                wrong.append(",".join(pdf.validate(pdf.article_pdf(r, r["document_id"], r["source_sha"]), r, wanted, r["source_sha"])))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(wrong, pa.string())], names=["document_id", "wrong"])


def pdf_validation(spark: SparkSession, sf: str) -> DataFrame:
    """PDFs held against their articles; a third are claimed for another document."""
    source = _pdf_sources(spark, sf).where(F.col("conteudo_texto").rlike(r"(?U)\S"))
    return source.mapInArrow(_validated, "document_id string, wrong string")


def load_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Files loaded into text and vector tables twice; the second time nothing is new."""
    folder = scratch(spark)
    sinks.publish_files(sinks.article_files(_nation_articles(spark, sf)), folder)
    tag = folder[-32:]
    request = LoadRequest(folder, chunks_table=f"chunks_{tag}", vectors_table=f"vectors_{tag}")
    one, two = (run_pipeline(spark, request).first() for _ in range(2))
    for t in (request.chunks_table, f"{request.chunks_table}__changes", request.vectors_table):
        spark.sql(f"DROP TABLE IF EXISTS {t}")
    return spark.createDataFrame([(n, *(r[c] for c in ("documents", "chunks", "inserted", "objects", "vectors", "message"))) for n, r in ((1, one), (2, two))], "run int, documents long, chunks long, inserted long, objects long, vectors long, message string")


def audit_csv(spark: SparkSession, sf: str) -> DataFrame:
    """An audit with nested columns as CSV, read again."""
    folder = scratch(spark)
    sinks.write_audit_csv(read(spark, sf, "supplier").select("s_suppkey", F.concat("s_name", F.lit(', "x"')).alias("name"), F.array(F.col("s_nationkey"), F.lit(1)).alias("l"), F.create_map(F.lit("k"), "s_name").alias("m")), folder)
    return spark.read.option("header", "true").option("escape", '"').csv(folder)


def staged_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Two tables put in place together; then a set of which one fails leaves both as they were."""
    tag = scratch(spark)[-32:]
    a, b = f"staged_a_{tag}", f"staged_b_{tag}"
    n = read(spark, sf, "nation")
    gold.stage_all(spark, {a: n.select("n_nationkey"), b: n.select("n_name")})
    failed = False
    try:
        gold.stage_all(spark, {a: n.limit(1).select("n_nationkey"), b: n.select(F.raise_error(F.lit("no")).alias("n_name"))})
    except PySparkException:
        failed = True
    return spark.table(a).agg(F.count(F.lit(1)).alias("a"), F.lit(spark.table(b).count()).alias("b"), F.lit(failed).alias("failed"), F.lit(spark.catalog.tableExists(f"{a}__staging")).alias("left_over"))


def metadata_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Fields of documents that differ from those of an earlier state, nulls included."""
    d = read(spark, sf, "documents").select("doc_id", "lang", "source", F.when(F.col("doc_id") % 7 != 0, F.col("n_chars")).alias("n_chars"))
    other = d.withColumns({"lang": F.when(F.col("doc_id") % 5 == 0, F.lit("xx")).otherwise(F.col("lang")), "source": F.when(F.col("doc_id") % 11 != 0, F.col("source"))})
    return inventory.metadata_audit(d, other, "doc_id", ["lang", "source", "n_chars"]).select("doc_id", F.array_join("differing", ",").alias("differing"), "verdict")


# --- retrieval -----------------------------------------------------------------------------------------------------


def search_modes(spark: SparkSession, sf: str) -> DataFrame:
    """The best five sources of every question by one ranking alone, and where one of them is switched off."""
    e, q = engine(spark, sf), questions(spark, sf)
    pick = lambda mode: e.search(q, 20, mode).select(F.lit(mode).alias("asked"), "mode", "qid", "id", "rank")
    return pick("vector").unionByName(pick("lexical"))


_HOST = r"://(.*)\.example\."


def fallback_questions(spark: SparkSession, sf: str) -> DataFrame:
    """Questions of the names of hosts: those that no document holds fall back to the vector ranking."""
    e = engine(spark, sf)
    q = read(spark, sf, "pages").select(F.col("page_id").alias("qid"), F.concat(F.lit("? "), F.coalesce(F.regexp_extract("url", _HOST, 1), F.lit(""))).alias("question"))
    return e.search(q, 5).select("qid", "id", "mode", "rank")


def question_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """The public measures of every question."""
    _, _, decisions = engine(spark, sf).judge(questions(spark, sf))
    return public_metrics(decisions).select("qid", F.explode("metrics").alias("metric", "v")).where("metric <> 'n_distinct_sources'").select("qid", "metric", F.round("v", 9).alias("v"))


def context_texts(spark: SparkSession, sf: str) -> DataFrame:
    """The packed context of every accepted question."""
    e = engine(spark, sf)
    _, classified, decisions = e.judge(questions(spark, sf))
    packed = pack_context(context_sources(classified, decisions, e.evidence), e.answer)
    return packed.select("qid", "context", F.array_join(F.transform("used", lambda i: i.cast("string")), ",").alias("used"))


def answers(spark: SparkSession, sf: str) -> DataFrame:
    """The extractive answer to every accepted question; the others get the refusal."""
    out = engine(spark, sf).ask(questions(spark, sf))
    return out.select("qid", "answer", "llm_skipped", F.array_join(F.transform("used", lambda i: i.cast("string")), ",").alias("used"))


def diagnostic_lines(spark: SparkSession, sf: str) -> DataFrame:
    """What a log says of every question and its candidates."""
    _, classified, decisions = engine(spark, sf).judge(questions(spark, sf))
    return log_lines(classified, decisions)


def cards(spark: SparkSession, sf: str) -> DataFrame:
    """The sources that a caller may see, as cards."""
    e = engine(spark, sf)
    _, classified, decisions = e.judge(questions(spark, sf))
    return source_cards(public_sources(classified, decisions, e.evidence))


def benchmark_results(spark: SparkSession, sf: str) -> DataFrame:
    """A benchmark run: every item a case that expects the address of the first source by name."""
    first = read(spark, sf, "documents").agg(F.min("source")).first()[0]
    none = F.lit(None).cast("string")
    cases = read(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.lit("json").alias("categoria"), F.col("text").alias("pergunta"), none.alias("document_id_esperado"), F.lit(f"https://{first}.example/").alias("url_esperada"), none.alias("source_object_esperado"))
    out = run_cases(engine(spark, sf), cases)
    return out.select("id", "status_http", "evidence_sufficient", "ollama_skipped", "reason", F.size("fontes").alias("n_sources"), F.col("expected_rank").cast("int").alias("expected_rank"), F.array_join(F.transform("fontes", lambda f: f["document_id"]), ",").alias("ids"))


def point_lookup(spark: SparkSession, sf: str) -> DataFrame:
    ids = read(spark, sf, "benchmark").select(F.col("item_id").alias("id"))
    return gold.by_ids(chunks(spark, sf), ids).select("id", "documento_id", "titulo", "url")


def paired_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers and as many vectors by their positions."""
    s = read(spark, sf, "supplier").select((F.col("s_suppkey") - F.lit(1)).alias("position"), "s_name")
    v = read(spark, sf, "embeddings").select(F.col("vec_id").alias("position"), "embedding").join(s.select("position"), "position", "left_semi")
    return gold.zip_positions(s.join(v.select("position"), "position", "left_semi"), v).select("position", "s_name", F.round(F.element_at("embedding", 1).cast("double"), 6).alias("x"))


def staging_checks(spark: SparkSession, sf: str) -> DataFrame:
    """A staging table of whole documents as chunks, with repeated keys."""
    c = read(spark, sf, "documents").select((F.col("doc_id") % 100).cast("string").alias("documento_id"), (F.col("doc_id") / 200).cast("int").alias("chunk_id"), F.col("text").alias("texto"))
    return gold.staging_checks(c, 100)


# --- evaluation ----------------------------------------------------------------------------------------------------


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id")


def case_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Broken rules of benchmark cases made from labelled documents."""
    d = _labelled(spark, sf)
    blank = F.lit("")
    values = {
        "id": F.when(F.col("doc_id") % 50 == 0, F.lit("same")).otherwise(_id()), "categoria": F.col("lang"), "pergunta": F.when(F.col("doc_id") % 11 == 0, blank).otherwise(F.lit("p")), "answerable": F.when(F.col("doc_id") % 13 != 0, F.col("quality") == 1),
        "review_status": _pick(3, "approved", "pending", "odd"), "trecho_referencia": F.when(F.col("doc_id") % 2 == 0, blank).otherwise(F.lit("t")), "document_id_esperado": blank, "url_esperada": F.when(F.col("doc_id") % 9 == 0, blank).otherwise(F.lit("u")),
    }
    cases = d.select(*[values.get(c, blank).alias(c) for c in evaluate.CASE_FIELDS])
    return evaluate.case_violations(cases).groupBy("violation").agg(F.count(F.lit(1)).alias("n"))


def case_results(spark: SparkSession, sf: str) -> DataFrame:
    """Cases joined with their results: where the expected source stands among five, and the outcome."""
    d = _labelled(spark, sf)
    cases = d.select(_id().alias("id"), F.lit("approved").alias("review_status"), (F.col("quality") == 1).alias("answerable"), F.when(F.col("doc_id") % 3 == 0, F.lit("d2")).alias("want_d"), F.when(F.col("doc_id") % 3 == 1, F.lit("u4")).alias("want_u"), F.lit("").alias("want_o"))
    sources = F.array(*[F.struct(F.lit(f"d{i}").alias("document_id"), F.lit(f"u{i}").alias("url"), F.lit("").alias("source_object")) for i in range(1, 6)])
    results = d.select(_id().alias("id"), F.lit(200).alias("status_http"), (F.col("n_chars") > 1000).alias("accepted"), sources.alias("fontes"))
    both = evaluate.joined(cases, results)
    rank = evaluate.source_rank(F.col("r.fontes"), F.col("want_d"), F.col("want_u"), F.col("want_o"))
    return both.withColumn("rank", rank).select("id", F.col("rank").cast("int").alias("rank"), evaluate.outcome(F.col("answerable"), F.col("r.accepted"), F.col("rank")).alias("outcome"))


def result_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Latencies by overlapping groups of results."""
    d = read(spark, sf, "events")
    r = d.select(F.when(F.col("event_id") % 4 == 0, "json").when(F.col("event_id") % 4 == 1, "pdf").when(F.col("event_id") % 4 == 2, "fora_do_corpus").otherwise("x").alias("categoria"), (F.col("event_id") % 3 == 0).alias("ollama_skipped"), F.create_map(F.lit("total"), "value", F.lit("other"), F.lit(0.0)).alias("metrics"))
    out = evaluate.latency_summary(r, ["total"])
    return out.select("group", "field", "count", *[F.round(c, 6).alias(c) for c in out.columns if c not in ("group", "field", "count")])


def human_marks(spark: SparkSession, sf: str) -> DataFrame:
    marks = F.create_map(*[x for i, f in enumerate(evaluate.QUALITY_FIELDS) for x in (F.lit(f), ((F.col("event_id") + i) % 3).cast("int"))])
    out = evaluate.human_quality(read(spark, sf, "events").select(F.when(F.col("event_id") % 4 != 0, marks).alias("human_evaluation")))
    return out.select("total", *[F.round(f, 9).alias(f) for f in evaluate.QUALITY_FIELDS])


def pass_counts(spark: SparkSession, sf: str) -> DataFrame:
    """How many answers meet what was expected of them, by kind of question."""
    d = _labelled(spark, sf)
    r = d.select(F.col("lang").alias("kind"), (F.col("quality") == 1).alias("expect_accepted"), (F.col("n_chars") > 1000).alias("accepted"), F.when(F.col("doc_id") % 10 != 0, F.lit(200)).otherwise(F.lit(503)).alias("status_http"), (F.col("n_chars") > 1500).cast("int").alias("n_sources"))
    return evaluate.pass_counts(r, "kind")


def metric_texts(spark: SparkSession, sf: str) -> DataFrame:
    v = F.when(F.col("event_id") % 3 != 0, F.round("value", 4))
    return read(spark, sf, "events").select("event_id", evaluate.format_metric(v).alias("shown"))


# --- SQL ---------------------------------------------------------------------------------------------------------

_SQ = "trim(regexp_replace({0}, '[\\s]+', ' ', 'g'))"
_FL = "split_part(text, chr(10), 1)"
_WORDS = {
    "covid": "covid covid19 coronavirus", "docente": "docente professor professora", "aluno": "aluno estudante graduando graduanda", "ia": "ia inteligencia artificial", "pesquisa": "pesquisa estudo cientifico cientifica pesquisador pesquisadores",
    "esalq": "esalq escola superior de agricultura luiz queiroz", "fmrp": "fmrp faculdade de medicina ribeirao preto",
}
_TERMS = " ".join(f"WHEN {i} THEN '{_WORDS.get(w, '')}'" for i, w in enumerate(("covid", "docente", "aluno", "usp", "ia", "pesquisa", "esalq", "fmrp")))
_STOPPED = "('a', 'as', 'da', 'de', 'do', 'e', 'em', 'no', 'na', 'o', 'os')"
_NUM = "n_nationkey"


def _pack(k: int) -> str:
    """The k-th document of each question added to its context; a document without room ends it."""
    last = "SELECT qid, '' AS text, [] :: BIGINT[] AS used, false AS done FROM (SELECT DISTINCT qid FROM cn)" if k == 1 else f"SELECT qid, text, used, done FROM k{k - 1}"
    boundary = "greatest(CASE WHEN contains(c, '. ') THEN length(c) - instr(reverse(c), ' .') - 1 ELSE -1 END, CASE WHEN contains(c, chr(10)) THEN length(c) - instr(reverse(c), chr(10)) ELSE -1 END, CASE WHEN contains(c, ' ') THEN length(c) - instr(reverse(c), ' ') ELSE -1 END)"
    return f"""
l{k} AS ({last}),
h{k} AS (SELECT l.*, id, body, CASE WHEN l.text <> '' THEN chr(10) || chr(10) ELSE '' END || '[' || (len(l.used) + 1) || '] ' || title || chr(10) AS head FROM l{k} l LEFT JOIN (SELECT * FROM cn WHERE k = {k}) USING (qid)),
r{k} AS (SELECT *, 6000 - length(text) - length(head) AS room FROM h{k}),
c{k}c AS (SELECT *, CASE WHEN room > 0 THEN regexp_replace(substr(body, 1, room), '\\s+$', '') END AS c FROM r{k}),
b{k} AS (SELECT *, CASE WHEN length(body) <= room THEN body WHEN {boundary} >= room // 2 THEN regexp_replace(substr(c, 1, {boundary}), '\\s+$', '') ELSE c END AS content FROM c{k}c),
k{k} AS (SELECT qid, CASE WHEN ok THEN text || head || content ELSE text END AS text, CASE WHEN ok THEN list_append(used, id) ELSE used END AS used, done OR coalesce(room <= 0, false) AS done FROM (SELECT *, coalesce(room > 0 AND NOT done AND content <> '', false) AS ok FROM b{k}))"""


_CONTEXT = f"""{_ALL},
cs AS (SELECT qid, id, titulo, {_STRIP.format('texto')} AS body, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN evidence_class = 'direct' THEN 0 ELSE 1 END, rank) AS cr FROM e4 JOIN dec USING (qid) WHERE decision = 'accepted' AND (evidence_class = 'direct' OR strong_partial)),
cu AS (SELECT * FROM cs WHERE body <> '' QUALIFY row_number() OVER (PARTITION BY qid, {_IDENT.format('body')} ORDER BY cr) = 1),
cn AS (SELECT qid, id, CASE WHEN titulo <> '' THEN titulo ELSE 'Sem título' END AS title, body, row_number() OVER (PARTITION BY qid ORDER BY cr) AS k FROM cu QUALIFY k <= 3),{",".join(map(_pack, (1, 2, 3)))}"""
_WORD = "list_distinct(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]+'))"
_PAGE_QUESTIONS = _BASE.replace(f"SELECT item_id AS qid, {_tok('text')} AS t FROM benchmark", "SELECT page_id AS qid, " + _tok(f"regexp_extract(url, '{_HOST}', 1)") + " AS t FROM pages")

SQL = {
    "text_keys": f"""WITH d AS (SELECT doc_id, {_FL} AS f FROM documents), k AS (SELECT *, {_FOLD.format("f || ' Mais' || chr(8203) || '!'")} AS low FROM d)
SELECT doc_id, trim(regexp_replace(replace(strip_accents({_FOLD.format("replace(replace(f, '*', ''), chr(92), '') || ' Mais' || chr(8203) || '!'")}), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')) AS editorial,
 {_FOLD.format(_SQ.format("'**' || f || '** Mais!'"))} AS heading, {_SQ.format("'##  **' || f || '** [Mais](http://x.y/z)!'")} AS semantic,
 {_STRIP.format("regexp_replace(regexp_replace(f, '^\\s+', ''), '[*]+$', '')")} AS author, ((CASE WHEN regexp_matches(f, '\\S') THEN 1 ELSE 0 END) + 1)::INTEGER AS paragraphs,
 CASE doc_id % 3 WHEN 0 THEN 'documento.pdf' WHEN 1 THEN 'a_b_' || doc_id || '.pdf' ELSE 'a_b_' || doc_id || '.PDF' END AS file FROM k""",
    "synonym_terms": f"SELECT doc_id, trim(CASE doc_id % 8 {_TERMS} END || CASE WHEN lang IN {_STOPPED} THEN '' ELSE ' ' || lang END) AS terms FROM documents",
    "pdf_keywords": "SELECT doc_id, doc_id::VARCHAR AS id, 'b=c' AS a, CASE WHEN doc_id % 2 = 0 THEN 'last' ELSE lang END AS lang, 3 AS n FROM documents",
    "repaired_text": f"SELECT doc_id, replace({_FL}, '&', '+') || ' & <x>' AS text FROM documents",
    "refine_blocks": f"""SELECT doc_id, 'Corpo ' || {_LETTERS} || chr(10) || chr(10) || 'Fim ' || doc_id AS text, array_to_string(list_filter([CASE WHEN doc_id % 2 = 0 THEN 'duplicate_leading_title' END, CASE WHEN doc_id % 3 = 0 THEN 'duplicate_byline' END,
 CASE WHEN doc_id % 5 = 0 THEN 'generic_opinion_notice' END, CASE WHEN doc_id % 10 = 0 THEN 'generic_opinion_notice' END, CASE WHEN doc_id % 7 = 0 THEN 'generic_reuse_credits' END, CASE WHEN doc_id % 7 = 0 THEN 'generic_reuse_separator' END], lambda x: x IS NOT NULL), ',') AS rules
FROM (SELECT doc_id, text FROM documents)""".replace("'Corpo ' || " + _LETTERS, f"trim('Corpo ' || {_LETTERS})"),
    "page_articles": f"""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'OG' WHEN doc_id % 3 = 1 AND doc_id % 4 <> 3 THEN 'Hum' ELSE 'T ' || doc_id END AS titulo,
 CASE doc_id % 4 WHEN 0 THEN 'Ana Lima' WHEN 1 THEN 'Bia Sá' WHEN 2 THEN 'Rui Sá' ELSE '' END AS autor,
 CASE WHEN doc_id % 5 = 0 THEN '2026-01-02' WHEN doc_id % 4 = 3 THEN '' WHEN doc_id % 5 = 1 THEN '3/2/26' WHEN doc_id % 5 = 2 THEN '2026-03-04' WHEN doc_id % 5 = 3 OR doc_id % 4 = 2 THEN '05/03/2026' ELSE '' END AS data,
 CASE WHEN doc_id % 3 = 0 AND doc_id % 4 <> 3 THEN 'Ciências' WHEN doc_id % 2 = 0 THEN 'Ciências' ELSE 'Nova Area' END AS categoria,
 CASE WHEN doc_id % 4 = 3 THEN '' ELSE '## Parte *x*' || chr(10) || chr(10) || trim(repeat('palavra ', 40) || {_LETTERS}) || ' **fim** [ali](http://x.y/z).' || chr(10) || chr(10) || '- um' || chr(10) || '- dois' END AS texto,
 'https://s.example/' || CASE WHEN doc_id % 2 = 0 THEN 'ciencias/' ELSE 'nova-area/' END || doc_id AS url FROM documents""",
    "listing_links": """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'https://s.example/' || CASE doc_id % 4 WHEN 0 THEN 'ciencias/' ELSE 'nova-area/' END || 'n-' || doc_id ELSE 'https://s.example/x/y/' END AS links FROM documents""",
    "canonical_pages": "SELECT page_id, regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g'), '^ | $', '', 'g') AS title, CASE WHEN page_id % 3 < 2 THEN url ELSE '' END AS canonical FROM pages",
    "titled_text": f"""WITH d AS (SELECT doc_id, {_STRIP.format('text')} AS t, {_STRIP.format(f"CASE WHEN doc_id % 2 = 0 THEN {_FL} ELSE 'Outro ' || doc_id END")} AS title FROM documents),
l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: {_STRIP.format('x')} <> '')[1:3] AS ls FROM d)
SELECT doc_id, md5({_STRIP.format("CASE WHEN title <> '' AND NOT list_contains(list_transform(ls, lambda x: " + _IDENT.format("regexp_replace(x, '^#{{1,6}}\\s+', '')").replace("{{", "{").replace("}}", "}") + "), " + _IDENT.format("title") + ") THEN '# ' || title || CASE WHEN t <> '' THEN chr(10) || chr(10) ELSE '' END ELSE '' END || t")}) AS titled FROM l""",
    "pdf_round_trip": f"""SELECT 'a_' || lpad(doc_id::VARCHAR, 6, '0') AS id, ok AS made, CASE WHEN ok THEN 'a_' || lpad(doc_id::VARCHAR, 6, '0') END AS document_id, CASE WHEN ok THEN 'Documento ' || doc_id || ' (ação)' END AS title, CASE WHEN ok THEN source END AS author,
 CASE WHEN ok THEN 'https://s.example/' || lang || '/' || doc_id END AS url, CASE WHEN ok THEN sha256(text) END AS source_content_sha256, CASE WHEN ok THEN true END AS whole, NULL::VARCHAR AS error FROM (SELECT *, regexp_matches(coalesce(text, ''), '\\S') AS ok FROM documents)""",
    "pdf_problems": "SELECT 'a_' || lpad(doc_id::VARCHAR, 6, '0') AS document_id, CASE doc_id % 4 WHEN 1 THEN 'the PDF is empty' WHEN 2 THEN 'the PDF signature is missing' ELSE '' END AS error, doc_id % 4 IN (0, 3) AS pages FROM documents WHERE regexp_matches(text, '\\S')",
    "reconciled_sources": """WITH d AS (SELECT doc_id, length(trim(repeat(lang || ' ' || source || ' ' || doc_id || ' ', (doc_id % 20 + 1)::BIGINT))) AS n FROM documents), s AS (SELECT *, CASE WHEN doc_id % 4 = 1 THEN round(2 * n / (2 * n + 10)::DOUBLE, 6) ELSE 1.0 END AS sim FROM d),
c AS (SELECT *, CASE doc_id % 4 WHEN 0 THEN 'equivalent' WHEN 2 THEN 'major' ELSE CASE WHEN sim >= 0.98 THEN 'minor' ELSE 'major' END END AS cl FROM s)
SELECT 'a_' || doc_id AS document_id, cl AS classification, sim AS text_similarity, cl <> 'major' AS promotable, 'a_' || doc_id || '.json,a_' || doc_id || '.pdf' AS objects, 'validate_against_pdf' AS last_step, CASE WHEN cl = 'major' THEN 'major_json_pdf_divergence' ELSE '' END AS issues FROM c""",
    "pdf_canonical": "SELECT 'a_' || doc_id AS document_id, false AS promotable, CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'pdf_without_source_hash,' END || 'pdf_requires_json_authority' AS issues, 'pdf' AS primary_source FROM documents",
    "bronze_round_trip": """WITH n AS (SELECT *, 'https://s.example/n/' || n_nationkey AS url FROM nation), r AS (SELECT *, 'article_' || lpad((row_number() OVER (ORDER BY substr(md5(url), 1, 3), url))::VARCHAR, 6, '0') AS o FROM n)
SELECT o AS documento_id, o || '.json' AS source_object, n_name AS titulo, '' AS autor, '2026' AS data, n_regionkey::VARCHAR AS categoria, '<p>' || n_name || '</p>' AS conteudo, url FROM r""",
    "publish_status": """WITH o AS (SELECT replace(n_name, ' ', '_') || '.json' AS o FROM nation) SELECT o AS object_name, 'generated' AS status, 1 AS run FROM o UNION ALL SELECT o, CASE WHEN length(o) % 2 = 0 THEN 'regenerated' ELSE 'unchanged' END, 2 FROM o""",
    "upload_status": f"""WITH o AS (SELECT 'o' || {_NUM} || ['.json', '.pdf', '.txt'][{_NUM} % 3 + 1] AS o, CASE WHEN {_NUM} % 5 = 0 THEN 0 ELSE 2 END AS size, {_NUM} % 3 AS k FROM nation)
SELECT o AS object_name, size, CASE WHEN k = 2 THEN 'rejected_suffix' WHEN size = 0 THEN 'rejected_empty' ELSE 'uploaded' END AS status, CASE k WHEN 0 THEN 'raw/' || o WHEN 1 THEN 'raw/pdf/' || o END AS target FROM o""",
    "strict_sources": f"""SELECT CASE WHEN {_NUM} % 7 = 6 THEN 'x' || {_NUM} ELSE 'news_' || lpad({_NUM}::VARCHAR, 6, '0') END || '.json' AS object_name, array_to_string(list_filter([CASE WHEN {_NUM} % 7 = 6 THEN 'object_name' END, CASE WHEN {_NUM} % 5 = 4 THEN 'missing_categoria' END, CASE WHEN {_NUM} % 4 = 3 THEN 'empty_titulo' END, CASE WHEN {_NUM} % 6 = 5 THEN 'url' END], lambda x: x IS NOT NULL), ',') AS reasons FROM nation""",
    "jsonl_round_trip": "SELECT s_suppkey, s_name, s_nationkey, s_acctbal, count(*) OVER () AS written FROM supplier",
    "gold_tables": """SELECT s_nationkey::VARCHAR AS documento_id, s_suppkey::INTEGER AS chunk_id, CASE WHEN s_suppkey % 3 = 0 THEN 'new ' ELSE 'old ' END || s_name AS texto, CASE WHEN s_suppkey % 3 <> 0 THEN 'kept' WHEN s_suppkey % 2 = 0 THEN 'updated' ELSE 'inserted' END AS change, true AS made FROM supplier WHERE s_suppkey % 2 = 0 OR s_suppkey % 3 = 0""",
    "vector_points": """SELECT vec_id AS id, CASE WHEN vec_id % 5 = 0 THEN 'new' ELSE 'old' END AS tag, CASE WHEN vec_id % 2 = 0 THEN 2 ELSE 1 END AS n_payload, CASE WHEN vec_id % 2 = 0 THEN vec_id + 1000 ELSE vec_id END AS row_id, CASE WHEN vec_id % 5 <> 0 THEN 'kept' WHEN vec_id % 3 <> 0 THEN 'updated' ELSE 'inserted' END AS change FROM embeddings WHERE vec_id % 3 <> 0 OR vec_id % 5 = 0""",
    "search_modes": f"""WITH {_BASE}, {_LEX}, {_VEC}, m AS (SELECT 'vector' AS asked, qid, id, rank_vector AS r FROM vx UNION ALL SELECT 'lexical', qid, id, rank_lexical FROM lx), u AS (SELECT m.*, row_number() OVER (PARTITION BY asked, qid, url ORDER BY r) AS k FROM m JOIN d USING (id))
SELECT asked, asked AS mode, qid, id, row_number() OVER (PARTITION BY asked, qid ORDER BY r)::INTEGER AS rank FROM u WHERE k = 1 QUALIFY rank <= 5""",
    "question_metrics": DRIVER_SQL["evidence_decision"].split("SELECT qid, n_sources")[0] + """, u AS (UNPIVOT (SELECT qid, n_sources::DOUBLE AS n_sources, n_direct::DOUBLE AS n_direct, n_partial::DOUBLE AS n_partial, n_weak::DOUBLE AS n_weak, n_strong_partial::DOUBLE AS n_strong_partial, n_lexical::DOUBLE AS n_lexical, n_covered::DOUBLE AS n_covered, coverage FROM dec) ON COLUMNS(* EXCLUDE (qid)) INTO NAME metric VALUE v) SELECT qid, metric, round(v, 9) AS v FROM u""",
    "fallback_questions": f"WITH {_PAGE_QUESTIONS}, {_LEX}, {_VEC}, {_RRF}, {_DEDUP}, mo AS (SELECT qid, count(rank_lexical) AS c FROM rk GROUP BY qid) SELECT qid, id, CASE WHEN c > 0 THEN 'hybrid' ELSE 'hybrid_fallback_vector' END AS mode, rank FROM top JOIN mo USING (qid)",
    "context_texts": f"WITH {_CONTEXT} SELECT qid, text AS context, array_to_string(used, ',') AS used FROM k3",
    "answers": f"""WITH {_CONTEXT},
pt AS (SELECT qid, string_split_regex(regexp_replace(k3.text, '([.!?])\\s+', '\\1' || chr(1), 'g'), '\\x01|\\n+') AS ps FROM k3),
pu AS (SELECT qid, unnest(list_filter(list_transform(ps, lambda x: {_STRIP.format('x')}), lambda x: x <> '' AND NOT regexp_matches(x, '^\\[[0-9]+\\] '))) AS part FROM pt),
pi AS (SELECT qid, part, row_number() OVER (PARTITION BY qid) AS i FROM pu),
ps AS (SELECT pi.*, len(list_intersect({_WORD.format('part')}, {_WORD.format('b.text')})) AS score FROM pi JOIN benchmark b ON b.item_id = qid),
pk AS (SELECT * FROM ps QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, i) <= 2),
an AS (SELECT qid, string_agg(part, ' ' ORDER BY i) AS answer FROM pk GROUP BY qid)
SELECT dec.qid, CASE WHEN decision = 'accepted' THEN coalesce(answer, '') ELSE '{REFUSAL}' END AS answer, decision = 'refused' AS llm_skipped, coalesce(array_to_string(used, ','), '') AS used FROM dec LEFT JOIN an USING (qid) LEFT JOIN k3 USING (qid)""",
    "diagnostic_lines": f"""WITH {_ALL} SELECT qid, 0 AS line, 'INFO' AS level, 'decision=' || decision || ' reason=' || reason || ' n_sources=' || n_sources || ' n_direct=' || n_direct || ' n_partial=' || n_partial || ' n_weak=' || n_weak || ' n_covered=' || n_covered AS message FROM dec
UNION ALL SELECT qid, rank, 'INFO', 'id=' || id || ' class=' || evidence_class || ' rank_vector=' || coalesce(rank_vector::VARCHAR, '-') || ' rank_lexical=' || coalesce(rank_lexical::VARCHAR, '-') FROM e4""",
    "source_cards": f"""WITH {_ALL}, pub AS (SELECT e4.*, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN evidence_class = 'direct' THEN 0 ELSE 1 END, rank) AS n FROM e4 JOIN dec USING (qid) WHERE evidence_class = 'direct' OR (decision = 'accepted' AND strong_partial))
SELECT qid, n::INTEGER AS n, CASE WHEN {_STRIP.format('titulo')} <> '' THEN {_STRIP.format('titulo')} ELSE 'Fonte ' || n END AS title, url AS link, printf('%.4f', score) AS score FROM pub""",
    "benchmark_results": f"""WITH {_ALL}, f AS (SELECT 'https://' || min(source) || '.example/' AS u FROM documents), g AS (SELECT qid, count(*)::INTEGER AS n, min(CASE WHEN url = u THEN rank END)::INTEGER AS r, string_agg('doc_' || id, ',' ORDER BY rank) AS ids FROM e4, f GROUP BY qid)
SELECT qid AS id, 200 AS status_http, decision = 'accepted' AS evidence_sufficient, decision <> 'accepted' AS ollama_skipped, reason, n AS n_sources, r AS expected_rank, ids FROM dec LEFT JOIN g USING (qid)""",
    "point_lookup": "SELECT doc_id AS id, 'doc_' || doc_id AS documento_id, split_part(text, chr(10), 1) AS titulo, 'https://' || source || '.example/' AS url FROM documents WHERE doc_id IN (SELECT item_id FROM benchmark)",
    "paired_vectors": "SELECT vec_id AS position, s_name, round(embedding[1]::DOUBLE, 6) AS x FROM supplier JOIN embeddings ON vec_id = s_suppkey - 1",
    "staging_checks": "WITH k AS (SELECT doc_id % 100 AS d, (doc_id // 200) AS c, count(*) AS n, count(*) FILTER (trim(coalesce(text, '')) = '') AS b FROM documents GROUP BY ALL) SELECT count(DISTINCT d) AS documents, sum(n)::BIGINT AS chunks, count(*) FILTER (n > 1) AS repeated_keys, sum(b)::BIGINT AS blank_texts, count(DISTINCT d) = 100 AND count(*) FILTER (n > 1) = 0 AND sum(b) = 0 AS sound FROM k",
    "restructured_articles": f"SELECT doc_id, true AS same, '## Parte *x*' || chr(10) || chr(10) || trim('palavra ' || {_LETTERS}) || ' **fim** [ali](http://x.y/z).' || chr(10) || chr(10) || '- um' || chr(10) || '- dois' AS conteudo_texto FROM documents",
    "boilerplate_removed": f"SELECT doc_id, trim('Corpo ' || {_LETTERS}) AS text FROM documents",
    "pdf_validation": "SELECT 'a_' || lpad(doc_id::VARCHAR, 6, '0') AS document_id, CASE WHEN doc_id % 3 = 0 THEN 'metadata Keywords' ELSE '' END AS wrong FROM documents WHERE regexp_matches(text, '\\S')",
    "load_summary": "SELECT r AS run, count(*) AS documents, count(*) AS chunks, CASE r WHEN 1 THEN count(*) ELSE 0 END AS inserted, count(*) AS objects, CASE r WHEN 1 THEN count(*) ELSE 0 END AS vectors, 'done' AS message FROM nation, (SELECT unnest([1, 2]) AS r) GROUP BY r",
    "audit_csv": """SELECT s_suppkey::VARCHAR AS s_suppkey, s_name || ', "x"' AS name, '[' || s_nationkey || ',1]' AS l, '{"k":"' || s_name || '"}' AS m FROM supplier""",
    "staged_tables": "SELECT count(*) AS a, count(*) AS b, true AS failed, false AS left_over FROM nation",
    "metadata_audit": """WITH d AS (SELECT doc_id, list_filter([CASE WHEN doc_id % 5 = 0 AND lang IS DISTINCT FROM 'xx' THEN 'lang' END, CASE WHEN doc_id % 11 = 0 AND source IS NOT NULL THEN 'source' END], lambda x: x IS NOT NULL) AS l FROM documents)
SELECT doc_id, array_to_string(l, ',') AS differing, CASE WHEN len(l) = 0 THEN 'APROVADO' ELSE 'REPROVADO' END AS verdict FROM d""",
    "case_audit": """WITH c AS (SELECT CASE WHEN doc_id % 50 = 0 THEN 'same' ELSE doc_id::VARCHAR END AS id, lang, doc_id, CASE WHEN doc_id % 13 <> 0 THEN quality = 1 END AS a FROM documents JOIN labels USING (doc_id)),
v AS (SELECT unnest(list_filter([CASE WHEN doc_id % 11 = 0 OR lang = '' THEN 'required_field' END, CASE WHEN doc_id % 3 = 2 THEN 'review_status' END, CASE WHEN a IS NULL THEN 'answerable' END, CASE WHEN a AND doc_id % 3 = 0 AND (doc_id % 2 = 0 OR doc_id % 9 = 0) THEN 'incomplete_answerable' END], lambda x: x IS NOT NULL)) AS violation FROM c
 UNION ALL SELECT 'duplicate_id' FROM c GROUP BY id HAVING count(*) > 1)
SELECT violation, count(*) AS n FROM v GROUP BY violation""",
    "case_results": """WITH c AS (SELECT doc_id, quality = 1 AS a, n_chars > 1000 AS k, CASE doc_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 4 END AS r FROM documents JOIN labels USING (doc_id))
SELECT doc_id::VARCHAR AS id, r::INTEGER AS rank, CASE WHEN a THEN CASE WHEN k AND r IS NOT NULL THEN 'TP' ELSE 'FN' END ELSE CASE WHEN k THEN 'FP' ELSE 'TN' END END AS outcome FROM c""",
    "result_groups": """WITH e AS (SELECT value, unnest(list_filter(['all', CASE event_id % 4 WHEN 0 THEN 'json' WHEN 1 THEN 'pdf' WHEN 2 THEN 'fora_do_corpus' END, CASE WHEN event_id % 3 = 0 THEN 'ollama_ignorado' ELSE 'ollama_executado' END], lambda x: x IS NOT NULL)) AS "group" FROM events)
SELECT "group", 'total' AS field, count(value) AS count, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(min(value), 6) AS min, round(max(value), 6) AS max, round(stddev_pop(value), 6) AS stdev, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.95), 6) AS p95 FROM e GROUP BY "group" """,
    "human_marks": "SELECT count(*) AS total, " + ", ".join(f"round(avg((event_id + {i}) % 3), 9) AS {f}" for i, f in enumerate(evaluate.QUALITY_FIELDS)) + " FROM events WHERE event_id % 4 <> 0",
    "pass_counts": """WITH r AS (SELECT lang AS kind, quality = 1 AS e, n_chars > 1000 AS a, doc_id % 10 <> 0 AS ok, n_chars > 1500 AS s FROM documents JOIN labels USING (doc_id)), g AS (SELECT kind, count(*) AS total, count(*) FILTER (ok AND e = a AND (NOT e OR s)) AS passed, count(*) FILTER (NOT ok) AS failed_calls FROM r GROUP BY kind)
SELECT *, passed = total AS all_passed FROM g""",
    "metric_texts": "SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN printf('%.4f', round(value, 4)) ELSE 'não calculável' END AS shown FROM events",
}

QUERIES = {
    "text_keys": text_keys, "synonym_terms": synonym_terms, "pdf_keywords": pdf_keywords, "repaired_text": repaired_text, "refine_blocks": refine_blocks, "page_articles": page_articles, "listing_links": listing_links, "canonical_pages": canonical_pages, "titled_text": titled_text,
    "pdf_round_trip": pdf_round_trip, "pdf_problems": pdf_problems, "reconciled_sources": reconciled_sources, "pdf_canonical": pdf_canonical, "bronze_round_trip": bronze_round_trip, "publish_status": publish_status, "upload_status": upload_status, "strict_sources": strict_sources,
    "jsonl_round_trip": jsonl_round_trip, "gold_tables": gold_tables, "vector_points": vector_points, "search_modes": search_modes, "fallback_questions": fallback_questions, "question_metrics": question_metrics, "context_texts": context_texts, "answers": answers, "diagnostic_lines": diagnostic_lines,
    "restructured_articles": restructured_articles, "boilerplate_removed": boilerplate_removed, "pdf_validation": pdf_validation, "load_summary": load_summary, "audit_csv": audit_csv, "staged_tables": staged_tables, "metadata_audit": metadata_audit,
    "source_cards": cards, "benchmark_results": benchmark_results, "point_lookup": point_lookup, "paired_vectors": paired_vectors, "staging_checks": staging_checks,
    "case_audit": case_audit, "case_results": case_results, "result_groups": result_groups, "human_marks": human_marks, "pass_counts": pass_counts, "metric_texts": metric_texts,
}
