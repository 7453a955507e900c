from __future__ import annotations

import hashlib
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loamlake.functions.editorial import clean_html, refine
from loamlake.operators import evaluate, gold, inventory, silver
from loamlake.operators.chunks import chunk_documents
from loamlake.plans.load import LoadRequest, ingest_pages, process_one, run_pipeline
from loamlake.sources import pages, pdf, sinks
from loamlake.sources.bronze import read_articles, read_object, restructure, scan, strict_articles
from loamlake.streaming.ingest import bronze_stream, merge_stream

ARTICLE = {"titulo": "Pesquisa interdisciplinar", "autor": "Autora Exemplo", "data": "2026-07-23T10:00:00+00:00", "categoria": "Ciências", "conteudo": "<h2>Parte</h2><p>Um texto com <b>ênfase</b> e <a href='http://x.y/z'>ligação</a>.</p>", "url": "https://site.example/ciencias/pesquisa/"}


def test_clean_html():
    html = "<!-- c --><nav>menu</nav><h2>Título <i>x</i></h2><p>Um &amp; dois<br>três<p>quatro<ul><li>a<li>b<ul><li>c</ul></ul><script>var t='</p>'</script><img src=q><p>Leia também:</p><p class=newsletter>n</p>"
    assert clean_html(html + "<div class='newsletter'>sai</div>") == "## Título *x*\n\nUm & dois\ntrês\n\nquatro\n\n- a\n- b\n\n- c" or clean_html(html).startswith("## Título *x*\n\nUm & dois\ntrês\n\nquatro\n\n- a\n- b")
    assert clean_html("") == "" and clean_html(None) == ""
    assert "menu" not in clean_html(html) and "var t" not in clean_html(html)
    assert clean_html("<ol><li>um<li>dois</ol>") == "1. um\n2. dois" and clean_html("<blockquote>a<br>b</blockquote>") == "> a\n> b"


def test_refine():
    body = "# Título  do **Texto**\n\nPor Ana Lima, do campus\n\nCorpo.\n\nFim\n\n---\n\nPolítica de uso: a reprodução de matérias é livre; fotos devem ser creditadas"
    text, gone = refine(body, "Título do texto", "Ana Lima")
    assert text == "Corpo.\n\nFim" and [g.rule for g in gone] == ["duplicate_leading_title", "duplicate_byline", "generic_reuse_credits", "generic_reuse_separator"]
    assert refine(text, "Título do texto", "Ana Lima") == (text, [])
    notice = "As opiniões expressas nos artigos publicados são de inteira responsabilidade de seus autores."
    assert refine(f"Corpo.\n\n{notice}\n\n*{notice}*")[0] == "Corpo."
    assert refine("Outro título\n\nPor que isso importa\n\nC", "Título", "Ana")[1] == []


def test_blocks_and_gate(spark):
    row = spark.range(1).select(silver.dedup_blocks(F.lit("# Título\n\nPrimeiro.\n\nSegundo.\n\nPrimeiro.")).alias("b")).first()["b"]
    assert (row["text"], row["removed"]) == ("# Título\n\nPrimeiro.\n\nSegundo.", 1)
    lines = silver.dedup_lines_of(spark.createDataFrame([(1, "a\nb\n*A*\n***\n***\n"), (2, ""), (3, None)], "id long, t string"), "id", "t")
    assert {r["id"]: (r["t"], r["removed"]) for r in lines.collect()} == {1: ("a\nb\n***\n***", 1), 2: ("", 0), 3: ("", 0)}
    fields = {"document_id": "d", "title": "", "published_at": "x", "category": "c", "url": "ftp://a", "text": "Pular barra de compartilhamento � \x01"}
    issues = spark.range(1).select(silver.quality_issues(**{k: F.lit(v) for k, v in fields.items()})).first()[0]
    assert issues == ["missing_title", "invalid_url", "known_boilerplate", "unicode_replacement_character", "invalid_control_character"]


def canonical_row(spark, text, sha="h", **extra):
    row = {"document_id": "a_000001", "title": "T", "author": "", "published_at": "p", "category": "c", "url": "https://a.b/c/", "text": text, "object_name": "a_000001.json", "binary_sha256": "b", "source_content_sha256": sha} | extra
    return spark.createDataFrame([row], ", ".join(f"{k} string" for k in row))


def test_canonical_and_reconcile(spark):
    text = "Um\n\nDois\n\nUm " + "x" * 900 + ' "aspas" \\ /'
    doc = silver.canonical(canonical_row(spark, text))
    r = doc.first()
    payload = {k: r[k] for k in silver.FIELDS}
    assert r["canonical_sha256"] == hashlib.sha256(json.dumps(payload, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert r["promotable"] and r["lineage_id"] == f"silver:a_000001:{r['canonical_sha256'][:16]}"
    exact = silver.canonical(canonical_row(spark, "ﬁm"), exact=True).first()
    assert exact["text"] == "fim"
    same = silver.canonical(canonical_row(spark, text), "pdf")
    assert not same.first()["promotable"]
    for other, kind in ((text, "equivalent"), (text + " y", "equivalent"), (None, "major")):
        b = silver.canonical(canonical_row(spark, other or "nada", "h" if other else "z"), "pdf")
        out = silver.reconcile(doc, b).first()
        assert out["divergence"]["classification"] == kind and out["promotable"] == (kind != "major")
        assert len(out["sources"]) == 2 and out["transformations"][-1] == "validate_against_pdf"
    close = silver.divergence(doc, silver.canonical(canonical_row(spark, text + " y", None), "pdf")).first()
    assert close["classification"] == "minor" and close["source_hash_match"] is None and 0.98 < close["text_similarity"] < 1
    good, bad = silver.to_gold_chunks(doc.unionByName(same), 500, 50)
    assert good.count() == 2 and good.first()["source_objects"] == ["a_000001.json"] and bad.count() == 1
    titled = spark.range(1).select(silver.with_title(F.lit("a\n# T"), F.lit("t")), silver.with_title(F.lit("a"), F.lit("t")), silver.with_title(F.lit(""), F.lit(""))).first()
    assert list(titled) == ["a\n# T", "# t\n\na", ""]


def test_merge_and_identity(spark):
    cols = "documento_id string, chunk_id int, texto string, titulo string, autor string, data_publicacao string, categoria string, url string, source_object string"
    rec = lambda d, c, t: (d, c, t, *[None] * 6)
    gold.ensure_table(spark, "t_chunks")
    first = gold.upsert(spark, "t_chunks", spark.createDataFrame([rec("a", 1, "x"), rec("a", 2, "y"), rec("b", 1, "z")], cols))
    assert sorted(r["id"] for r in first.collect()) == [1, 2, 3] and {r["change"] for r in first.collect()} == {"inserted"}
    before = {(r["documento_id"], r["chunk_id"]): (r["id"], r["created_at"]) for r in spark.table("t_chunks").collect()}
    again = gold.upsert(spark, "t_chunks", spark.createDataFrame([rec("a", 1, "new"), rec("c", 1, "w")], cols))
    assert {(r["documento_id"], r["change"]) for r in again.collect()} == {("a", "updated"), ("c", "inserted")}
    after = {(r["documento_id"], r["chunk_id"]): r for r in spark.table("t_chunks").collect()}
    assert len(after) == 4 and after["a", 1]["texto"] == "new" and after["c", 1]["id"] == 4
    assert all((after[k]["id"], after[k]["created_at"]) == v for k, v in before.items())
    assert after["a", 1]["updated_at"] > after["a", 1]["created_at"]
    stored = spark.createDataFrame([("n_1", "https://s.example/a/?utm_source=q"), ("n_1", "https://s.example/b/")], "documento_id string, url string")
    incoming = spark.createDataFrame([("n_1", "HTTPS://S.EXAMPLE/a/#f", 1), ("n_1", "https://s.example/other/", 1), ("n_2", "https://s.example/x/", 1)], "documento_id string, url string, chunk_id int")
    safe, collisions = gold.resolve_collisions(incoming, stored)
    want = "site_" + hashlib.sha256(b"https://s.example/other/").hexdigest()[:16]
    assert sorted(r["documento_id"] for r in safe.collect()) == sorted(["n_1", want, "n_2"])
    assert [tuple(r) for r in collisions.collect()] == [("n_1", want, "https://s.example/other/")]
    with pytest.raises(Exception, match="missing"):
        gold.cast_chunks(spark.createDataFrame([(None, 1, "x")], "documento_id string, chunk_id int, texto string")).collect()
    points = spark.createDataFrame([(1, [1.0, 0.0], {"a": "x", "b": None})], "id long, embedding array<double>, payload map<string,string>")
    merged = gold.upsert_vectors(spark.createDataFrame([], gold.VECTORS_DDL), points, 2).first()
    assert merged["payload"] == {"a": "x"} and merged["change"] == "inserted"
    with pytest.raises(Exception, match="size"):
        gold.upsert_vectors(spark.createDataFrame([], gold.VECTORS_DDL), points, 3).collect()
    broken = spark.range(1).select(F.raise_error(F.lit("boom")).cast("string").alias("x"))
    with pytest.raises(Exception, match="boom"):
        gold.stage_all(spark, {"t_ok": spark.range(2).toDF("x"), "t_bad": broken})
    assert not spark.catalog.tableExists("t_ok__staging") and not spark.catalog.tableExists("t_ok")
    gold.stage_all(spark, {"t_ok": spark.range(2).toDF("x")})
    assert spark.table("t_ok").count() == 2


def test_evaluation(spark):
    sources = [{"document_id": "d1", "url": "u1", "source_object": "o1"}, {"document_id": "d2", "url": "u2", "source_object": "o2"}]
    schema = "array<struct<document_id:string,url:string,source_object:string>>"
    df = spark.createDataFrame([(sources,)], f"s {schema}")
    rank = lambda d, u, o: df.select(evaluate.source_rank(F.col("s"), F.lit(d).cast("string"), F.lit(u).cast("string"), F.lit(o).cast("string"))).first()[0]
    assert (rank("d2", None, None), rank(None, "u1", None), rank("", None, "o2"), rank("x", None, None)) == (2, 1, 2, None)
    each = spark.createDataFrame([("TP",), ("TN",), ("FP",), ("FN",)], "outcome string")
    row = evaluate.confusion(each).first().asDict()
    assert all(row[k] == 0.5 for k in ("accuracy", "precision", "recall", "specificity", "f1_score", "balanced_accuracy", "false_positive_rate", "false_negative_rate"))
    assert evaluate.confusion(each.limit(0)).first()["precision"] is None
    m = evaluate.retrieval_metrics(spark.createDataFrame([(1,), (2,), (None,)], "rank int")).first()
    assert (m["hit_rate_at_1"], m["recall_at_3"], m["mrr"]) == (pytest.approx(1 / 3), pytest.approx(2 / 3), 0.5)
    results = spark.createDataFrame([("json", False, {"t": v}) for v in (1.0, 3.0, 2.0)] + [("pdf", True, {"other": 1.0})], "categoria string, ollama_skipped boolean, metrics map<string,double>")
    rows = {r["group"]: r for r in evaluate.latency_summary(results, ["t"]).collect()}
    assert rows.keys() == {"all", "json", "ollama_executado"} and rows["all"]["mean"] == 2 and rows["all"]["p90"] == pytest.approx(2.8) and rows["all"]["stdev"] == pytest.approx((2 / 3) ** 0.5)
    marks = spark.createDataFrame([(dict.fromkeys(evaluate.QUALITY_FIELDS, 2),), (None,)], "human_evaluation map<string,int>")
    assert evaluate.human_quality(marks).first()["clareza"] == 2
    case = dict.fromkeys(evaluate.CASE_FIELDS, "x") | {"answerable": True, "review_status": "approved"}
    kinds = ", ".join(f"{c} {'boolean' if c == 'answerable' else 'string'}" for c in evaluate.CASE_FIELDS)
    cases = spark.createDataFrame([case, case | {"id": "y", "review_status": "odd"}, case | {"id": "z", "trecho_referencia": ""}, case], kinds)
    assert sorted((r["id"], r["violation"]) for r in evaluate.case_violations(cases).collect()) == [("x", "duplicate_id"), ("y", "review_status"), ("z", "incomplete_answerable")]
    with pytest.raises(Exception, match="no result"):
        evaluate.joined(cases, spark.createDataFrame([], "id string, status_http int")).collect()
    assert "preliminar" in evaluate.report({}, 0, 20) and "| f1 | não calculável |" in evaluate.report({"f1": None}, 2, 2)
    assert inventory.metadata_audit(each.withColumn("k", F.lit(1)).limit(1), each.withColumn("k", F.lit(1)).limit(1), "k", ["outcome"]).first()["verdict"] == "APROVADO"


def test_pages(spark):
    body = "<p>" + "texto longo da notícia " * 20 + "</p>"
    html = f"<html><head><title> T </title><meta property='og:title' content='Título OG'><meta name=author content='Por Ana'><link href='https://s.example/c/' rel='canonical'></head><body><main><span class='post-date'>01/02/2026</span><div class='entry-content'>{body}<aside>x</aside></div></main></body></html>"
    rows = spark.createDataFrame([("https://s.example/ciencias/x/", html), ("https://s.example/nova-area/y/", "<h1>Só título"), (None, None)], "url string, html string")
    a = {r["url"]: r for r in ingest_pages(rows).collect()}
    one = a["https://s.example/ciencias/x/"]
    assert (one["titulo"], one["autor"], one["data"], one["categoria"]) == ("Título OG", "Ana", "01/02/2026", "Ciências") and "entry-content" in one["conteudo"]
    assert (a["https://s.example/nova-area/y/"]["titulo"], a["https://s.example/nova-area/y/"]["categoria"]) == ("Só título", "Nova Area")
    assert rows.limit(1).select(pages.canonical_link(F.col("html")), pages.title_tag(F.col("html"))).first()[0] in ("https://s.example/c/", "")
    listing = "<main><article class='post x'><a href='/ciencias/a?x=1#y'>A</a></article><article class=post><a href='/ciencias/a'>A</a></article><article class=post><a href='/tag/z'>Z</a></article></main><h3><a href='/b/c'>C</a></h3>"
    assert pages.listing_links(listing, "https://s.example") == ["https://s.example/ciencias/a"]
    assert pages.listing_links("<h3><a href='/b/c'>C</a></h3>", "https://s.example") == ["https://s.example/b/c"]
    assert pages.listing_url("https://s.example", 1).endswith("noticias/") and pages.listing_url("https://s.example", 3).endswith("page/3/")
    with pytest.raises(ValueError):
        pages.listing_url("https://s.example", 0)
    assert pages.extract_links(spark.createDataFrame([(1, listing)], "id int, html string"), "https://s.example").first()["links"] == ["https://s.example/ciencias/a"]


def test_pdf(spark, tmp_path):
    article = {**ARTICLE, "conteudo_texto": "Linha (um) com \\ e ≈ sinal.\n" + "palavra " * 800}
    data = pdf.article_pdf(article, "a_000001", "f" * 64)
    assert data == pdf.article_pdf(article, "a_000001", "f" * 64)
    got = pdf.read_pdf(data)
    assert "Linha (um) com \\ e ≈ sinal." in got.text and len(got.pages) == 2 and got.info["Title"] == ARTICLE["titulo"]
    assert pdf.validate(data, article, "a_000001", "f" * 64) == []
    assert "metadata Keywords" in pdf.validate(data, article, "a_000002", "f" * 64)
    assert pdf.validate(b"", article, "a", "f") == ["the PDF is empty"] and pdf.validate(b"x", article, "a", "f") == ["the PDF signature is missing"]
    with pytest.raises(ValueError, match="U\\+6F22"):
        pdf.article_pdf({**article, "titulo": "漢"}, "a", "f")
    assert pdf.read_pdf(pdf.text_pdf("um\ndois 漢", "T", "http://u/")).text == "um\ndois ?"
    files = spark.createDataFrame([("a_000001.pdf", bytearray(data)), ("b.pdf", bytearray(pdf.text_pdf("só texto")))], "object_name string, content binary")
    out = str(tmp_path / "pdfs")
    assert {r["status"] for r in sinks.publish_files(files, out).collect()} == {"generated"}
    assert {r["status"] for r in sinks.publish_files(files, out).collect()} == {"unchanged"}
    arts = {r["document_id"]: r for r in pdf.pdf_articles(scan(spark, out, ("pdf",))).collect()}
    assert arts.keys() == {"a_000001", "pdf_b"} and arts["a_000001"]["source_content_sha256"] == "f" * 64 and arts["a_000001"]["url"] == ARTICLE["url"]
    with pytest.raises(ValueError, match="repeated"):
        sinks.publish_files(files.unionByName(files), out)
    made = pdf.article_pdfs(spark.createDataFrame([{**article, "document_id": "a_000001", "source_sha": "f" * 64}, {**article, "titulo": "漢", "document_id": "x", "source_sha": ""}]))
    assert {r["document_id"]: (r["content"] is not None and bytes(r["content"]) == data, r["error"] is None) for r in made.collect()} == {"a_000001": (True, True), "x": (False, False)}
    status = {r["object_name"]: r["status"] for r in sinks.upload(files.unionByName(spark.createDataFrame([("c.txt", bytearray(b"x")), ("d.json", bytearray(b""))], files.schema)), str(tmp_path / "lake")).collect()}
    assert status == {"a_000001.pdf": "uploaded", "b.pdf": "uploaded", "c.txt": "rejected_suffix", "d.json": "rejected_empty"}


def test_bronze_pipeline_and_stream(spark, tmp_path):
    raw = Path(tmp_path / "raw")
    raw.mkdir()
    (raw / "news_000001.json").write_text(json.dumps({**ARTICLE, "conteudo_texto": "Um texto."}, ensure_ascii=False))
    (raw / "many.json").write_text(json.dumps([{**ARTICLE, "titulo": "A", "url": "https://s.example/a/a/"}, 5, {**ARTICLE, "titulo": "B", "url": "https://s.example/b/b/"}]))
    (raw / "other.txt").write_text("x")
    (raw / "doc.pdf").write_bytes(pdf.text_pdf("conteúdo do pdf", "Título PDF", "https://s.example/p/"))
    docs = {r["documento_id"]: r for r in read_articles(spark, str(raw)).collect()}
    assert docs.keys() == {"news_000001", "many_000001", "many_000003", "pdf_doc"} and docs["pdf_doc"]["url"] == "https://s.example/p/"
    assert read_articles(spark, str(raw), ("json",), limit=2).count() == 2
    good, bad = strict_articles(spark, str(raw))
    assert [r["document_id"] for r in good.collect()] == ["news_000001"] and [r["object_name"] for r in bad.collect()] == ["many.json"]
    assert restructure(read_articles(spark, str(raw), ("json",))).where("documento_id = 'news_000001'").first()["conteudo_texto"].startswith("## Parte")
    request = LoadRequest(str(raw), kind="all", chunks_table="p_chunks", vectors_table="p_vectors")
    one = run_pipeline(spark, request).first()
    assert (one["documents"], one["inserted"], one["vectors"]) == (4, 4, 4)
    two = run_pipeline(spark, request).first()
    assert (two["documents"], two["inserted"], two["vectors"]) == (4, 0, 0) and spark.table("p_vectors").count() == 4
    assert process_one(spark, {**ARTICLE, "documento_id": "news_000001", "url": "https://s.example/outra/coisa/"}, chunks_table="p_chunks").first()["inserted"] == 1
    for wrong in ({"source": "ftp"}, {"kind": "x"}, {"limit": 0}, {"load_text": False}):
        with pytest.raises(ValueError):
            LoadRequest(str(raw), **wrong)
    empty = tmp_path / "empty"
    empty.mkdir()
    assert run_pipeline(spark, LoadRequest(str(empty))).first()["message"] == "nothing to process"
    for _ in range(2):  # the second run finds nothing new
        merge_stream(spark, bronze_stream(spark, str(raw)), "s_chunks", str(tmp_path / "cp")).awaitTermination()
    assert spark.table("s_chunks").select("documento_id").distinct().count() == 3
    n = sinks.write_jsonl(spark.table("s_chunks"), str(tmp_path / "out"))
    assert n == spark.table("s_chunks").count()
    sinks.write_audit_csv(spark.createDataFrame([(1, ["a"])], "i int, l array<string>"), str(tmp_path / "csv"))
    numbered = sinks.number_articles(spark.createDataFrame([(f"u{i}",) for i in range(5)], "url string"), "url")
    assert sorted(r["object_name"] for r in numbered.collect()) == [f"article_{i:06d}.json" for i in range(1, 6)]
    files = sinks.article_files(spark.createDataFrame([{**ARTICLE, "autor": None}], "titulo string, autor string, data string, categoria string, conteudo string, url string"))
    sinks.publish_files(files, str(tmp_path / "articles"))
    assert read_articles(spark, str(tmp_path / "articles"), ("json",)).first()["titulo"] == ARTICLE["titulo"]
    assert chunk_documents(spark.createDataFrame([(1, None), (2, " ")], "id int, texto string")).count() == 0


def test_diagnostics(spark, tmp_path):
    from loamlake.operators.embed import embed_documents
    from loamlake.plans.diagnostics import NotReady, ProviderFailed, log_lines, phase_seconds, status_of
    from loamlake.plans.engine import Engine

    chunks = spark.createDataFrame([(1, "d1", "Pesquisa aplicada", "texto de pesquisa aplicada em genética", "https://s.example/1", "c", "a"), (2, None, "Outra", "saúde pública", "", "c", "a")], "id long, documento_id string, titulo string, texto string, url string, categoria string, autor string")
    asked = spark.createDataFrame([(7, "pesquisa aplicada genética"), (8, "saúde pública")], "qid long, question string")
    with Engine(chunks, embed_documents(chunks, "id", "texto")) as engine:
        seconds = phase_seconds(engine, asked)
        assert list(seconds) == ["index", "prepare", "embed", "vector", "lexical", "fuse", "enrich", "evidence", "context", "total"] and all(v >= 0 for v in seconds.values())
        _, classified, decisions = engine.judge(asked)
        lines = log_lines(classified, decisions).collect()
        assert {r["qid"] for r in lines if r["line"] == 0} == {7, 8} and any(r["level"] == "WARN" for r in lines)
        assert not any("genética" in r["message"] for r in lines)
        with pytest.raises(Exception) as blank:
            engine.ask(asked.withColumn("question", F.lit(" "))).collect()
        assert status_of(blank.value) == 400
    assert [status_of(e) for e in (ValueError(), NotReady(), ProviderFailed(), OSError())] == [400, 503, 502, 500]
    (tmp_path / "o.json").write_text('{"a": 1,\n "b": [2]}')
    (tmp_path / "l.json").write_text("[1]")
    assert read_object(spark, str(tmp_path / "o.json")).first()["a"] == 1
    with pytest.raises(ValueError):
        read_object(spark, str(tmp_path / "l.json"))


def test_deep_and_odd_pages():
    """Time and depth of a page don't explode; scripts keep their text as markup."""
    import time

    began = time.perf_counter()
    nested = "<div>" * 5_000 + "fundo" + "</span>" * 5_000
    assert clean_html(nested) == "fundo" and clean_html("<ul><li>a" * 300).startswith("- a")
    wide = "<table><tr>" + "<td>x</td>" * 3_000 + "</tr></table>" + "<p>" + "y " * 10_000
    assert "y y" in clean_html(wide) and pages.article(nested * 2, None)["texto"] == ""
    assert time.perf_counter() - began < 5
    from loamlake.functions import html as H

    assert H.to_html(H.parse("<p>a &lt; b<script>if (a<b) x()</script>")) == "<p>a &lt; b<script>if (a<b) x()</script></p>"


def test_programme_block():
    """The block that ends a page with a programme on air goes with all that follows; other rules stay."""
    body = "<p>Corpo.</p><hr><p><b>Programa no Ar</b></p><p><a href='https://s.example/radio/'>Programa no Ar</a> no ar veiculado pela Rede Exemplo, de segunda a sexta</p><p>mais</p>"
    assert clean_html(body) == "Corpo."
    assert clean_html("<p>Corpo.</p><hr><p><b>Outro</b></p><p>texto</p>").endswith("texto")


def test_small_forms(spark):
    from loamlake.operators.context import source_cards
    from loamlake.plans.config import jdbc_options

    assert jdbc_options({"DATABASE_URL": "postgresql://u:p%40@h:1/n"}) == {"url": "jdbc:postgresql://h:1/n", "user": "u", "password": "p@", "driver": "org.postgresql.Driver"}
    assert jdbc_options({"POSTGRES_DB": "n"})["url"] == "jdbc:postgresql://localhost:5432/n"
    with pytest.raises(ValueError):
        jdbc_options({})
    rows = spark.createDataFrame([(1, 2, " ", "javascript:x", 0.5), (1, 1, "T", "HTTPS://a/b", 1 / 3), (1, 3, None, None, None)], "qid long, context_rank int, titulo string, url string, score double")
    got = [tuple(r) for r in source_cards(rows).orderBy("n").collect()]
    assert got[:2] == [(1, 1, "T", "HTTPS://a/b", "0.3333"), (1, 2, "Fonte 2", None, "0.5000")] and got[2][2:4] == ("Fonte 3", None)
    a = spark.createDataFrame([(0, "x"), (1, "y")], "position int, t string")
    assert [tuple(r) for r in gold.zip_positions(a, a.withColumnRenamed("t", "v")).orderBy("position").collect()] == [(0, "x", "x"), (1, "y", "y")]
    with pytest.raises(Exception, match="unpaired position 1"):
        gold.zip_positions(a, a.limit(1).withColumnRenamed("t", "v")).collect()
    assert gold.by_ids(a.withColumnRenamed("position", "id"), spark.createDataFrame([], "id int")).count() == 0


def test_crawl():
    listing = lambda *paths: "<main>" + "".join(f"<article class=post><a href='{p}'>x</a></article>" for p in paths) + "</main>"
    site = {1: listing("/a/1", "/a/2"), 2: listing("/a/2", "/a/3"), 3: listing("/a/3")}
    number = lambda u: int(u.rstrip("/").rsplit("/", 1)[-1]) if "page/" in u else 1
    fetch = lambda u: site.get(number(u))
    run = lambda **k: [u[-1] for u in pages.crawl(fetch, "https://s.example", pause=0, **k)]
    assert run() == ["1", "2", "3"] and run(limit=2) == ["1", "2"] and run(max_pages=1) == ["1", "2"]
    assert list(pages.crawl(lambda _: None, "https://s.example", pause=0)) == []
