"""Steps that must do the same work for large tables, and the same as SQL."""

from __future__ import annotations

import math
import textwrap
from collections import Counter

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loamlake.functions.text import tokenize, tokens_of
from loamlake.operators import lexical, vector
from loamlake.operators.context import source_cards
from loamlake.operators.embed import HashingEmbedder, embed_documents
from loamlake.operators.fusion import of_hits
from loamlake.operators.lexical import LexicalIndex, lexical_search
from loamlake.operators.vector import vector_search
from loamlake.plans import engine as engine_module
from loamlake.plans.engine import Engine
from loamlake.plans.source_queries import _validated, pdf_round_trip
from loamlake.sources import pdf

ODD = ["Ação É ÇÃO", "e\u0301te\u0301 \u1e8dy", "\ufb01m ½ ² Å İstanbul ıx ß", "\u212a\u212a \u212b", "a\u0000b\tc\r\nd", "中文 abc日本", "😀a😀b", "ΑΣ Σ ς", "x" * 300, "", None, "  --  ", "naïve café—ok", "ẞ ŉ ǅ ǆ ĳ", "A1b2_C3-d4.e5"]
BOUND = "id long, titulo string, texto string, categoria string"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def texts(spark):
    words = [f"w{i * i % 23}" for i in range(400)]
    return spark.createDataFrame([(i, f"T {words[i]} é", " ".join(words[i : i + 3 + i % 40]), f"c{i % 3}") for i in range(200)], BOUND)


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([(q, [f"w{q % 23}", f"w{q * q % 23}", "c1", "none"]) for q in range(40)], "qid long, terms array<string>")


def test_cards_show_half_way_scores_to_the_even_digit(spark):
    scores = [2 / 64, 0.09375, 0.00005, -0.03125, 0.12345, 7.0, None]
    rows = [(1, i, "T", "https://e.x/", s) for i, s in enumerate(scores)]
    got = source_cards(spark.createDataFrame(rows, "qid long, context_rank int, titulo string, url string, score double")).orderBy("n").collect()
    assert [r["score"] for r in got] == [None if s is None else "%.4f" % s for s in scores]
    assert got[0]["score"] == "0.0312"


def test_tokens_in_python_are_those_of_the_expression(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "i int, t string")
    assert {r["i"]: r["k"] for r in df.select("i", tokenize(F.col("t")).alias("k")).collect()} == {i: tokens_of(t) for i, t in enumerate(ODD)}


def test_embedding_shuffles_nothing(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*ODD, "a b a c" * 50])], "id long, t string")
    made = embed_documents(df, "id", "t")
    assert "Exchange" not in plan(made)
    assert {r["id"]: r["vector"] for r in made.collect()} == {r["id"]: r["v"] for r in df.select("id", HashingEmbedder().vector(F.col("t")).alias("v")).collect()}


def best_by_hand(rows, asked, limit):
    weights = {"titulo": 3.0, "categoria": 1.5, "texto": 1.0}
    tf = {r["id"]: Counter() for r in rows}
    for r in rows:
        for f, w in weights.items():
            for t in tokens_of(r[f]):
                tf[r["id"]][t] += w
    df, n = Counter(t for c in tf.values() for t in c), len(rows)
    avg = sum(sum(c.values()) for c in tf.values()) / n
    out = set()
    for q in asked:
        score = {}
        for i, c in tf.items():
            s = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * sum(c.values()) / avg)) for t in set(q["terms"]) if c[t])
            if round(s, 9) > 0:
                score[i] = round(s, 9)
        out |= {(q["qid"], i, k) for k, i in enumerate(sorted(score, key=lambda i: (-score[i], i))[:limit], 1)}
    return out


def test_lexical_search_keeps_the_best_of_each_task(spark, texts, asked, monkeypatch, tmp_path):
    index = LexicalIndex.build(texts)
    assert "Exchange" not in plan(LexicalIndex.build(texts, keep=False).texts)
    want = best_by_hand(texts.collect(), asked.collect(), 7)
    got = lambda i: {(r["qid"], r["id"], r["rank_lexical"]) for r in lexical_search(i, asked, 7).collect()}
    assert got(index) == want
    for name, small in (("AT_ONCE", 7), ("CELLS", 50), ("ASKED", 30), ("QUESTIONS", 3), ("COUNTED", 5)):
        monkeypatch.setattr(lexical, name, small)
    assert got(index) == want
    index.save(str(tmp_path / "index"))
    assert got(LexicalIndex.load(spark, str(tmp_path / "index"))) == want
    df = Counter(t for r in texts.collect() for t in {x for f in ("titulo", "texto", "categoria") for x in tokens_of(r[f])})
    assert {r["term"]: r["df"] for r in LexicalIndex.build(texts, keep=False).terms.collect()} == df
    index.close()


def test_few_and_many_questions_have_the_same_nearest(spark, monkeypatch):
    v = spark.createDataFrame([(i, [float(i * j % 7 - 3) for j in range(1, 9)]) for i in range(300)], "id long, vector array<double>")
    q = v.where("id % 10 = 0").withColumnRenamed("id", "qid")
    monkeypatch.setattr(vector, "ROWS", 17)
    found = lambda metric: {tuple(r) for r in vector_search(v, q, 6, metric=metric).collect()}
    few = found("cosine"), found("inner")
    assert "Exchange" not in plan(vector_search(v, q, 6)).split("MapInArrow", 1)[1]
    monkeypatch.setattr(vector, "FEW", 0)
    monkeypatch.setattr(vector, "BLOCK", 90)
    assert (found("cosine"), found("inner")) == few


def test_equal_questions_are_searched_once(spark, texts, monkeypatch):
    chunks = texts.select("*", F.col("id").cast("string").alias("documento_id"), F.concat(F.lit("https://e.x/"), F.col("id").cast("string")).alias("url"))
    q = spark.createDataFrame([(i, ("w1 w2", "nada", "w4")[i % 3]) for i in range(300)], "qid long, question string")
    searched = []
    search = engine_module.vector_search
    monkeypatch.setattr(engine_module, "vector_search", lambda v, q, *a, **b: (searched.append(q.count()), search(v, q, *a, **b))[1])
    with Engine(chunks, embed_documents(chunks, "id", "texto")) as engine:
        hits = engine.search(q, 5).collect()
    assert searched == [3]
    by = {}
    for r in hits:
        by.setdefault(r["qid"], set()).add((r["id"], r["rank"], r["score"], r["mode"]))
    assert len(by) == 300 and all(len(by[i]) == 5 and by[i] == by[i % 3] for i in by)
    assert len({frozenset(by[i]) for i in range(3)}) == 3


def test_texts_that_no_hit_names_stay_where_they_are(spark, texts, tmp_path):
    texts.write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    hits = spark.createDataFrame([(1, 5), (2, 5), (2, 9), (3, 999)], "qid long, id long")
    found = of_hits(hits, stored)
    assert sorted(r["id"] for r in found.collect()) == [5, 9]
    assert "BroadcastHashJoin" in plan(found) and "SortMergeJoin" not in plan(found)


ARTICLE = {"titulo": "Ação (um)", "autor": "Ana", "data": "2026", "categoria": "c", "url": "https://s.example/x", "conteudo_texto": "um\\dois (três)\n\n" + "palavra ≈ 7 " * 60}


def test_lines_are_cut_as_textwrap_does():
    words = ["a" * (i * 7 % 97) for i in range(400)]
    lines = [" ".join(words[i : i + i % 60]) for i in range(340)] + ["", " a", "a ", "a  b " * 40, "x" * 93, "x" * 92 + " y", "a\tb" * 50, "b-c " * 60, "a\x1f b " * 30, "é ç " * 50]
    for x in lines:
        assert pdf.wrapped(x) == (textwrap.wrap(x, pdf.WIDTH, break_on_hyphens=False) or [""]), x


def test_a_pdf_is_checked_without_making_it_again(monkeypatch):
    data = pdf.article_pdf(ARTICLE, "a_1", "f" * 64)
    monkeypatch.setattr(pdf, "wrapped", None)
    assert pdf.validate(data, ARTICLE, "a_1", "f" * 64) == []
    assert pdf.validate(data, ARTICLE, "a_2", "f" * 64) == ["metadata Keywords"]


def test_texts_that_look_like_a_trailer_are_texts():
    article = ARTICLE | {"conteudo_texto": "see /Root 3 and /Info 4 (five) of it"}
    data = pdf.article_pdf(article, "a_1", "f" * 64)
    got = pdf.read_pdf(data)
    assert got.info["Title"] == ARTICLE["titulo"] and article["conteudo_texto"] in got.text
    assert pdf.validate(data, article, "a_1", "f" * 64) == []


def test_pdfs_are_handed_on_in_small_pieces():
    n = 3 * pdf.AT_ONCE + 5
    rows = [ARTICLE | {"document_id": f"a_{i}", "source_sha": "f"} for i in range(n)]
    batch = pa.RecordBatch.from_pylist(rows)
    made = list(pdf._made([batch]))
    checked = list(_validated([batch]))
    read = list(pdf._decoded([pd.Series([x for b in made for x in b.column("content").to_pylist()])]))
    for pieces in (made, checked, read):
        assert max(map(len, pieces)) == pdf.AT_ONCE and sum(map(len, pieces)) == n
    assert [x for p in read for x in p["error"]] == [None] * n


def test_the_round_trip_makes_every_pdf_once(spark):
    assert plan(pdf_round_trip(spark, "/root/testdata/sf0.001")).count("MapInArrow") == 1
