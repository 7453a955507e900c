from __future__ import annotations

import bisect
import hashlib
import math
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from loamlake.llm import mixing, url_filters
from loamlake.llm.mixing import mix_sources, poisson_steps
from loamlake.llm.url_filters import QUERY_RULES, Rule, alias_edges, judge_urls, match_rules

SF = "/root/testdata/sf0.01"


def page(canonical=None, refresh=None, extra=""):
    link = f'<link rel="canonical" href="{canonical}">' if canonical else ""
    meta = f"<meta http-equiv='refresh' content='0; url={refresh}'>" if refresh else ""
    return f"<html><head>{link}{meta}{extra}</head><body><a href='/x'>x</a></body></html>"


PAGES = [
    (1, "http://Www.Example.COM/en/a?x=1", page()),
    (2, "https://sub.example.com/en/b", page()),
    (3, "https://sub.example.com/fr/b", page()),
    (4, "http://other.org/a", page("http://shop.net/es/x")),  # an alias of a blocked page that isn't in the table
    (5, "http://third.org/z", page(refresh="/home")),
    (6, "http://third.org/home#top", page("http://other.org/a")),
    (7, "http://www.third.com/q", page("http://third.org/home")),  # allowed by its own rule
    (8, "http://fourth.org/", page(extra="<!-- <link rel='canonical' href='http://shop.net/fr/y'> -->")),
    (9, None, page("http://shop.net/es/x")),
    (10, "no address", None),
    (11, "http://shop.net/es/x", None),
    (12, "http://notexample.com.org/en/", page()),
    (13, "http://third.org/dir/page?q=1", page("other")),
    (13, "http://third.org/dir/page?q=1", page("other")),
    (14, "https://host.org", page("//HOST.org/?a=1&amp;b=2")),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, "v", 1) for p in PAGES], "page_id long, url string, html string, verdict string, rule_hit int")


def test_edges(pages):
    got = {tuple(r) for r in alias_edges(pages).collect()}
    assert got == {("other.org/a", "shop.net/es/x"), ("third.org/z", "third.org/home"), ("third.org/home", "other.org/a"), ("www.third.com/q", "third.org/home"), ("third.org/dir/page?q=1", "third.org/dir/other"), ("host.org/", "host.org/?a=1&b=2")}


def test_verdicts(spark, pages):
    out = judge_urls(pages, QUERY_RULES)
    assert {"rule_hit", "host", "path", "rule", "verdict", "via_alias"} <= set(out.columns) and out.count() == len(PAGES)
    rows = {r["page_id"]: r for r in out.collect()}
    want = {1: ("www.example.com", "/en/a", "www.example.com/en/", "allow"), 2: ("sub.example.com", "/en/b", "example.com/en/", "block"), 3: ("sub.example.com", "/fr/b", "com/", "allow"), 4: ("other.org", "/a", None, "block"), 5: ("third.org", "/z", None, "block"), 6: ("third.org", "/home", None, "block"), 7: ("www.third.com", "/q", "com/", "allow"), 8: ("fourth.org", "/", None, "allow"), 9: ("", "", None, "allow"), 10: ("", "", None, "allow"), 11: ("shop.net", "/es/x", "net/es/", "block"), 12: ("notexample.com.org", "/en/", None, "allow")}
    for i, w in want.items():
        assert tuple(rows[i][c] for c in ("host", "path", "rule", "verdict")) == w, i
    more = judge_urls(pages, QUERY_RULES, spark.createDataFrame([("http://fourth.org/", "https://third.org/z")], "a string, b string"))
    assert more.where("page_id = 8").first()["verdict"] == "block"
    assert judge_urls(pages.limit(0), QUERY_RULES).count() == 0


def test_decided_rows_stay_out_of_the_join(spark, pages):
    """No null key is shuffled, with many aliases as with few."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = judge_urls(pages, QUERY_RULES)
        assert "isnotnull(alias_node" in out._jdf.queryExecution().optimizedPlan().toString()
        assert {r["page_id"] for r in out.where("via_alias").collect()} == {4, 5, 6}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_aliases_of_real_pages(spark):
    """Pages of the table that declare the next page as their canonical form, in chains that end in blocked addresses."""
    real = spark.read.parquet(f"{SF}/pages.parquet").orderBy("page_id").collect()
    rows = [(r["page_id"], f"http://h{r['page_id']}.org/p", f"<link href='http://h{r['page_id'] + 1}.org/p' rel=canonical>" + (r["html"] or "")) for r in real[:120]]
    rows = [(i, u, h.replace(f"h{i + 1}.org/p", "shop.net/es/x") if i % 10 == 9 else h) for i, u, h in rows]
    out = {r["page_id"]: r["verdict"] for r in judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), QUERY_RULES).collect()}
    # every chain of ten reaches a blocked address, but for what comes after the last
    last = max(i for i, _, _ in rows if i % 10 == 9)
    assert out == {i: "block" if i <= last else "allow" for i, _, _ in rows}


def test_many_rules_equal_few(spark, pages):
    few = match_rules(pages.withColumn("h", url_filters.host_of(F.col("url"))).withColumn("p", url_filters.path_of(F.col("url"))).select("page_id", "h", "p"), QUERY_RULES, "h", "p", "out")
    table = spark.createDataFrame([*QUERY_RULES, Rule("block", "unused.org", "/")], "verdict string, host string, path string")
    many = match_rules(few.drop("out").withColumnsRenamed({"h": "hh", "p": "pp"}), table, "hh", "pp", "out")
    key = lambda df, h, p: sorted(((r["page_id"], r[h], r[p], tuple(r["out"]) if r["out"] else None) for r in df.collect()), key=str)
    assert key(few, "h", "p") == key(many, "hh", "pp")


def test_sql_with_edges(spark, pages):
    """The SQL of the query sees the same canonical links."""
    rows = [r for r in PAGES if r[0] != 5 and r[0] != 13 and r[0] != 14]
    con = duckdb.connect()
    con.sql("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    want = sorted(map(str, con.sql(url_filters.SQL["op1_url_filters"]).fetchall()))
    got = judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), QUERY_RULES).select("page_id", "host", "path", "rule", "verdict", "via_alias")
    assert sorted(str(tuple(r)) for r in got.collect()) == want


def brute_count(doc, rate, seed=mixing.SEED):
    u = int(hashlib.md5(f"{seed}|{doc}".encode()).hexdigest()[:13], 16) / 16**13
    p = c = math.exp(-rate)
    k = 0
    while c <= u:
        k += 1
        p *= rate / k
        c += p
    return k


def test_poisson(spark):
    for rate in (0.0, 0.3, 1.0, 7.5, 60.0):
        steps = spark.range(1).select(poisson_steps(F.lit(rate))).first()[0]
        assert steps[0] == pytest.approx(math.exp(-rate)) and steps[-1] == pytest.approx(1.0, abs=1e-12)
    with pytest.raises(Exception, match="700"):
        spark.range(1).select(poisson_steps(F.col("id") + 701.0)).collect()


def test_mix(spark):
    rows = [(i, f"text {i}", "hot" if i % 3 else "cold", 9) for i in range(1500)] + [(5000, None, None, 9), (None, "n", "cold", 9), (7, "text 7", "hot", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, repeats int")
    out = mix_sources(df, {"cold": 3.0, "hot": 1.0}, total=2000)
    n = Counter(r[2] for r in rows)
    weights = {"cold": 3.0, "hot": 1.0, None: 1.0}
    want = Counter()
    for d, t, s, _ in rows:
        want[d, t] += brute_count("null" if d is None else d, weights[s] / 5 * 2000 / n[s])
    got = Counter((r["doc_id"], r["text"]) for r in out.collect())
    assert got == +want
    shares = Counter(r["source"] for r in out.collect())
    assert shares["cold"] == pytest.approx(1200, rel=0.1) and shares["hot"] == pytest.approx(400, rel=0.15)
    order = [r["doc_id"] for r in mix_sources(df, partitions=1).collect()]
    assert order != sorted(order, key=lambda x: (x is None, x or 0))
    assert mix_sources(df.limit(0)).count() == 0 and "repeats" in mix_sources(df.limit(0)).columns
    again = [tuple(r) for r in mix_sources(df.repartition(7), partitions=1).collect()]
    assert again == [tuple(r) for r in mix_sources(df, partitions=1).collect()]


def brute_parts(doc, rate, seed=mixing.SEED):
    """The sum of draws of at most 500 each, every one by its own hash."""
    parts = math.ceil(rate / 500)
    p = c = math.exp(-rate / parts)
    steps = [c]
    for k in range(1, math.ceil(rate / parts + 12 * math.sqrt(rate / parts) + 30) + 1):
        p *= rate / parts / k
        c += p
        steps.append(c)
    us = (int(hashlib.md5(f"{seed}|{doc}|part|{j}".encode()).hexdigest()[:13], 16) / 16**13 for j in range(1, parts + 1))
    return sum(bisect.bisect_right(steps, u) for u in us)


def test_a_source_of_one_row_among_a_million(spark):
    """Its rate is half a million; it still gets its share."""
    n = 1_000_000
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 77, "rare").otherwise("large").alias("source"))
    rows = {r["source"]: r for r in mix_sources(df).groupBy("source").agg(F.count("*").alias("n"), F.max("copy_no").alias("last"), F.countDistinct("doc_id", "copy_no").alias("d"), F.max("repeats").alias("r")).collect()}
    rare = rows["rare"]
    assert rare["n"] == rare["d"] == rare["r"] == rare["last"] + 1 == brute_parts(77, n / 2)
    assert rare["n"] == pytest.approx(n / 2, rel=0.01) and rows["large"]["n"] == pytest.approx(n / 2, rel=0.01)


def test_many_sources_equal_few(spark, monkeypatch):
    """Beyond the bound only large sources are sent out; the rows are the same."""
    rows = [(i, "hot" if i % 3 == 0 else None if i % 31 == 0 else f"s{i % 40}") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    few = sorted((r["doc_id"], r["copy_no"], r["repeats"]) for r in mix_sources(df).collect())
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 10)
    assert sorted((r["doc_id"], r["copy_no"], r["repeats"]) for r in mix_sources(df).collect()) == few


@pytest.mark.parametrize("rare", [1, 2])
def test_computed_source_and_rare_ones(spark, rare):
    """A source computed from the id, of which one value has a row or two among 10,000."""
    df = spark.range(10_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < rare, "rare").otherwise("large").alias("source"))
    rows = mix_sources(df).groupBy("source").count().collect()
    assert {r["source"]: r["count"] for r in rows}["rare"] == pytest.approx(5_000, rel=0.05)


def test_cut_tables_are_swept(spark):
    """A cut is a table in the checkpoint folder until it is forgotten or all are swept."""
    from pathlib import Path

    from loamlake.llm.common import cut, forget, sweep

    one, two = cut(spark.range(3)), cut(spark.range(4))
    where = lambda df: Path(df.cut_path.removeprefix("file:"))
    assert where(one).exists() and where(two).exists() and one.count() == 3
    forget(one)
    assert not where(one).exists() and where(two).exists()
    sweep(spark)
    assert not where(two).exists()


def test_weights(spark):
    df = spark.range(10).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"))
    with pytest.raises(ValueError):
        mix_sources(df, {"a": -1.0})
    assert mix_sources(df, {"a": 0.0}).count() == 0 and mix_sources(df, total=0).count() == 0


@pytest.mark.parametrize("name", ["op1_url_filters", "op4_mix_sources"])
def test_sql(spark, name):
    module = url_filters if name.startswith("op1") else mixing
    con = duckdb.connect()
    for t in ("pages", "documents"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, rel = module.QUERIES[name](spark, SF), con.sql(module.SQL[name])
    cols = sorted(df.columns)
    at = [rel.columns.index(c) for c in cols]
    assert sorted(str(tuple(r[c] for c in cols)) for r in df.collect()) == sorted(str(tuple(r[i] for i in at)) for r in rel.fetchall())
