from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamlake.llm import ngram_join
from loamlake.llm.blocks import Block
from loamlake.llm.components import connected_components, local_components
from loamlake.llm.ngram_join import keep_one_of_each, similar_documents
from loamlake.llm.trie import PrefixTree


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute(rows, width, num, den):
    sets = [shingles(t, width) for _, t in rows]
    comp = list(range(len(rows)))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and rows[i][0] is not None and rows[j][0] is not None:
                common = len(sets[i] & sets[j])
                if den * common >= num * (len(sets[i]) + len(sets[j]) - common):
                    a, b = find(i), find(j)
                    comp[max(a, b)] = min(a, b)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    return sorted(((d, len(s), min(groups[find(i)]) if d is not None else None) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def corpus(seed, n=120):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)]
    passage = " ".join(rng.choice(vocab) for _ in range(60))
    rows, i = [], 0
    while len(rows) < n:
        base = [rng.choice(vocab) for _ in range(rng.choice([3, 6, 30, 80, 200]))]
        for _ in range(rng.choice([1, 1, 2, 5, 25])):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                at = rng.randrange(len(words))
                words[at : at + 1] = rng.choice([[], [rng.choice(vocab)], [words[at], "new"]])
            text = " ".join(words)
            if rng.random() < 0.2:
                text = passage + "\n" + text
            rows.append((i := i + 1, text.upper() if rng.random() < 0.1 else text))
    return rows


def got(spark, rows, width, num, den):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted((tuple(r) for r in similar_documents(df, width, num, den).collect()), key=str)


@pytest.mark.parametrize("seed", [1])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed) + [(900, None), (901, ""), (902, " \n"), (None, "w1 w2 w3 w4 w5"), (903, "a b"), (904, "A  b"), (905, "b a")]
    assert got(spark, rows, 4, 85, 100) == brute(rows, 4, 85, 100)


def test_rounds_and_blocks_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "PIVOTS", 3)
    monkeypatch.setattr(ngram_join, "SLICE_TOKENS", 300)
    for rounds in (0, 1):
        monkeypatch.setattr(ngram_join, "ROUNDS", rounds)
        rows = corpus(7, 150)
        assert got(spark, rows, 5, 4, 5) == brute(rows, 5, 4, 5)


def dealt_rows(monkeypatch):
    """How many rows are dealt, and how many of them go into trees, call by call."""
    counts, links = [], ngram_join._links

    def counted(rows, num, den):
        counts.append(rows.select(F.count(F.lit(1)), F.count_if("pivot")).first())
        return links(rows, num, den)

    monkeypatch.setattr(ngram_join, "_links", counted)
    return counts


def test_chain_through_ten_thousand_sets(spark, monkeypatch):
    """Neighbours share half of their shingles, all rare: one closure of 10,000 sets, and linear work."""
    counts = dealt_rows(monkeypatch)
    monkeypatch.setattr(ngram_join, "_blocks", lambda *_: pytest.fail("no comparison of all with all"))
    n = 10_000
    i = F.col("id")
    span = lambda start, size: F.sequence(start, start + size - 1)
    # two shingles that link with the neighbours come first; 19 more are shared with one set and 19 with another
    toks = F.concat(F.array(i, i + 1), span(10**6 + i % 5000 * 19, 19), span(10**8 + F.floor(i / 2) * 19, 19))
    sets = spark.range(n).select(i.alias("cls"), F.lit(40).cast("long").alias("n"), toks.alias("toks"))
    copies = sets.where("cls % 3000 = 0").select((F.col("cls") + n).alias("cls"), F.lit(39).cast("long").alias("n"), F.slice("toks", 1, 39).alias("toks"))
    found = ngram_join.jaccard_links(sets.unionByName(copies), 4, 5)
    assert {tuple(sorted((r["a"], r["b"]))) for r in found.collect()} == {(k, n + k) for k in (0, 3000, 6000, 9000)}
    print("rows dealt and in trees", [tuple(c) for c in counts])
    assert len(counts) > 2 and sum(c[0] for c in counts) < 30 * n


def test_many_clusters_of_one_shingle(spark, monkeypatch):
    """Sets that share a rare shingle but aren't alike: blocks within it find every link, known ones are passed over."""
    monkeypatch.setattr(ngram_join, "PIVOTS", 4)
    rows = [(c * 3 + k, 11, [-1, *range(c * 100, c * 100 + 9), c * 100 + 10 + k]) for c in range(60) for k in range(3)]
    sets = spark.createDataFrame(rows, "cls long, n long, toks array<long>")
    linked = {}
    for r in connected_components(ngram_join.jaccard_links(sets, 4, 5)).collect():
        linked.setdefault(r["component"], set()).add(r["node"])
    assert linked == {c * 3: {c * 3, c * 3 + 1, c * 3 + 2} for c in range(60)}


def test_trees_are_bounded_by_tokens(spark, monkeypatch):
    """Few but long sets are more than one tree."""
    counts = dealt_rows(monkeypatch)
    monkeypatch.setattr(ngram_join, "TREE_TOKENS", 3_000)
    rows = [(i, " ".join(f"w{(k if k % 50 else 1000 * i + k)}" for k in range(600))) for i in range(20)]
    assert {r[2] for r in got(spark, rows, 1, 4, 5)} == {0}
    assert 0 < counts[0][1] < 12


def test_tree_finds_every_link():
    rng = random.Random(3)
    for num, den in ((4, 5), (85, 100)):
        sets = []
        for _ in range(60):
            base = sets[rng.randrange(len(sets))] if sets and rng.random() < 0.8 else set(rng.sample(range(400), rng.randrange(1, 60)))
            sets.append({x for x in base if rng.random() > 0.04} | ({rng.randrange(400)} if rng.random() < 0.5 else set()) or {1})
        tree = PrefixTree(num, den)
        for i, s in enumerate(sets):
            linked = tree.add(i, sorted(s), len(s))
            truth = {j for j in range(i) if den * len(s & sets[j]) >= num * len(s | sets[j])}
            assert set(linked) <= truth
            assert {tree.find(j) for j in truth} == ({tree.find(i)} if truth else set())
        tree.freeze()
        for s in sets:
            linked = tree.probe(sorted(s), len(s))
            truth = {j for j in range(60) if den * len(s & sets[j]) >= num * len(s | sets[j])}
            assert set(linked) <= truth and {tree.find(j) for j in linked} == {tree.find(j) for j in truth}


def test_block_finds_every_link():
    rng = random.Random(5)
    for num, den in ((4, 5), (85, 100)):
        base = rng.sample(range(300), 60)
        sets = [{x for x in base if rng.random() > 0.06} | set(rng.sample(range(900), rng.randrange(3))) for _ in range(90)]
        rows = [(i, np.array(sorted(s)), len(s), i % 70) for i, s in enumerate(sets)]  # some come with a common component
        pairs = {(i, j) for i in range(90) for j in range(90) if i != j and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])}
        same = [(i, i - 70) for i in range(70, 90)]
        block = Block(rows[:40], num, den)
        assert [[len(a & b) for b in sets[:40]] for a in sets] == block.shared([r[1] for r in rows]).tolist()
        found = block.linked(rows[:40]) + block.linked(rows[40:])
        assert set(found) <= pairs and len(found) < 2 * 90

        def grouped(edges):
            nodes, root = local_components(*np.array(sorted(edges)).T)
            return dict(zip(nodes.tolist(), root.tolist(), strict=True))

        assert grouped([*found, *same]) == grouped([*(p for p in pairs if min(p) < 40), *same])


def test_near_copies_that_mostly_differ(spark, monkeypatch):
    """A group of near copies just under the similarity: few links, all found, and few rows dealt and joined by group."""
    counts = []

    def counted(rows, num, den, links):
        counts.append(rows.count())
        return links(rows, num, den)

    for name in ("_links", "_block_links"):
        monkeypatch.setattr(ngram_join, name, lambda *a, f=getattr(ngram_join, name): counted(*a, f))
    rng, n = random.Random(11), 1500
    lost = [rng.sample(range(150), 20) for _ in range(n)]
    lost[1::100] = [[*x[:-2], *rng.sample(sorted(set(range(150)) - set(x)), 2)] for x in lost[::100]]  # like the one before them
    sets = [set(range(150)) - set(x) for x in lost]
    rows = [(i, 130, sorted(s)) for i, s in enumerate(sets)]
    held = np.zeros((n, 150), np.int64)
    for i, s in enumerate(sets):
        held[i, sorted(s)] = 1
    common = held @ held.T
    a, b = np.nonzero(np.triu(85 * (260 - common) <= 100 * common, 1))
    nodes, root = local_components(a, b)
    monkeypatch.setattr(ngram_join, "BLOCK", 200)  # several blocks
    links = ngram_join.jaccard_links(spark.createDataFrame(rows, "cls long, n long, toks array<long>"), 85, 100)
    assert {r["node"]: r["component"] for r in connected_components(links).collect()} == dict(zip(nodes.tolist(), root.tolist(), strict=True))
    print("rows dealt", counts)
    assert sum(counts) < 9 * n


def test_edges_and_keep_one(spark):
    schema = "doc_id long, text string, cls string, fp int, toks string"
    assert similar_documents(spark.createDataFrame([], schema)).count() == 0
    assert keep_one_of_each(spark.createDataFrame([], schema)).count() == 0
    a, b = "one two three four five six seven eight", "other words stand here and link with nothing"
    df = spark.createDataFrame([(3, a, "x", 1, None), (3, a, "x", 1, None), (5, a.upper(), "y", 2, "t"), (4, b, None, None, None), (None, a, None, 1, "t"), (6, None, None, 1, "u"), (7, "", "", 1, "u"), (7, "", "", 1, "u"), (3, b, "z", 1, "v")], schema)
    kept = keep_one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(str((r["doc_id"], r["cls"])) for r in kept.collect()) == sorted(map(str, [(3, "x"), (3, "z"), (None, None), (6, None), (7, ""), (7, "")]))
    with pytest.raises(ValueError):
        similar_documents(df, num=1, den=2)
    blank = spark.createDataFrame([(1, "\n\t"), (1, "\n\t"), (2, a), (2, a)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in keep_one_of_each(blank).collect()) == [1, 1, 2]


def test_long_text(spark):
    rows = [(1, "word " * 100_000), (2, "word " * 90_000), (3, " ".join(map(str, range(60_000)))), (4, " ".join(map(str, range(55_000))))]
    assert got(spark, rows, 5, 4, 5) == [(1, 1, 1), (2, 1, 1), (3, 59_996, 3), (4, 54_996, 3)]


def test_components(spark):
    rng = random.Random(9)
    chain = [(i, i + 1) for i in range(1000, 1400)]
    edges = chain + [(1, i) for i in range(2, 300)] + [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(260)] + [(7777, 7777), (None, 4), (5, 6)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    for local in (0, 200, 10**6):  # contracted to the end, finished in one task, and that alone
        out = connected_components(spark.createDataFrame(edges, "a long, b long"), local_edges=local)
        assert {r["node"]: r["component"] for r in out.collect()} == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted((tuple(r) for r in ngram_join.op2_ngram_jaccard(spark, "/root/testdata/sf0.01").collect()), key=str) == brute(rows, 4, 85, 100)
    assert keep_one_of_each(docs, 4, 85, 100).agg(F.countDistinct("doc_id")).first()[0] == len({c for _, _, c in brute(rows, 4, 85, 100)})
