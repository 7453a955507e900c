from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import functions as F

from loamlake.llm import hash_forest
from loamlake.llm.hash_forest import Forest, op7_hash_forest, search


def brute(rows, k, step=20):
    good = {(i, tuple(v)) for i, v in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)}
    out = {}
    for q, qv in good:
        if q % step == 0:
            scored = []
            for i, v in good:
                if i != q and len(v) == len(qv):
                    s = 0.0
                    for a, b in zip(qv, v):
                        s += a * b
                    scored.append((-s, i))
            out[q] = [(i, -s) for s, i in sorted(scored)[:k]]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def recall(got, want):
    return sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in w}) for q, w in want.items()) / sum(map(len, want.values()))


def test_ascent_takes_the_longest_prefixes():
    rng = np.random.default_rng(1)
    forest = Forest(rng.standard_normal((300, 8)), trees=1, bits=16)
    q = rng.standard_normal((5, 8))
    mask = forest.candidates(q, 20)
    codes = np.empty(300, np.uint64)
    codes[forest.order[0]] = forest.codes[0]
    own = forest._code(np.column_stack([q, np.zeros(5)]), forest.planes[0])
    for i in range(5):
        common = np.array([16 - int(c ^ own[i]).bit_length() for c in codes.tolist() for c in [np.uint64(c)]])
        depth = common[mask[i]].min()
        assert mask[i].sum() >= 20 and (mask[i] == (common >= depth)).all() and (common > depth).sum() < 20


def test_recall_on_the_table(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r["vec_id"], [float(c) for c in r["embedding"]]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got, want = found(op7_hash_forest(spark, sf)), brute(rows, 20)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert recall(got, want) >= 0.9
    exact = {q: dict(w) for q, w in want.items()}
    assert all(s == exact[q][i] for q, g in got.items() for i, s in g if i in exact[q])


def test_blocks_and_lengths(spark, monkeypatch):
    monkeypatch.setattr(hash_forest, "BLOCK", 250)
    rng = np.random.default_rng(2)
    x = rng.standard_normal((900, 12)) * rng.uniform(0.2, 3.0, (900, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert recall(found(search(df, df.where("vec_id % 20 = 0"), 10)), brute(rows, 10)) >= 0.9


def test_copies_ties_and_edges(spark):
    rng = random.Random(3)
    base = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(4)]
    rows = [(i, base[0] if i < 200 else base[i % 4]) for i in range(300)]
    rows += [(1000, None), (1020, [0.0] * 6), (1040, [1.0, None] + [0.0] * 4), (1060, [float("nan")] * 6), (1080, [float("inf")] * 6), (1100, []), (None, base[1]), (1120, [1.0, 2.0]), (40, base[0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, rank string, score int")
    got, want = found(search(df, df.where("vec_id % 20 = 0"), 20)), brute([r for r in rows if r[1] is None or len(r[1]) != 2], 20)
    assert got.keys() == want.keys()
    for q, w in want.items():
        assert got[q][0] == w[0] and [s for _, s in got[q]] == sorted((s for _, s in got[q]), reverse=True)
    assert recall(got, want) == 1.0
    few = df.where("vec_id in (0, 20, 21)")
    assert {q: len(v) for q, v in found(search(few, few.where("vec_id % 20 = 0"), 20)).items()} == {0: 2, 20: 2}
    assert search(df.where(F.lit(False)), df).count() == 0
    assert search(df, df.where(F.lit(False))).count() == 0


def test_few_vectors_and_near_copies(spark):
    """A query whose own vector, or near copies of it, fill the share of entries still gets its neighbours."""
    rng = np.random.default_rng(4)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    near = unit(np.repeat(rng.standard_normal((60, 64)), 15, axis=0) + 0.01 * rng.standard_normal((900, 64)))
    for x, least in ((unit(rng.standard_normal((3, 64))), 1.0), (unit(rng.standard_normal((50, 64))), 1.0), (unit(rng.standard_normal((100, 64))), 1.0), (near, 0.9)):
        rows = [(i, v.tolist()) for i, v in enumerate(x)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        got, want = found(search(df, df.where("vec_id % 20 = 0"))), brute(rows, 20)
        assert {q: len(v) for q, v in got.items()} == {q: len(w) for q, w in want.items()}
        assert recall(got, want) >= least, (len(x), recall(got, want))
        print("recall", len(x), recall(got, want))
