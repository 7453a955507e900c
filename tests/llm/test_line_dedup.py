from __future__ import annotations

import random

from pyspark.sql import functions as F

from loamlake.llm.line_dedup import chunk_columns, dedup_lines, op3_line_dedup

LAST = (1 << 63) - 1


def spark_chunks(df):
    """(key, text) -> [(start, size)], from the operator's own boundaries; the rest is redone here by hand."""
    rows = chunk_columns(df.where("text is not null").select("doc_id", "text").distinct()).collect()
    return {(r["doc_id"], r["text"]): [(c["start"], c["size"]) for c in r["cs"]] for r in rows}


def brute(df):
    cuts = spark_chunks(df)
    order = {(r["doc_id"], r["text"]): r["h"] for r in df.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()}
    seen, out = set(), {}
    for (d, t), spans in sorted(cuts.items(), key=lambda x: (LAST if x[0][0] is None else x[0][0], order[x[0]])):
        lines, dead = t.split("\n"), set()
        chunks = 0
        for start, size in spans:
            body = "\n".join(lines[start : start + size])
            if not body.strip(" \t\n\x0b\x0c\r"):
                continue
            if body in seen:
                chunks += 1
                dead |= set(range(start, start + size))
            seen.add(body)
        out[d, t] = ("\n".join(x for i, x in enumerate(lines) if i not in dead) if dead else t, chunks, len(dead))
    return sorted(((r["doc_id"], *(out[r["doc_id"], r["text"]] if r["text"] is not None else (None, 0, 0))) for r in df.collect()), key=str)


def got(df):
    return sorted((tuple(r) for r in dedup_lines(df).select("doc_id", "text", "removed_chunks", "removed_lines").collect()), key=str)


def corpus():
    rng = random.Random(6)
    blocks = [[f"line {rng.randrange(10**6)} of block {b}" for _ in range(rng.randrange(2, 14))] for b in range(12)]
    rows = []
    for i in range(60):
        lines = [f"own {i} {k}" for k in range(rng.randrange(0, 6))]
        for _ in range(rng.randrange(0, 4)):
            lines += rng.choice(blocks) + [f"more {rng.random()}"] * rng.randrange(0, 3)
        rows.append((i, "\n".join(lines)))
    return rows + [(70, None), (71, ""), (72, "\n\n\n\n\n\n"), (73, "\n\n\n\n\n\n"), (None, rows[3][1]), (5, rows[9][1]), (5, rows[9][1])]


def test_equals_brute_force(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string").repartition(3)
    rows = got(df)
    assert rows == brute(df)
    assert sum(r[2] for r in rows) > 20


def test_boundaries_resist_shifts(spark):
    rng = random.Random(8)
    passage = [f"shared {rng.randrange(10**9)}" for _ in range(40)]
    rows = [(i, "\n".join([f"head {i} {k}" for k in range(i)] + passage + [f"tail {i} {k}" for k in range(5)])) for i in range(1, 9)]
    out = {r[0]: r for r in got(spark.createDataFrame(rows, "doc_id long, text string"))}
    assert out[1][3] == 0
    assert all(out[i][3] >= 30 for i in range(2, 9))
    assert all(f"head {i} 0" in out[i][1] and f"tail {i} 4" in out[i][1] for i in range(2, 9))
    for r in chunk_columns(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert all(c["size"] >= 2 for c in r["cs"]) and sum(c["size"] for c in r["cs"]) == len(r["lines"])


def test_edges(spark):
    schema = "doc_id long, text string, hash string, cs int, lines string, did int"
    assert dedup_lines(spark.createDataFrame([], schema)).count() == 0
    text = "a b\nc d\ne f\ng h"
    df = spark.createDataFrame([(1, text, "x", 1, "l", 1), (2, text, None, None, None, None)], schema)
    out = dedup_lines(df)
    assert out.columns == [*df.columns, "removed_chunks", "removed_lines"]
    assert {r["doc_id"]: (r["text"], r["removed_lines"]) for r in out.collect()} == {1: (text, 0), 2: ("", 4)}


def test_long_text(spark):
    lines = [f"line {i}" for i in range(30_000)]
    out = {r[0]: r for r in got(spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(["first"] + lines))], "doc_id long, text string"))}
    assert out[1][3] == 0 and out[2][3] >= 29_990


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert sorted((tuple(r) for r in op3_line_dedup(spark, "/root/testdata/sf0.001").collect()), key=str) == brute(docs)


def test_short_passages_go(spark):
    """Passages of two to six lines and over 50 words inside differing text go from all texts but the first."""
    rng = random.Random(11)
    line = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passages = [[line(60 // size + 12) for _ in range(size)] for size in (2, 2, 3, 4, 5, 6)] + [[line(55), ""], [line(30), "", line(30)]]
    rows, at = [], {}
    for i in range(64):
        k = i % len(passages)
        own = lambda: [line(rng.randrange(4, 30)) for _ in range(rng.randrange(0, 5))]
        rows.append((i, "\n".join([*own(), line(8), *passages[k], line(9), *own()])))
        at.setdefault(k, i)
    out = {r["doc_id"]: r for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        k = i % len(passages)
        left = [x for x in passages[k] if x and x in out[i]["text"].split("\n")]
        if i == at[k]:
            assert out[i]["text"] == text and out[i]["removed_lines"] == 0
        else:
            words = sum(len(x.split()) for x in left)
            assert words <= 50, (k, words)
            own = [x for x in text.split("\n") if x not in passages[k]]
            assert [x for x in out[i]["text"].split("\n") if x not in passages[k]] == own
    assert sum(r["removed_lines"] for r in out.values()) > 100


def test_overlapping_chunks_leave_a_copy(spark):
    """Lines that repeat within a text and across texts: of every line some copy stays."""
    rng = random.Random(12)
    lines = [" ".join(f"{c}{k}" for k in range(30)) for c in "abcd"]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 12)))) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df) == brute(df)
    left = {x for r in got(df) for x in r[1].split("\n")}
    assert set(lines) <= left
