from __future__ import annotations

import json
import time

import numpy as np
import public_tokenizers
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from loamlake.llm import common
from loamlake.llm.quality import LEVEL, assess

SF = "/root/testdata/sf0.001"


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_stages_against_brute_force(spark, tmp_path):
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        seen[name] = docs.collect()
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert docs.columns == columns
    seen["out"] = docs.collect()
    press = zstandard.ZstdCompressor(level=LEVEL)
    kept = {r["doc_id"]: r["text"] for r in seen["line_dedup"]}
    assert kept == {r["doc_id"]: r["text"] for r in seen["quality_rules"] if assess(r["text"], press)[-1]}
    lines = {r["doc_id"]: r["text"] for r in seen["ngram_jaccard"]}
    assert lines.keys() == kept.keys() and lines != kept
    assert all(r["n_chars"] == len(r["text"]) for r in seen["ngram_jaccard"])
    sets = {d: shingles(t) for d, t in lines.items()}
    comp = {d: d for d in sets}

    def find(d):
        while comp[d] != d:
            d = comp[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                comp[max(x, y)] = min(x, y)
    assert {r["doc_id"] for r in seen["mixing"]} == {d for d in sets if find(d) == d}
    mixed = seen["packing"]
    assert 0 < len(mixed) and {r["doc_id"] for r in mixed} <= {r["doc_id"] for r in seen["mixing"]}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    total = sum(len(library.encode(r["text"], add_special_tokens=False).ids) + 1 for r in mixed)
    assert sum(r["length"] for r in seen["out"]) == total


def test_run_and_edges(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = docs.orderBy("doc_id").first()["text"]
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", None, 0), (2, good, None, "s", None), (2, good, None, "s", None)], docs.schema)
    for frame in (odd, docs.where(F.lit(False))):
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, frame, SF).collect(), json.dumps(name), np


def test_cuts_collect_the_garbage_of_the_driver(spark, monkeypatch):
    """Also such as aren't tidy, once some seconds have gone by since the last time, and not before."""
    spark.range(1).count()
    java = spark.sparkContext._jvm
    pools = java.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    full = lambda: sum(x.getCollectionCount() for x in pools() if "Old" in x.getName() or "MarkSweep" in x.getName())
    monkeypatch.setattr(common, "_collected", time.monotonic() - common.COLLECT_S)
    before = full()
    assert common.cut(spark.range(3)).count() == 3
    after = full()
    assert after > before and time.monotonic() - common._collected < 5


def test_emptied_copies_are_not_mixed(spark):
    """A third of the rows are copies of one text; the line dedup empties all but one and none of these is mixed."""
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    text = lambda k: "\n".join(f"line {i} of the text number {k} with words" for i in range(8))
    rows = [(i, text(0 if i % 3 == 0 else i), "en", f"s{i % 2}", None) for i in range(60)]
    stages = dict(corpus_pipeline.STAGES)
    emptied = stages["line_dedup"](spark, spark.createDataFrame(rows, schema), SF)
    assert emptied.where("text = ''").count() == 19
    mixed = stages["mixing"](spark, emptied, SF).collect()
    assert mixed and all(r["text"].strip() for r in mixed)
