"""Benchmark runs: questions without a result are asked in one batch, and results are appended."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamlake.operators import evaluate
from loamlake.plans.config import TOP_K
from loamlake.plans.engine import Engine

#: What a result shows of a source; its text never leaves.
SOURCE_FIELDS = ("document_id", "url", "source_object", "titulo", "score", "rank")


def run_cases(engine: Engine, cases: DataFrame, done: DataFrame | None = None, limit: int | None = None, top_k: int = TOP_K) -> DataFrame:
    """Results of the cases (id, categoria, pergunta, ...) that have none in ``done``: status_http, evidence_sufficient,
    ollama_skipped, fontes and metrics, with the position of the expected source (null if it isn't there)."""
    todo = cases if done is None else evaluate.pending(cases, done)
    todo = (todo.orderBy("id").limit(limit) if limit else todo).withColumn("qid", F.xxhash64(F.col("id").cast("string")))
    began = time.perf_counter()
    asked, classified, decisions = engine.judge(todo.select("qid", F.col("pergunta").alias("question")), top_k)
    entry = F.struct("rank", F.col("documento_id").alias("document_id"), "url", "source_object", "titulo", "score")
    sources = classified.groupBy("qid").agg(F.sort_array(F.collect_list(entry)).alias("fontes"))
    metrics = F.create_map(*[x for c in ("n_sources", "n_direct", "n_partial", "n_weak", "n_covered", "coverage") for x in (F.lit(c), F.col(c).cast("double"))])
    found = decisions.join(sources, "qid", "left").select("qid", F.lit(200).alias("status_http"), F.col("sufficient").alias("evidence_sufficient"), (~F.col("sufficient")).alias("ollama_skipped"), "decision", "reason", "fontes", metrics.alias("metrics"))
    expected = todo.select("qid", "id", "categoria", F.col("document_id_esperado").alias("_d"), F.col("url_esperada").alias("_u"), F.col("source_object_esperado").alias("_o"))
    ranked = expected.join(found, "qid").withColumn("expected_rank", evaluate.source_rank(F.col("fontes"), F.col("_d"), F.col("_u"), F.col("_o"))).drop("qid", "_d", "_u", "_o")
    return ranked.withColumn("prepare_seconds", F.lit(time.perf_counter() - began))


def append_results(results: DataFrame, path: str) -> None:
    """JSON lines beside the earlier ones, so that an interrupted run goes on where it stopped."""
    results.write.mode("append").json(path)
