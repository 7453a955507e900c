"""What an operator of the service looks at: times by phase, lines for a log without any text, and statuses of errors."""

from __future__ import annotations

import time

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamlake.functions.text import expand_terms
from loamlake.operators.context import pack_context
from loamlake.operators.evidence import classify, context_sources, decide
from loamlake.operators.fusion import dedup_sources, fuse, known_only, of_hits
from loamlake.operators.lexical import lexical_search
from loamlake.operators.vector import vector_search
from loamlake.plans.config import TOP_K
from loamlake.plans.engine import Engine


class NotReady(RuntimeError):
    """The corpus or its index isn't there yet."""


class ProviderFailed(RuntimeError):
    """The answer provider didn't answer, or not in its form."""


def status_of(error: BaseException) -> int:
    """The HTTP status that a service gives an error: 400 for what the caller asked wrongly, 503 while nothing is loaded,
    502 for a provider behind it, 500 for anything else. Errors raised in a query are told by their message."""
    if isinstance(error, NotReady):
        return 503
    if isinstance(error, ProviderFailed):
        return 502
    if isinstance(error, (ValueError, TypeError)) or (isinstance(error, PySparkException) and "USER_RAISED_EXCEPTION" in str(error)):
        return 400
    return 500


def phase_seconds(engine: Engine, questions: DataFrame, top_k: int = TOP_K) -> dict[str, float]:
    """Seconds of the phases of a batch of questions, each run for itself over what the ones before it have left.

    Results of a phase are kept until the end, so none is timed twice.
    """
    seconds: dict[str, float] = {}
    kept: list[DataFrame] = []
    most = max(top_k, engine.retrieval.initial_candidates)

    def phase(name: str, df: DataFrame) -> DataFrame:
        began = time.perf_counter()
        df = df.persist()
        kept.append(df)
        df.count()
        seconds[name] = round(time.perf_counter() - began, 3)
        return df

    began = time.perf_counter()
    index = engine.index
    seconds["index"] = round(time.perf_counter() - began, 3)
    try:
        asked = phase("prepare", engine.prepare(questions))
        embedded = phase("embed", asked.select("qid", engine.embedder.vector(F.col("question")).alias("vector")))
        near = phase("vector", known_only(vector_search(engine.vectors, embedded, most), engine.chunks))
        found = phase("lexical", lexical_search(index, asked.select("qid", expand_terms(F.col("terms")).alias("terms")), most, engine.retrieval))
        fused = phase("fuse", fuse(near, found, engine.retrieval))
        hits = phase("enrich", dedup_sources(fused.join(of_hits(fused, engine.chunks), "id"), min(top_k, engine.retrieval.final_sources), engine.retrieval.max_chunks_per_source))
        classified = phase("evidence", classify(hits.join(asked.select("qid", "terms"), "qid"), engine.evidence))
        decisions = decide(asked, classified, engine.evidence)
        phase("context", pack_context(context_sources(classified, decisions, engine.evidence), engine.answer))
    finally:
        for df in kept:
            df.unpersist()
    return seconds | {"total": round(sum(seconds.values()), 3)}


def log_lines(classified: DataFrame, decisions: DataFrame) -> DataFrame:
    """(qid, line, level, message): a summary of each question and a line for each candidate, in order; none holds a text.

    A candidate without a document or an address is a warning.
    """
    n = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    said = F.concat_ws(" ", F.concat(F.lit("decision="), "decision"), F.concat(F.lit("reason="), "reason"), *[F.concat(F.lit(f"{c}="), n(c)) for c in ("n_sources", "n_direct", "n_partial", "n_weak", "n_covered")])
    summary = decisions.select("qid", F.lit(0).alias("line"), F.lit("INFO").alias("level"), said.alias("message"))
    blank = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""
    missing = blank("documento_id") | blank("url")
    shown = F.concat_ws(" ", F.concat(F.lit("id="), n("id")), F.concat(F.lit("class="), "evidence_class"), F.concat(F.lit("rank_vector="), n("rank_vector")), F.concat(F.lit("rank_lexical="), n("rank_lexical")), F.when(missing, F.lit("without identity")))
    lines = classified.select("qid", F.col("rank").cast("int").alias("line"), F.when(missing, "WARN").otherwise("INFO").alias("level"), shown.alias("message"))
    return summary.unionByName(lines)
