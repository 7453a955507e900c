"""Benchmark metrics over cases and results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUALITY_FIELDS = ("clareza", "correcao", "cobertura", "fidelidade", "utilidade")
CASE_FIELDS = ("id", "categoria", "pergunta", "answerable", "source_type_esperado", "document_id_esperado", "titulo_esperado", "url_esperada", "source_object_esperado", "trecho_referencia", "resposta_referencia", "evidence_sufficient_esperado", "ollama_skipped_esperado", "observacao_origem", "review_status")
STATUSES = ("pending", "approved", "rejected")


def case_violations(cases: DataFrame) -> DataFrame:
    """(id, violation) of every broken rule; a valid set has none. Missing columns are an error."""
    if missing := [c for c in CASE_FIELDS if c not in cases.columns]:
        raise ValueError(f"cases lack {missing}")
    blank = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""
    again = cases.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", F.lit("duplicate_id").alias("violation"))
    rules = [
        F.when(blank("id") | blank("categoria") | blank("pergunta"), F.lit("required_field")),
        F.when(~F.coalesce(F.col("review_status").isin(*STATUSES), F.lit(False)), F.lit("review_status")),
        F.when(F.col("answerable").isNull(), F.lit("answerable")),
        F.when(F.col("answerable") & (F.col("review_status") == "approved") & (blank("trecho_referencia") | (blank("document_id_esperado") & blank("url_esperada") & blank("source_object_esperado"))), F.lit("incomplete_answerable")),
    ]
    return cases.select("id", F.explode(F.array_compact(F.array(*rules))).alias("violation")).unionByName(again)


def id_differences(questions: DataFrame, truth: DataFrame) -> DataFrame:
    """(id, side): ids that only questions or only the ground truth have."""
    q, t = questions.select("id").distinct(), truth.select("id").distinct()
    return q.join(t, "id", "left_anti").withColumn("side", F.lit("without_truth")).unionByName(t.join(q, "id", "left_anti").withColumn("side", F.lit("without_question")))


def pending(cases: DataFrame, results: DataFrame) -> DataFrame:
    """Cases that have no result yet."""
    return cases.join(results.select("id").distinct(), "id", "left_anti")


def source_rank(sources: Column, document_id: Column, url: Column, source_object: Column) -> Column:
    """Position (from 1) of the first source that is the expected one by any of three fields; null if none is."""
    eq = lambda s, f, want: F.coalesce((want != "") & (s[f] == want), F.lit(False))
    hits = F.transform(sources, lambda s: eq(s, "document_id", document_id) | eq(s, "url", url) | eq(s, "source_object", source_object))
    at = F.array_position(hits, True)
    return F.when(at > 0, at)


def joined(cases: DataFrame, results: DataFrame) -> DataFrame:
    """Approved cases with their results; a case without one is an error."""
    r = results.select("id", F.struct(*[c for c in results.columns if c != "id"]).alias("r"))
    out = cases.where("review_status = 'approved'").join(r, "id", "left")
    return out.withColumn("r", F.when(F.col("r").isNull(), F.raise_error(F.concat(F.lit("no result for "), F.col("id").cast("string")))).otherwise(F.col("r")))


def outcome(answerable: Column, accepted: Column, rank: Column) -> Column:
    """TP, FN, FP or TN of one case."""
    accepted = F.coalesce(accepted, F.lit(False))
    return F.when(answerable, F.when(accepted & rank.isNotNull(), "TP").otherwise("FN")).otherwise(F.when(accepted, "FP").otherwise("TN"))


def confusion(df: DataFrame, label: str = "outcome") -> DataFrame:
    """One row of counts and rates; a rate without cases is null."""
    n = lambda x: F.count_if(F.col(label) == x)
    counts = df.agg(n("TP").alias("tp"), n("TN").alias("tn"), n("FP").alias("fp"), n("FN").alias("fn"))
    tp, tn, fp, fn = (F.col(c).cast("double") for c in ("tp", "tn", "fp", "fn"))
    div = F.try_divide
    df = counts.withColumns({"total": F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn"), "accuracy": div(tp + tn, tp + tn + fp + fn), "precision": div(tp, tp + fp), "recall": div(tp, tp + fn), "specificity": div(tn, tn + fp), "false_positive_rate": div(fp, fp + tn), "false_negative_rate": div(fn, fn + tp)})
    return df.withColumns({"f1_score": div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), "balanced_accuracy": (F.col("recall") + F.col("specificity")) / 2})


def retrieval_metrics(df: DataFrame, rank: str = "rank") -> DataFrame:
    """hit rate and recall at 1, 3 and 5 and the mean reciprocal rank over answerable cases; a null rank is a miss."""
    total = F.count(F.lit(1))
    hit = lambda k: F.try_divide(F.count_if(F.col(rank) <= k).cast("double"), total.cast("double"))
    at = [hit(k).alias(f"{name}_at_{k}") for name in ("hit_rate", "recall") for k in (1, 3, 5)]
    mrr = F.try_divide(F.coalesce(F.sum(1 / F.col(rank)), F.lit(0.0)), total.cast("double"))
    return df.agg(total.alias("total"), *at, mrr.alias("mrr"), F.lit(None).cast("double").alias("ndcg_at_3"))


def summaries(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """count, mean, median, min, max, population deviation and exact interpolated percentiles per group."""
    v = F.col(value).cast("double")
    pct = lambda p, name: F.percentile(v, p).alias(name)
    return df.where(v.isNotNull()).groupBy(*groups).agg(F.count(v).alias("count"), F.avg(v).alias("mean"), pct(0.5, "median"), F.min(v).alias("min"), F.max(v).alias("max"), F.stddev_pop(v).alias("stdev"), pct(0.5, "p50"), pct(0.9, "p90"), pct(0.95, "p95"))


def latency_groups(categoria: Column, skipped: Column) -> Column:
    """Overlapping groups of one result: all, its category, and whether the model ran."""
    return F.array_compact(F.array(F.lit("all"), F.when(categoria.isin("json", "pdf", "fora_do_corpus"), categoria), F.when(skipped, F.lit("ollama_ignorado")).when(~skipped, F.lit("ollama_executado"))))


def latency_summary(results: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(group, field, summaries) of results (categoria, ollama_skipped, metrics map<string,double>)."""
    rows = results.select(F.explode(latency_groups(F.col("categoria"), F.col("ollama_skipped"))).alias("group"), "metrics")
    entry = F.explode(F.map_entries(F.map_filter("metrics", lambda k, _: k.isin(*fields)))).alias("e")
    return summaries(rows.select("group", entry).select("group", F.col("e.key").alias("field"), F.col("e.value").alias("value")), ["group", "field"], "value")


def human_quality(results: DataFrame, fields: Sequence[str] = QUALITY_FIELDS) -> DataFrame:
    """Means of the human marks 0, 1 or 2; another mark is an error, results without marks don't count."""
    df = results.where("human_evaluation is not null")
    for f in fields:
        df = df.withColumn(f, F.when(F.col("human_evaluation")[f].isin(0, 1, 2), F.col("human_evaluation")[f]).otherwise(F.raise_error(F.lit(f"mark {f} is invalid")).cast("int")))
    return df.agg(F.count(F.lit(1)).alias("total"), *[F.avg(f).alias(f) for f in fields])


def pass_counts(results: DataFrame, kind: str) -> DataFrame:
    """By kind: total, passed, failed_calls and all_passed of results (status_http, expect_accepted, accepted, n_sources).

    A call passes with status 200 and the expected decision, an accepted one with at least one source as well.
    """
    ok = F.coalesce(F.col("status_http") == 200, F.lit(False))
    passed = ok & F.coalesce(F.col("expect_accepted") == F.col("accepted"), F.lit(False)) & (~F.col("expect_accepted") | (F.coalesce("n_sources", F.lit(0)) > 0))
    out = results.groupBy(kind).agg(F.count(F.lit(1)).alias("total"), F.count_if(passed).alias("passed"), F.count_if(~ok).alias("failed_calls"))
    return out.withColumn("all_passed", F.col("passed") == F.col("total"))


def format_metric(value: Column) -> Column:
    return F.when(value.isNull(), F.lit("não calculável")).otherwise(F.format_string("%.4f", value.cast("double")))


def report(metrics: dict[str, float | None], approved: int, total: int) -> str:
    """Markdown; figures are published only when every case is approved."""
    lines = ["# Avaliação", "", f"Casos aprovados: {approved} de {total}", ""]
    if not total or approved < total:
        return "\n".join([*lines, "Relatório preliminar: métricas só com todos os casos aprovados.", ""])
    show = lambda v: "não calculável" if v is None else f"{v:.4f}"
    return "\n".join([*lines, "| métrica | valor |", "| --- | --- |", *(f"| {k} | {show(v)} |" for k, v in metrics.items()), ""])
