"""Counts over the lake: inventory, pipeline and manifest summaries, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamlake.functions.text import paragraph_count, source_type


def inventory(chunks: DataFrame) -> DataFrame:
    """Chunks of each document, with its source type."""
    df = chunks.groupBy("documento_id", "titulo", "url", "source_object", "categoria").agg(F.count(F.lit(1)).alias("chunks"))
    return df.withColumn("source_type", source_type(F.col("source_object"), F.lit(None).cast("string"), F.col("url"))).orderBy("titulo", "documento_id")


def inventory_summary(inv: DataFrame) -> DataFrame:
    return inv.agg(F.sum("chunks").alias("chunks"), F.countDistinct("documento_id").alias("documents"), F.countDistinct("url").alias("urls"), F.countDistinct("source_object").alias("source_objects"))


def counts_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(column)


def pipeline_summary(chunks: DataFrame) -> DataFrame:
    """documents, chunks, inserted (if a change column tells) and characters of a load."""
    new = F.count_if(F.col("change") == "inserted") if "change" in chunks.columns else F.lit(0).cast("long")
    return chunks.agg(F.countDistinct("documento_id").alias("documents"), F.count(F.lit(1)).alias("chunks"), new.alias("inserted"), F.sum(F.length("texto")).alias("characters"), F.countDistinct("source_object").alias("objects"))


def chunks_per_document(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("documento_id").agg(F.count(F.lit(1)).alias("chunks"))


def manifest(objects: DataFrame, resolved: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """objects (object_name, documento_id, url, ...) with resolved_id, text_chunks and vectors; absent ones count 0.

    resolved: original_documento_id, url, resolved_documento_id. Counts are grouped before they are joined.
    """
    r = resolved.select(F.col("original_documento_id").alias("documento_id"), "url", F.col("resolved_documento_id").alias("_r")).distinct()
    count = lambda df, name: df.groupBy(F.col("documento_id").alias("resolved_id")).agg(F.count(F.lit(1)).alias(name))
    df = objects.join(r, ["documento_id", "url"], "left").withColumn("resolved_id", F.coalesce("_r", "documento_id")).drop("_r")
    return df.join(count(chunks, "text_chunks"), "resolved_id", "left").join(count(vectors, "vectors"), "resolved_id", "left").fillna(0, ["text_chunks", "vectors"])


def manifest_summary(m: DataFrame) -> DataFrame:
    error = F.count_if(F.coalesce("error", F.lit("")) != "") if "error" in m.columns else F.lit(0).cast("long")
    url = F.when(F.coalesce("url", F.lit("")) != "", F.col("url"))
    return m.agg(F.count(F.lit(1)).alias("objects"), F.count_if(F.col("source_type") == "json").alias("json"), F.count_if(F.col("source_type") == "pdf").alias("pdf"), F.countDistinct(url).alias("urls"), F.sum("text_chunks").alias("text_chunks"), F.sum("vectors").alias("vectors"), error.alias("errors"))


def url_status_summary(checks: DataFrame) -> DataFrame:
    """Answers by class; status: the HTTP status, null where nothing answered."""
    s = F.col("status")
    return checks.agg(F.count(F.lit(1)).alias("total"), F.count_if((s >= 200) & (s < 300)).alias("ok"), F.count_if((s >= 300) & (s < 400)).alias("redirects"), F.count_if(s >= 400).alias("failed"), F.count_if(s.isNull()).alias("unanswered"))


def staging_audit(df: DataFrame, before: str = "before", after: str = "after") -> DataFrame:
    """df with characters before, after and removed, paragraphs and replacement characters."""
    b, a = F.length(before), F.length(after)
    return df.withColumns({"chars_before": b, "chars_after": a, "chars_removed": b - a, "paragraphs": paragraph_count(F.col(after)), "replacement_chars": F.length(after) - F.length(F.replace(F.col(after), F.lit("�"), F.lit("")))})


def metadata_audit(a: DataFrame, b: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, differing, verdict): APROVADO where every field is equal, nulls included."""
    l, r = a.select(key, *[F.col(f).alias(f"_a_{f}") for f in fields]), b.select(key, *[F.col(f).alias(f"_b_{f}") for f in fields])
    diff = F.array_compact(F.array(*[F.when(~F.col(f"_a_{f}").eqNullSafe(F.col(f"_b_{f}")), F.lit(f)) for f in fields]))
    return l.join(r, key).select(key, diff.alias("differing")).withColumn("verdict", F.when(F.size("differing") == 0, "APROVADO").otherwise("REPROVADO"))
