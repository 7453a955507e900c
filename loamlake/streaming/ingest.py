"""Continuous loading: new Bronze files are merged into Gold as they arrive, each exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from loamlake.operators import gold
from loamlake.operators.chunks import article_chunks
from loamlake.plans.load import clean_articles
from loamlake.sources.bronze import FIELDS, decode_json

BINARY = "path string, modificationTime timestamp, length long, content binary"


def bronze_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Bronze articles of JSON files under path, as they come."""
    from pyspark.sql import functions as F

    files = spark.readStream.format("binaryFile").schema(BINARY).option("pathGlobFilter", "*.json").option("maxFilesPerTrigger", files_per_batch).load(path)
    named = files.withColumn("object_name", F.element_at(F.split("path", "/"), -1))
    return decode_json(named).select("documento_id", F.col("object_name").alias("source_object"), *[F.coalesce(F.col(f"payload.{f}"), F.lit("")).alias(f) for f in FIELDS])


def merge_stream(spark: SparkSession, articles: DataFrame, table: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Merges every micro-batch; the merge is idempotent, so a batch that is run again changes nothing."""

    def put(batch: DataFrame, _: int) -> None:
        session = batch.sparkSession
        gold.ensure_table(session, table)
        chunks = article_chunks(clean_articles(batch))
        safe, _ = gold.resolve_collisions(chunks, session.table(table))
        gold.upsert(session, table, gold.cast_chunks(safe))

    writer = articles.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
