"""Documents to overlapping text chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamlake.functions.text import strip

SIZE, OVERLAP = 1200, 200


def windows(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """array<string> of windows of ``size`` characters that share ``overlap``, trimmed, without blank ones."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("size must be positive and overlap smaller than size")
    step, length = size - overlap, F.length(text)
    last = F.when(length <= size, 0).otherwise(F.ceil((length - size) / step)).cast("int")
    return F.filter(F.transform(F.sequence(F.lit(0), last), lambda i: strip(F.substring(text, i * step + 1, F.lit(size)))), lambda w: w != "")


def chunk_documents(docs: DataFrame, text: str = "texto", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """docs with one row per chunk: ``text`` holds the chunk, and chunk_id (from 1), chunk_size and overlap are added.

    A null or blank text has no chunks.
    """
    # the trimmed text is a column of its own, so that no window trims it again; and an inner explode would make the
    # optimizer cut every text once more, to drop those without windows first
    cut = docs.withColumn("_b", strip(F.coalesce(F.col(text), F.lit("")))).withColumn("_w", windows(F.col("_b"), size, overlap))
    rest = [c for c in docs.columns if c != text]
    rows = cut.select(*rest, F.posexplode_outer("_w").alias("_p", text)).where(F.col(text).isNotNull())
    return rows.withColumns({"chunk_id": F.col("_p") + 1, "chunk_size": F.lit(size), "overlap": F.lit(overlap)}).drop("_p")


def article_chunks(articles: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Cleaned articles (documento_id, titulo, autor, data, categoria, url, source_object, texto) as chunk records."""
    return chunk_documents(articles.withColumnRenamed("data", "data_publicacao"), "texto", size, overlap)
