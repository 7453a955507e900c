"""Loading: pages or files into Bronze, Bronze into Gold text and vectors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamlake.functions.editorial import clean_html_udf
from loamlake.operators import gold, silver
from loamlake.operators.chunks import OVERLAP, SIZE, article_chunks
from loamlake.operators.embed import DIMENSION, embed_documents, normalized
from loamlake.operators.inventory import pipeline_summary
from loamlake.sources.bronze import read_articles
from loamlake.sources.pages import extract_articles

KINDS = {"site": ("json",), "pdf": ("pdf",), "all": ("json", "pdf")}
NOTHING = "nothing to process"


@dataclass(frozen=True)
class LoadRequest:
    """source: minio (any object store path) or local; the kinds of files; and what to load."""

    path: str
    source: str = "local"
    kind: str = "site"
    limit: int | None = None
    load_text: bool = True
    load_vectors: bool = True
    chunk_size: int = SIZE
    overlap: int = OVERLAP
    chunks_table: str = "chunks"
    vectors_table: str = "vectors"

    def __post_init__(self) -> None:
        if self.source not in ("minio", "local"):
            raise ValueError("source must be minio or local")
        if self.kind not in KINDS:
            raise ValueError(f"kind must be one of {sorted(KINDS)}")
        if self.limit is not None and self.limit < 1:
            raise ValueError("limit must be positive")
        if self.load_vectors and not self.load_text:
            raise ValueError("vectors need the ids of the text load")


def ingest_pages(pages: DataFrame) -> DataFrame:
    """Articles (titulo, autor, data, categoria, conteudo, url) of raw pages (url, html)."""
    return extract_articles(pages).select("titulo", "autor", "data", "categoria", "conteudo", "url")


def clean_articles(articles: DataFrame) -> DataFrame:
    """articles with texto: the body as Markdown under its title."""
    body = clean_html_udf(F.coalesce("conteudo", F.lit("")))
    pdf = F.lower("source_object").endswith(".pdf")
    df = articles.withColumn("_body", body)
    return df.withColumn("texto", silver.with_title(F.col("_body"), F.coalesce("titulo", F.lit("")), pdf)).drop("_body", "conteudo")


def run_pipeline(spark: SparkSession, request: LoadRequest) -> DataFrame:
    """One summary row: documents, chunks, inserted, characters, objects, vectors and a message."""
    articles = read_articles(spark, request.path, KINDS[request.kind], request.limit, recursive=request.source == "minio")
    chunks = article_chunks(clean_articles(articles), request.chunk_size, request.overlap)
    if chunks.isEmpty():
        return spark.range(1).select(*[F.lit(0).cast("long").alias(c) for c in ("documents", "chunks", "inserted", "characters", "objects", "vectors")], F.lit(NOTHING).alias("message"))
    vectors = 0
    if request.load_text:
        gold.ensure_table(spark, request.chunks_table)
        safe, _ = gold.resolve_collisions(chunks, spark.table(request.chunks_table))
        changes = gold.upsert(spark, request.chunks_table, gold.cast_chunks(safe))
        loaded = spark.table(request.chunks_table).join(changes.select("id", "change"), "id")
        if request.load_vectors:
            vectors = load_vectors(spark, loaded, request.vectors_table)
        chunks = loaded
    return pipeline_summary(chunks).withColumns({"vectors": F.lit(vectors).cast("long"), "message": F.lit("done")})


def load_vectors(spark: SparkSession, chunks: DataFrame, table: str) -> int:
    """Embeds chunks (id, texto, ...) and merges the points; returns how many are new."""
    gold.ensure_table(spark, table, gold.VECTORS_DDL)
    fields = ("documento_id", "chunk_id", "titulo", "url", "categoria", "autor", "data_publicacao", "source_object")
    payload = F.create_map(*[x for f in fields for x in (F.lit(f), F.col(f).cast("string"))])
    points = chunks.select("id", payload.alias("payload")).join(embed_documents(chunks, "id", "texto"), "id").select("id", normalized(F.col("vector")).cast("array<float>").alias("embedding"), "payload")
    merged = gold.upsert_vectors(spark.table(table), points, DIMENSION)
    spark.sql(f"DROP TABLE IF EXISTS {table}__next")
    merged.write.saveAsTable(f"{table}__next", format="parquet")
    new = spark.table(f"{table}__next").where("change = 'inserted'").count()
    spark.sql(f"DROP TABLE IF EXISTS {table}__new")
    spark.table(f"{table}__next").drop("change").write.saveAsTable(f"{table}__new", format="parquet")
    gold.swap(spark, f"{table}__new", table)
    spark.sql(f"DROP TABLE {table}__next")
    return new


def process_one(spark: SparkSession, article: dict[str, str], **names: str) -> DataFrame:
    """Loads a single article (documento_id and the six fields)."""
    row = spark.createDataFrame([{f: article.get(f, "") for f in ("documento_id", "titulo", "autor", "data", "categoria", "conteudo", "url")} | {"source_object": article.get("source_object", "")}])
    chunks = article_chunks(clean_articles(row))
    table = names.get("chunks_table", "chunks")
    gold.ensure_table(spark, table)
    safe, _ = gold.resolve_collisions(chunks, spark.table(table))
    changes = gold.upsert(spark, table, gold.cast_chunks(safe))
    return pipeline_summary(spark.table(table).join(changes.select("id", "change"), "id"))
