"""Bronze: raw articles and PDFs on any file system that Spark reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamlake.functions import text as T
from loamlake.sources.pdf import pdf_articles

FIELDS = ("titulo", "autor", "data", "categoria", "conteudo", "url")
STRICT = ("titulo", "autor", "data", "categoria", "conteudo_texto", "url")
ARTICLE = "struct<" + ",".join(f"{f}:string" for f in (*FIELDS, "document_id", "conteudo_html", "conteudo_texto")) + ">"
SUFFIXES = ("json", "pdf")


def scan(spark: SparkSession, path: str, suffixes: tuple[str, ...] = SUFFIXES, recursive: bool = False) -> DataFrame:
    """(path, length, content, object_name, suffix) of the files under path, of the given suffixes only."""
    if bad := set(suffixes) - set(SUFFIXES):
        raise ValueError(f"unknown suffixes {sorted(bad)}")
    glob = f"*.{{{','.join(suffixes)}}}" if len(suffixes) > 1 else f"*.{suffixes[0]}"
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", "length", "content", name.alias("object_name"), F.lower(F.element_at(F.split(name, r"\."), -1)).alias("suffix"))


def document_id(object_name: Column) -> Column:
    return F.regexp_extract(object_name, r"([^/]+?)(\.[^./]*)?$", 1)


def decode_json(files: DataFrame) -> DataFrame:
    """(object_name, documento_id, payload): an object is one document, an array one for each object in it, numbered
    by its place; other values in it are skipped, and other files give none."""
    text = F.decode("content", "UTF-8")
    raw = files.withColumn("j", F.trim(text)).withColumn("many", F.substring("j", 1, 1) == "[")
    items = F.when(F.col("many"), F.from_json("j", "array<string>")).when(F.substring("j", 1, 1) == "{", F.array("j"))
    rows = raw.select("object_name", "many", F.posexplode(items).alias("at", "item")).where(F.substring(F.trim("item"), 1, 1) == "{")
    base = document_id(F.col("object_name"))
    return rows.select("object_name", F.when(F.col("many"), F.concat(base, F.lit("_"), F.lpad((F.col("at") + 1).cast("string"), 6, "0"))).otherwise(base).alias("documento_id"), F.from_json("item", ARTICLE).alias("payload"))


def read_articles(spark: SparkSession, path: str, suffixes: tuple[str, ...] = SUFFIXES, limit: int | None = None, recursive: bool = False) -> DataFrame:
    """Bronze documents as (documento_id, source_object, titulo, autor, data, categoria, conteudo, url), by path.

    A file that can't be decoded is an error, as is a limit below one. The limit counts documents.
    """
    if limit is not None and limit < 1:
        raise ValueError("limit must be positive")
    files = scan(spark, path, suffixes, recursive)
    json = decode_json(files.where("suffix = 'json'")).select("documento_id", F.col("object_name").alias("source_object"), *[F.coalesce(F.col(f"payload.{f}"), F.lit("")).alias(f) for f in FIELDS])
    if "pdf" not in suffixes:
        return json.orderBy("source_object", "documento_id").limit(limit) if limit else json
    pdf = pdf_articles(files.where("suffix = 'pdf'"))
    text = F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.col("object_name"), F.lit(": "), F.col("error")))).otherwise(F.col("text"))
    pdf = pdf.select(F.concat(F.lit("pdf_"), document_id(F.col("object_name"))).alias("documento_id"), F.col("object_name").alias("source_object"), F.col("title").alias("titulo"), F.lit("").alias("autor"), F.lit("").alias("data"), F.lit("").alias("categoria"), text.alias("conteudo"), "url")
    both = json.unionByName(pdf)
    return both.orderBy("source_object", "documento_id").limit(limit) if limit else both


def strict_articles(spark: SparkSession, path: str, name_pattern: str = r"^([a-z_]+_(\d{6}))\.json$") -> tuple[DataFrame, DataFrame]:
    """(articles with document_id, the six fields and source_sha; rejects with their reasons). Nothing is repaired."""
    files = scan(spark, path, ("json",)).withColumn("p", F.from_json(F.decode("content", "UTF-8"), ARTICLE))
    reasons = [
        F.when(F.regexp_extract("object_name", name_pattern, 1) == "", F.lit("object_name")),
        *[F.when(F.col(f"p.{f}").isNull(), F.lit(f"missing_{f}")) for f in STRICT],
        *[F.when(T.strip(F.col(f"p.{f}")) == "", F.lit(f"empty_{f}")) for f in ("titulo", "conteudo_texto")],
        F.when(~F.col("p.url").rlike(r"(?i)^https?://[^/?#]+"), F.lit("url")),
    ]
    files = files.withColumn("reasons", F.array_compact(F.array(*reasons)))
    payload = T.canonical_json(**{f: F.col(f"p.{f}") for f in STRICT})
    good = files.where(F.size("reasons") == 0).select(F.regexp_extract("object_name", name_pattern, 1).alias("document_id"), "object_name", *[F.col(f"p.{f}").alias(f) for f in STRICT], F.sha2(payload, 256).alias("source_sha"), F.sha2("content", 256).alias("binary_sha256"))
    return good, files.where(F.size("reasons") > 0).select("object_name", "reasons")


def restructure(articles: DataFrame) -> DataFrame:
    """articles with conteudo_html and conteudo_texto beside what they had; an empty body is an error."""
    from loamlake.functions.editorial import extract_clean_text

    text = extract_clean_text(F.col("conteudo"), F.col("titulo"), F.col("autor"))
    df = articles.withColumn("conteudo_html", F.col("conteudo")).withColumn("conteudo_texto", text)
    return df.withColumn("conteudo_texto", F.when(F.coalesce("conteudo_texto", F.lit("")) == "", F.raise_error(F.lit("an article has no text")).cast("string")).otherwise(F.col("conteudo_texto")))


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON lines; blank ones don't count."""
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def read_object(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The one row of a JSON document that must be an object; anything else is an error."""
    text = spark.read.text(path, wholetext=True).where(F.trim("value") != "")
    kinds = [r["k"] for r in text.select(F.substring(F.trim("value"), 1, 1).alias("k")).limit(2).collect()]
    if kinds != ["{"]:
        raise ValueError(f"{path} holds no JSON object")
    reader = spark.read.option("multiLine", "true").option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)
