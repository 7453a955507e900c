"""Writers: numbered articles, JSON lines, audit CSV, and files with an all-or-nothing publication."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from loamlake.operators.gold import key_bucket

PREFIXES = {"json": "raw/", "pdf": "raw/pdf/"}


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> int:
    """JSON lines with nulls kept; returns the number of rows, counted while they are written."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode(mode).option("ignoreNullFields", "false").json(path)
    return seen.get["n"]


def write_audit_csv(df: DataFrame, path: str) -> None:
    """CSV with a header and doubled quotes; nested columns as JSON."""
    nested = {f.name for f in df.schema.fields if isinstance(f.dataType, (ArrayType, MapType, StructType))}
    df.select(*[F.to_json(c).alias(c) if c in nested else F.col(c) for c in df.columns]).write.mode("overwrite").options(header="true", encoding="UTF-8", escape='"').csv(path)


def number_articles(articles: DataFrame, by: str, stem: str = "article") -> DataFrame:
    """articles with object_name = stem and a six-digit number in the order of ``by``.

    Numbers come from ranks within ranges of ``by`` hashes and the sizes of earlier ones, not from one sort.
    """
    df = articles.withColumn("_b", key_bucket(by))
    sizes = df.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    ranked = df.withColumn("_i", F.row_number().over(Window.partitionBy("_b").orderBy(by))).join(F.broadcast(before), "_b")
    return ranked.withColumn("object_name", F.concat(F.lit(f"{stem}_"), F.lpad((F.col("_before") + F.col("_i")).cast("string"), 6, "0"), F.lit(".json"))).drop("_b", "_i", "_before")


def article_files(articles: DataFrame, by: str = "url", stem: str = "article") -> DataFrame:
    """(object_name, content): every article as a numbered JSON file of its six fields, for publish_files or upload."""
    fields = [F.coalesce(F.col(f), F.lit("")).alias(f) for f in ("titulo", "autor", "data", "categoria", "conteudo", "url")]
    body = F.encode(F.to_json(F.struct(*fields), {"pretty": "true"}), "UTF-8")
    return number_articles(articles, by, stem).select("object_name", body.alias("content"))


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def publish_files(files: DataFrame, folder: str, name: str = "object_name", content: str = "content") -> DataFrame:
    """(object_name, status) after all files are in the folder: generated, unchanged or regenerated.

    New contents are staged as one table, which is there whole or not at all; then the driver streams them one
    by one through Hadoop's file system under temporary names and renames them. Repeated names, empty contents
    and other suffixes are errors, found before anything is written.
    """
    spark = files.sparkSession
    rows = files.select(F.col(name).alias("object_name"), F.col(content).alias("content"))
    wrong = rows.agg(F.count(F.lit(1)) - F.countDistinct("object_name"), F.count_if(F.coalesce(F.length("content"), F.lit(0)) == 0), F.count_if(~F.col("object_name").rlike(r"^[A-Za-z0-9_.-]+\.(json|pdf)$"))).first()
    if any(wrong):
        raise ValueError(f"{wrong[0]} repeated names, {wrong[1]} empty files, {wrong[2]} invalid names")
    fs, root = _fs(spark, folder)
    fs.mkdirs(root)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    old = spark.read.format("binaryFile").load(f"{folder}/*.*") if fs.globStatus(path(f"{folder}/*.*")) else None
    if old is not None:
        before = old.select(F.element_at(F.split("path", "/"), -1).alias("object_name"), F.sha2("content", 256).alias("_old"))
        rows = rows.join(before, "object_name", "left")
    else:
        rows = rows.withColumn("_old", F.lit(None).cast("string"))
    sha = F.sha2("content", 256)
    status = F.when(F.col("_old").isNull(), "generated").when(F.col("_old") == sha, "unchanged").otherwise("regenerated")
    plan = rows.select("object_name", "content", status.alias("status"))
    staged = f"{folder}/_staging"
    plan.where("status <> 'unchanged'").write.mode("overwrite").parquet(staged)
    result = plan.select("object_name", "status").toLocalIterator()  # names only
    done = list(result)
    for r in spark.read.parquet(staged).toLocalIterator():
        temp, final = path(f"{folder}/_{r['object_name']}.tmp"), path(f"{folder}/{r['object_name']}")
        out = fs.create(temp, True)
        out.write(bytearray(r["content"]))
        out.close()
        fs.delete(final, False)
        if not fs.rename(temp, final):
            raise OSError(f"{final} could not be put in place")
    fs.delete(path(staged), True)
    return spark.createDataFrame(done, "object_name string, status string")


def upload(files: DataFrame, root: str, prefixes: dict[str, str] | None = None) -> DataFrame:
    """(object_name, target, size, status) of files (object_name, content) put under the prefix of their suffix."""
    put = PREFIXES if prefixes is None else prefixes
    suffix = F.lower(F.regexp_extract("object_name", r"\.([^.]+)$", 1))
    target = F.lit(None).cast("string")
    for s, p in put.items():
        target = F.when(suffix == s, F.concat(F.lit(f"{root.rstrip('/')}/{p}"), "object_name")).otherwise(target)
    sized = files.withColumns({"target": target, "size": F.coalesce(F.length("content"), F.lit(0))})
    status = F.when(F.col("target").isNull(), "rejected_suffix").when(F.col("size") == 0, "rejected_empty").otherwise("uploaded")
    sized = sized.withColumn("status", status)
    for s, p in put.items():
        mine = sized.where((F.col("status") == "uploaded") & (suffix == s))
        if not mine.isEmpty():
            publish_files(mine, f"{root.rstrip('/')}/{p}".rstrip("/"))
    return sized.select("object_name", "target", "size", "status")

