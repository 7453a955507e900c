"""Gold tables: identity, idempotent merges, and staging that is swapped in whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamlake.functions.text import normalize_url, surrogate_id

KEYS = ("documento_id", "chunk_id")
UPDATED = ("texto", "titulo", "autor", "data_publicacao", "categoria", "url", "source_object")
CHUNKS_DDL = "id BIGINT, documento_id STRING, chunk_id INT, texto STRING, titulo STRING, autor STRING, data_publicacao STRING, categoria STRING, url STRING, source_object STRING, created_at TIMESTAMP, updated_at TIMESTAMP"
VECTORS_DDL = "id BIGINT, embedding ARRAY<FLOAT>, payload MAP<STRING, STRING>"


def ensure_table(spark: SparkSession, name: str, ddl: str = CHUNKS_DDL) -> bool:
    """Creates the table where it is missing; true if it did."""
    there = spark.catalog.tableExists(name)
    if not there:
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({ddl}) USING parquet")
    return not there


def cast_chunks(records: DataFrame) -> DataFrame:
    """The columns of the text table with their types; keys and text may not be null."""
    must = {"documento_id": "string", "chunk_id": "int", "texto": "string"}
    cols = [F.coalesce(F.col(c).cast(t), F.raise_error(F.lit(f"{c} is missing")).cast(t)).alias(c) for c, t in must.items()]
    cols += [(F.col(c).cast("string") if c in records.columns else F.lit(None).cast("string")).alias(c) for c in UPDATED[1:]]
    return records.select(*cols)


def resolve_collisions(incoming: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(incoming with safe ids, the collisions). An id that is stored for other addresses only is replaced by one made
    from the address. Only stored rows count; addresses of an id are gathered before the join."""
    stored = existing.groupBy(F.col("documento_id").alias("_id")).agg(F.collect_set(normalize_url(F.col("url"))).alias("_urls"))
    df = incoming.join(stored, F.col("documento_id") == F.col("_id"), "left").withColumn("_url", normalize_url(F.col("url")))
    clash = F.col("_urls").isNotNull() & ~F.array_contains("_urls", F.col("_url"))
    df = df.withColumn("_new", F.when(F.coalesce(clash, F.lit(False)), surrogate_id(F.col("_url"))))
    collisions = df.where("_new is not null").select(F.col("documento_id").alias("original_documento_id"), F.col("_new").alias("resolved_documento_id"), F.col("_url").alias("url")).distinct()
    return df.withColumn("documento_id", F.coalesce("_new", "documento_id")).drop("_id", "_urls", "_url", "_new"), collisions


def merge(existing: DataFrame, incoming: DataFrame, keys: tuple[str, ...] = KEYS, updated: tuple[str, ...] = UPDATED, now=None, order: str | None = None) -> DataFrame:
    """existing after an upsert of incoming: all columns of existing, and change = inserted, updated or kept.

    Matched rows take the updated columns and updated_at, and keep id and created_at. New rows get ids after
    the largest one, in key order. Of several incoming rows with one key the last by ``order`` counts (else
    any, which an input without such repeats doesn't notice). One full outer join on the keys.
    """
    now = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    pick = F.max_by(F.struct(*updated), order) if order else F.first(F.struct(*updated))
    new = incoming.groupBy(*keys).agg(pick.alias("_n"))
    old = existing.select(*keys, F.struct(*[c for c in existing.columns if c not in keys]).alias("_o"))
    both = old.join(new, list(keys), "full_outer")
    is_new, touched = F.col("_o").isNull(), F.col("_n").isNotNull()
    cols = {}
    for c in existing.columns:
        if c in keys or c == "id":
            continue
        if c == "created_at":
            cols[c] = F.when(is_new, now).otherwise(F.col("_o")[c])
        elif c == "updated_at":
            cols[c] = F.when(touched, now).otherwise(F.col("_o")[c])
        elif c in updated:
            cols[c] = F.when(touched, F.col("_n")[c]).otherwise(F.col("_o")[c])
        else:
            cols[c] = F.col("_o")[c]
    change = F.when(is_new, "inserted").when(touched, "updated").otherwise("kept")
    out = both.select(*keys, *[v.alias(k) for k, v in cols.items()], change.alias("change"), *([F.col("_o")["id"].alias("id")] if "id" in existing.columns else []))
    if "id" not in existing.columns:
        return out
    return _number(out, existing, keys).select(*existing.columns, "change")


def key_bucket(*keys: str):
    """One of 4096 buckets by the keys' md5, the same on every engine."""
    return F.substring(F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys])), 1, 3)


def _number(merged: DataFrame, existing: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Ids for the new rows, in the order of (bucket, keys): ranks within buckets plus the sizes of earlier ones,
    so no task sorts all rows and a retry gives the same ids."""
    start = existing.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    new = merged.where("change = 'inserted'").drop("id").withColumn("_b", key_bucket(*keys))
    sizes = new.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    ranked = new.withColumn("_i", F.row_number().over(Window.partitionBy("_b").orderBy(*keys)))
    numbered = ranked.join(F.broadcast(before), "_b").withColumn("id", F.lit(start) + F.col("_before") + F.col("_i")).drop("_b", "_i", "_before")
    return merged.where("change <> 'inserted'").unionByName(numbered)


def upsert(spark: SparkSession, table: str, incoming: DataFrame, keys: tuple[str, ...] = KEYS, updated: tuple[str, ...] = UPDATED, ddl: str = CHUNKS_DDL) -> DataFrame:
    """Merges into a managed table by writing the result beside it and swapping; returns (keys, id, change) of the incoming rows."""
    ensure_table(spark, table, ddl)
    staged = f"{table}__next"
    spark.sql(f"DROP TABLE IF EXISTS {staged}")
    merge(spark.table(table), incoming, keys, updated).write.saveAsTable(staged, format="parquet")
    spark.table(staged).drop("change").write.mode("overwrite").saveAsTable(f"{table}__new", format="parquet")
    spark.sql(f"DROP TABLE IF EXISTS {table}__changes")
    spark.table(staged).where("change <> 'kept'").select(*keys, "id", "change").write.saveAsTable(f"{table}__changes", format="parquet")
    swap(spark, f"{table}__new", table)
    spark.sql(f"DROP TABLE {staged}")
    return spark.table(f"{table}__changes")


def swap(spark: SparkSession, staged: str, table: str) -> None:
    """The staged table takes the other's name; the old one goes last, so a failure before leaves it in place."""
    old = f"{table}__old"
    spark.sql(f"DROP TABLE IF EXISTS {old}")
    if spark.catalog.tableExists(table):
        spark.sql(f"ALTER TABLE {table} RENAME TO {old}")
    spark.sql(f"ALTER TABLE {staged} RENAME TO {table}")
    spark.sql(f"DROP TABLE IF EXISTS {old}")


def upsert_vectors(existing: DataFrame, points: DataFrame, dimension: int) -> DataFrame:
    """existing (id, embedding, payload) after an upsert of points; a missing id or a wrong size is an error, nulls leave the payload."""
    checked = points.withColumn("id", F.coalesce(F.col("id").cast("long"), F.raise_error(F.lit("a point has no id")).cast("long")))
    checked = checked.withColumn("embedding", F.when(F.size("embedding") == dimension, F.col("embedding").cast("array<float>")).otherwise(F.raise_error(F.lit("a vector has the wrong size")).cast("array<float>")))
    checked = checked.withColumn("payload", F.map_filter("payload", lambda _, v: v.isNotNull()))
    new = checked.groupBy("id").agg(F.max_by(F.struct("embedding", "payload"), F.xxhash64("embedding")).alias("_n"))
    both = existing.withColumn("_o", F.struct("embedding", "payload")).select("id", "_o").join(new, "id", "full_outer")
    return both.select("id", F.coalesce("_n.embedding", "_o.embedding").alias("embedding"), F.coalesce("_n.payload", "_o.payload").alias("payload"), F.when(F.col("_o").isNull(), "inserted").when(F.col("_n").isNotNull(), "updated").otherwise("kept").alias("change"))


def stage_all(spark: SparkSession, builds: dict[str, DataFrame]) -> None:
    """All tables or none: each is written under a staging name first, which must not exist, and dropped if one fails."""
    done: list[str] = []
    try:
        for name, df in builds.items():
            if spark.catalog.tableExists(f"{name}__staging"):
                raise ValueError(f"{name}__staging exists")
            done.append(f"{name}__staging")
            df.write.saveAsTable(f"{name}__staging", format="parquet")
    except BaseException:
        for s in done:
            spark.sql(f"DROP TABLE IF EXISTS {s}")
        raise
    for name in builds:
        swap(spark, f"{name}__staging", name)


def by_ids(chunks: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """The chunks of the given ids (a column ``key``), each once; no ids give no rows without a read of the chunks."""
    wanted = ids.select(key).where(f"{key} is not null").distinct()
    return chunks.limit(0) if wanted.isEmpty() else chunks.join(wanted, key, "left_semi")


def zip_positions(records: DataFrame, vectors: DataFrame, position: str = "position") -> DataFrame:
    """records with the columns of vectors at the same position; a position that only one side has is an error."""
    left, right = records.withColumn("_l", F.lit(True)), vectors.withColumn("_r", F.lit(True))
    both = left.join(right, position, "full_outer")
    paired = F.when(F.col("_l").isNull() | F.col("_r").isNull(), F.raise_error(F.concat(F.lit("unpaired position "), F.col(position).cast("string"))).cast(both.schema[position].dataType)).otherwise(F.col(position))
    return both.withColumn(position, paired).drop("_l", "_r")


def staging_checks(chunks: DataFrame, documents: int) -> DataFrame:
    """One row: documents, chunks, repeated keys and texts without any; sound if documents are as many as expected and the others none."""
    keyed = chunks.groupBy("documento_id", "chunk_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.trim(F.coalesce("texto", F.lit(""))) == "").alias("blank"))
    out = keyed.agg(F.countDistinct("documento_id").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"), F.count_if(F.col("n") > 1).alias("repeated_keys"), F.coalesce(F.sum("blank"), F.lit(0)).alias("blank_texts"))
    return out.withColumn("sound", (F.col("documents") == documents) & (F.col("repeated_keys") == 0) & (F.col("blank_texts") == 0))
