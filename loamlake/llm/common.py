"""Helpers that the operators share: table access, reliable checkpoints, key folding."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Seconds after which the next cut lets the driver collect its garbage.
COLLECT_S = 10.0
_collected = 0.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keeps the folder that the session names; sets one only where none is set (tests, notebooks)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", "")
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="loamlake-checkpoint-")
    sc.setCheckpointDir(named)


def cut(df: DataFrame, tidy: bool = False) -> DataFrame:
    """df written once as a table in the shared checkpoint folder and read again.

    Rows survive lost executors, and later plans begin at the files: unlike Dataset.checkpoint, which carries
    constraints over and makes them multiply in loops, this keeps plans small and gives Spark true sizes.
    tidy: what was shuffled for it is large and no longer needed; a collection on the driver lets Spark delete
    it now, not whenever the driver next runs out of memory. Without it the driver still collects every COLLECT_S
    seconds: each of the many queries of a loop leaves plans, metrics and file lists there, for which its heap
    would grow to its limit before it collects them by itself.
    """
    global _collected
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = _path(spark, _folder(spark))
    _files(spark, where).deleteOnExit(where)  # what nobody forgot or swept goes with the application
    if tidy:
        for _ in range(2):  # the first lets go of what the finished query still holds
            time.sleep(0.5)
            gc.collect()
            spark.sparkContext._jvm.System.gc()
        _collected = time.monotonic()
    elif time.monotonic() - _collected >= COLLECT_S:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        _collected = time.monotonic()
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def _folder(spark: SparkSession) -> str:
    """Where the tables of this application are."""
    return f"{spark.sparkContext.getCheckpointDir()}/cut-{spark.sparkContext.applicationId}"


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path):
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _delete(spark: SparkSession, path: str) -> None:
    where = _path(spark, path)
    _files(spark, where).delete(where, True)


def forget(*tables: DataFrame) -> None:
    """Deletes the tables of cuts that nothing reads any more, as in the rounds of a loop."""
    for df in tables:
        _delete(df.sparkSession, df.cut_path)


def sweep(spark: SparkSession) -> None:
    """Deletes every table that the operators have cut in this application; call it once their results are written."""
    if spark.sparkContext.getCheckpointDir():
        _delete(spark, _folder(spark))


def md5_uniform(*parts: Column) -> Column:
    """A double in [0, 1) from the first 13 hex digits of an md5; DuckDB can compute the same number."""
    digest = F.md5(F.concat_ws("|", *parts))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or with underscores before it until no column of df has the name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted
