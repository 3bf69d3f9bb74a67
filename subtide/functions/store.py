"""Committed tables in a shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset and all runs in one JVM, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch_dir(spark: SparkSession) -> str:
    """A new folder in the shared one, deleted when the session ends."""
    path = f"{shared_dir(spark)}/subtide-{uuid.uuid4().hex}"
    fs, p = _fs(spark, path)
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return path


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def committed(spark: SparkSession, path: str) -> bool:
    """Whether a write into ``path`` has come to its end."""
    return exists(spark, f"{path.rstrip('/')}/_SUCCESS")


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in ``path``; none if it does not exist."""
    fs, p = _fs(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(p) if x.isDirectory()) if fs.exists(p) else []


def keep(df: DataFrame, path: str) -> DataFrame:
    """Write df to ``path``, unless that is done already, and read it back."""
    spark = df.sparkSession
    if not committed(spark, path):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_named(docs: DataFrame, path: str, suffix: str) -> None:
    """One file ``<media_id><suffix>`` for each row (media_id, doc), with one line end after it.

    Tasks write into a staging folder; only when all have ended do its files move
    to their names, so a job that fails leaves no file, and those from before stay.
    Files of other media stay too.
    """
    spark, path = docs.sparkSession, path.rstrip("/")
    staged = f"{path}/_staged-{uuid.uuid4().hex}"
    rows = docs.select(F.col("media_id").cast("string").alias("name"), F.regexp_replace("doc", r"\n$", "").alias("value"))
    fs, stage = _fs(spark, staged)
    try:
        # one task has all rows of a name, so a name has one file
        rows.repartition("name").write.partitionBy("name").text(staged)
        place = spark._jvm.org.apache.hadoop.fs.Path

        def move(folder: str) -> None:
            name = unquote(folder.split("=", 1)[1])
            part = next(x.getPath() for x in fs.listStatus(place(f"{staged}/{folder}")) if x.getPath().getName().startswith("part-"))
            target = place(place(path), name + suffix)
            fs.delete(target, False)
            if not fs.rename(part, target):
                raise OSError(f"{target} could not be written")

        with ThreadPoolExecutor(16) as pool:
            list(pool.map(move, [x for x in folders(spark, staged) if x.startswith("name=")]))
    finally:
        fs.delete(stage, True)
