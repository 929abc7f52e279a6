"""Shared pieces of the training-data operators."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenrank.session import work_path

#: The white space of every contract: [\x20\x09-\x0D]. bytes.split() without
#: arguments splits on exactly these bytes.
SPACE_BYTES = b" \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Ends a query's shuffle files with it; else they stay until the driver collects garbage.
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _freeing(spark: SparkSession, free: bool):
    before = spark.conf.get(_FREE, "false")
    try:
        if free:
            spark.conf.set(_FREE, "true")
        yield
    finally:
        if free:
            spark.conf.set(_FREE, before)


def written(df: DataFrame, name: str, free: bool = False) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage, survives a
    lost executor, and gives the planner a measured size for its joins. ``free``: the
    shuffle files behind it go as soon as it is written (nothing else should need them)."""
    spark, path = df.sparkSession, work_path(df.sparkSession, name)
    with _freeing(spark, free):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.work_folder = path
    return out


def kept_by(df: DataFrame, key: str, name: str, folders: str) -> DataFrame:
    """``df`` as a table bucketed by ``key``, in a folder for each value of ``folders``: later
    groups and joins by ``key`` leave its rows where they are. Frees the shuffle files behind it."""
    spark, path = df.sparkSession, work_path(df.sparkSession, name)
    table = f"llm_{path.rsplit('-', 1)[-1]}_{name.replace('-', '_')}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with _freeing(spark, True):
        df.write.partitionBy(folders).bucketBy(buckets, key).format("parquet").option("path", path).saveAsTable(table)
    out = spark.table(table)
    out.work_folder = path
    return out


def forget(*tables, folder: str = "") -> None:
    """Delete what ``written`` or ``kept_by`` wrote, or of it one ``folder`` (also as a pair of
    both), in whatever store it is. Only for tables that nothing will read again."""
    for table in tables:
        table, part = table if isinstance(table, tuple) else (table, folder)
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{table.work_folder}/{part}" if part else table.work_folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))
