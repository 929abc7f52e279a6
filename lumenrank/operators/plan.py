"""Plan helpers shared by the operators: checked broadcast, explicit partitioning, lineage cuts."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenrank import config as C
from lumenrank.session import checkpoint_dir, work_path


_KEPT: list[DataFrame] = []


def checked(df: DataFrame, max_bytes: int = C.BROADCAST_MAX_BYTES) -> tuple[DataFrame, bool]:
    """``df``, kept, and whether its measured size allows a broadcast.

    The side is persisted and materialised first, so the size is that of its actual
    rows and the joins share one computation (a lost block is recomputed from lineage);
    ``release_checked`` frees these once the jobs that use them have run.
    """
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    _KEPT.append(kept)
    kept.count()
    size = int(str(kept._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return kept, size <= max_bytes


def bounded_broadcast(df: DataFrame, max_bytes: int = C.BROADCAST_MAX_BYTES) -> DataFrame:
    """Broadcast ``df`` only when its measured size allows it; else leave it to a shuffle join."""
    kept, small = checked(df, max_bytes)
    return F.broadcast(kept) if small else kept


def release_checked() -> None:
    """Unpersist every side kept by ``checked`` (call after the consuming jobs)."""
    while _KEPT:
        _KEPT.pop().unpersist()


def lookup(rows: DataFrame, table: DataFrame, key: str, hot_rows: int | None = None) -> DataFrame:
    """Left-join ``table`` (one row a key) onto ``rows`` by ``key``, neither shuffling all of
    ``table`` nor gathering a hot key.

    The keys' counts (one row per distinct key, measured) cut ``table`` down to what is
    wanted: by broadcast where they are small, else by a shuffle join. Keys with more than
    ``hot_rows`` rows, and more than a ``HOT_KEYS``-th of all, are at most ``HOT_KEYS`` many;
    their rows are spread by a hash of the row over as many parts as they fill, and their
    one row of ``table`` is copied to each part. Rows with a null key are spread as well.
    """
    limit = hot_rows or C.HOT_ROWS
    ids, small = checked(rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")))
    size = ids.agg(F.sum("_n").alias("rows"), F.max("_n").alias("most")).first()
    limit = max(limit, (size["rows"] or 0) // C.HOT_KEYS)
    hint = F.broadcast if small else (lambda side: side)
    if (size["most"] or 0) <= limit:
        return rows.join(table.join(hint(ids.select(key)), key, "left_semi"), key, "left")
    wanted = table.join(hint(ids), key)
    copies = F.ceil(F.col("_n") / limit).cast("int")
    hot = ids.where((F.col("_n") > limit) & F.col(key).isNotNull()).select(key, copies.alias("_copies"))
    part = F.when(F.col(key).isNull(), F.pmod(F.xxhash64(*rows.columns), F.lit(bucket_count(rows.sparkSession)))).otherwise(
        F.coalesce(F.pmod(F.xxhash64(*rows.columns), F.col("_copies")), F.lit(0)))
    spread = rows.join(F.broadcast(hot), key, "left").withColumn("_part", part.cast("int")).drop("_copies")
    copied = wanted.withColumn("_part", F.explode(F.sequence(F.lit(0), F.when(F.col("_n") > limit, copies).otherwise(1) - 1)))
    return spread.join(copied.drop("_n"), [key, "_part"], "left").drop("_part")


def bucket_count(spark: SparkSession) -> int:
    """The default number of buckets: the session's shuffle partitions. It never depends
    on how many splits an input happens to have."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def estimated_bytes(df: DataFrame) -> int:
    """The planner's size estimate of ``df``; 0 where it has none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


def by_key(df: DataFrame, key: str, buckets: int | None = None) -> DataFrame:
    """Hash-partition ``df`` by ``key`` into an explicit number of partitions, at any input
    width. Aggregations by ``key`` and more, and a table bucketed into as many buckets,
    then need no further exchange; each task writes one bucket file."""
    return df.repartition(buckets or bucket_count(df.sparkSession), key)


def cut(df: DataFrame) -> DataFrame:
    """Materialise to the shared checkpoint folder and cut the lineage (survives lost executors)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Ends a query's shuffle files with it; else they stay until the driver collects garbage.
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freeing(spark: SparkSession, free: bool = True):
    """Queries that run in this block leave no shuffle files behind."""
    before = spark.conf.get(_FREE, "false")
    try:
        if free:
            spark.conf.set(_FREE, "true")
        yield
    finally:
        if free:
            spark.conf.set(_FREE, before)


def stored(df: DataFrame, name: str, **options) -> DataFrame:
    """``df`` as compressed Parquet in the shared checkpoint folder: cuts the lineage like ``cut``
    at a part of its size, and the shuffle files behind it go as soon as it is written.
    ``forget`` deletes it."""
    path = work_path(df.sparkSession, name)
    with freeing(df.sparkSession):
        df.write.options(compression="zstd", **options).parquet(path)
    return from_store(df.sparkSession, path, df.schema)


def from_store(spark: SparkSession, path: str, schema) -> DataFrame:
    """A table that was written under ``path``, to be read and in the end given to ``forget``."""
    out = spark.read.schema(schema).parquet(path)
    out.work_folder = path
    return out


def pinned(df: DataFrame) -> DataFrame:
    """``df`` over the partitions that are planned now: whoever reads it later, under any settings,
    gets the same rows in the same partitions. Nothing is stored; it is computed at each use."""
    spark, jdf = df.sparkSession, df._jdf
    rows = spark._jsparkSession.internalCreateDataFrame(jdf.queryExecution().toRdd(), jdf.schema(), False)
    return DataFrame(rows, spark)


def forget(*tables: DataFrame) -> None:
    """Delete what ``stored`` wrote, in whatever store it is: only what nothing reads again."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.work_folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bucketed(df: DataFrame, key: str, name: str, buckets: int | None = None,
             partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table bucketed and sorted by ``key`` in the shared
    checkpoint folder, and read it back. Unlike ``checkpoint()``, the scan then
    reports its hash partitioning on ``key``, so joins and aggregations keyed by
    it run without an exchange. ``df`` should come from ``by_key`` with the same
    number of buckets: then every task writes the one file of its bucket.
    ``partition_by`` adds a folder level above the buckets (e.g. a term hash), so
    a filter on it prunes whole folders while the bucketing still holds.
    """
    spark = df.sparkSession
    path = work_path(spark, name)
    table = "lumenrank_" + path.rstrip("/").rsplit("-", 1)[-1] + "_" + name.replace("-", "_")
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.bucketBy(buckets or bucket_count(spark), key).sortBy(key).format("parquet").option("path", path).saveAsTable(table)
    return spark.table(table)
