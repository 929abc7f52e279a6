"""S1-S9 readers and K1-K6 writers in the original formats. Text and JSON readers have
explicit schemas (S1 takes its columns from the header, S6 adds the keys it finds);
Parquet readers take the files' own.

Delimited and JSON inputs are read once and are best converted to Parquet
(``multiLine`` files are read by one task each); everything downstream reads
Parquet. Readers never collect; writers write from the executors.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from lumenrank.functions.text import parse_answers
from lumenrank.operators.ids import row_ids_text
from lumenrank.operators.plan import bucket_count, freeing
from lumenrank.session import work_path

POOL_SCHEMA = "id long, text string"
QUERY_TSV_SCHEMA = "query string, answers string"
TRAINING_SOURCE_SCHEMA = (
    "question string, positive_ctxs array<struct<text: string>>, "
    "hard_negative_ctxs array<struct<text: string>>"
)
TRAINING_ROWS_SCHEMA = "query string, pos array<string>, neg array<string>"
RUN_SCHEMA = "qid long, rank int, doc_id long, score double"

FILE_BYTES = 64 * 1024 * 1024  # text of one file that only one task can read
TSV = {"sep": "\t", "quote": '"', "escape": '"', "multiLine": "true"}


def read_corpus_tsv(spark: SparkSession, path: str) -> DataFrame:
    """S1 + C1 + C2: header TSV to the pool ``(id, text)``; id = 0-based file row.

    Every column is read as a string (``NA`` stays text); only ``text`` is kept.
    """
    raw = spark.read.options(header="true", inferSchema="false", **TSV).csv(path)
    return row_ids_text(raw.select("text"), "id").select("id", "text")


def read_pool_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Candidate pool JSONL ``{"id", "text"}``."""
    return spark.read.schema(POOL_SCHEMA).json(path)


def read_pool_texts(spark: SparkSession, path: str) -> DataFrame:
    """S3: the pool's texts only (column pruning reaches the reader)."""
    return read_pool_jsonl(spark, path).select("text")


def read_query_tsv(spark: SparkSession, path: str) -> DataFrame:
    """S4 + C3: headerless ``query<TAB>answers-literal`` to ``(qid, query, answers)``;
    qid is the 0-based row position."""
    raw = spark.read.schema(QUERY_TSV_SCHEMA).options(header="false", **TSV).csv(path)
    ided = row_ids_text(raw, "qid")
    return ided.select("qid", "query", parse_answers("answers").alias("answers"))


def read_training_source(spark: SparkSession, path: str) -> DataFrame:
    """One JSON array of ``{question, positive_ctxs, hard_negative_ctxs}``;
    ``qid`` is the 0-based record position in file order."""
    raw = spark.read.schema(TRAINING_SOURCE_SCHEMA).option("multiLine", "true").json(path)
    return row_ids_text(raw, "qid")


def read_training_rows(spark: SparkSession, path: str) -> DataFrame:
    """Training JSONL with all its keys; ``neg`` may be absent (null); ``qid`` = line
    position. The keys beside ``query, pos, neg`` are found by reading the file once. The rows
    are read at each use and not kept: mined ones are several times their corpus."""
    known = StructType.fromDDL(TRAINING_ROWS_SCHEMA)
    found = spark.read.json(path).schema
    others = [f for f in found.fields if f.name not in known.names]
    return row_ids_text(spark.read.schema(StructType([*known.fields, *others])).json(path), "qid", keep=False)


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """A saved run ``(qid, rank, doc_id, score)``."""
    return spark.read.schema(RUN_SCHEMA).parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Dense vectors ``(id, embedding)``."""
    return spark.read.parquet(path)


def read_bm25_index(spark: SparkSession, path: str | None):
    """BM25 tables, or ``None`` when no path is given (dense only).

    The postings are declared as a table bucketed by ``doc_id`` over the written
    files (bucket count from the index's own metadata), so a search in this
    session keeps the per-document aggregation free of exchanges.
    """
    if path is None:
        return None
    from lumenrank.operators.lexical import Bm25Index

    base = path.rstrip("/")
    meta = spark.read.json(f"{base}/_index").first()
    name = f"lumenrank_postings_{uuid.uuid4().hex[:12]}"
    term_buckets = meta.asDict().get("term_buckets")
    parts = "PARTITIONED BY (tb) " if term_buckets else ""
    spark.sql(
        f"CREATE TABLE {name} ({meta['postings_ddl']}) USING parquet {parts}"
        f"CLUSTERED BY (doc_id) SORTED BY (doc_id) INTO {int(meta['buckets'])} BUCKETS LOCATION '{base}/postings'"
    )
    if term_buckets:
        spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
    return Bm25Index(
        postings=spark.table(name),
        doc_stats=spark.read.parquet(f"{base}/doc_stats"),
        term_stats=spark.read.parquet(f"{base}/term_stats"),
        doc_vectors=spark.read.parquet(f"{base}/doc_vectors"),
        materialized=True,
        term_buckets=int(term_buckets) if term_buckets else None,
    )


# ---------------------------------------------------------------- sinks
def file_count(texts: DataFrame, least: int = 1) -> int:
    """How many files ``texts`` (its string columns, measured) is written to where a reader
    cannot split a file (``multiLine``): ``FILE_BYTES`` a file, so no task reads much more."""
    sizes = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in texts.schema.fields if f.dataType == StringType()]
    total = texts.agg(F.sum(sum(sizes, F.lit(0).cast("bigint"))).alias("n")).first()["n"] or 0
    return max(least, -(-total // FILE_BYTES))


def write_jsonl(df: DataFrame | Iterable[DataFrame], path: str, compression: str = "none") -> None:
    """K1 / K4: JSON lines, UTF-8 kept as is, null fields written (not dropped). Parts of a table
    are written one after the other, and the shuffle files of each go before the next."""
    for i, part in enumerate([df] if isinstance(df, DataFrame) else df):
        with freeing(part.sparkSession):
            part.write.mode("append" if i else "overwrite").option("ignoreNullFields", "false").json(path, compression=compression)


def write_corpus_tsv(df: DataFrame, path: str) -> None:
    """Header TSV with quoting, the format S1 reads."""
    df.write.mode("overwrite").options(header="true", **{k: v for k, v in TSV.items() if k != "multiLine"}) \
        .option("quoteAll", "false").csv(path)


def write_query_tsv(df: DataFrame, path: str) -> None:
    """Headerless ``query<TAB>answers-literal``, the format S4 reads."""
    df.write.mode("overwrite").options(header="false", **{k: v for k, v in TSV.items() if k != "multiLine"}).csv(path)


def run_path(base: str, methods) -> str:
    """K2 path tag: sorted method names joined by ``_``, ``none`` when empty."""
    tag = "_".join(sorted(methods)) if methods else "none"
    return f"{base.rstrip('/')}/{tag}"


def write_run(run: DataFrame, path: str) -> None:
    """K2: the run as Parquet (not pickle)."""
    run.select("qid", F.col("rank").cast("int"), "doc_id", F.col("score").cast("double")) \
        .write.mode("overwrite").parquet(path)


def write_hits(per_query: DataFrame, path: str) -> None:
    """K3: one TSV per k (``k=<k>/``) with header ``id<TAB>hit``, id 1-based."""
    per_query.select("k", (F.col("qid") + 1).alias("id"), "hit").write.mode("overwrite") \
        .partitionBy("k").options(sep="\t", header="true").csv(path)


def write_hit_files(per_query: DataFrame, folder: str) -> None:
    """K3 in the original layout: ``hit@{k}.txt`` per k, header ``id<TAB>hit``, one line a query in
    the order of the ids. Parts are sorted by range and then joined as byte streams, so no
    task and no process holds a file's rows."""
    spark, base = per_query.sparkSession, folder.rstrip("/")
    parts = work_path(spark, "hit-parts")
    lines = per_query.select("k", (F.col("qid") + 1).alias("id"), "hit").orderBy("k", "id")
    lines.select("k", F.concat_ws("\t", "id", "hit").alias("value")).write.partitionBy("k").text(parts)
    hadoop = spark._jvm.org.apache.hadoop
    conf = spark._jsc.hadoopConfiguration()
    at = hadoop.fs.Path(parts)
    fs = at.getFileSystem(conf)
    for found in fs.listStatus(at):
        if not found.isDirectory():
            continue
        target = hadoop.fs.Path(f"{base}/hit@{found.getPath().getName().removeprefix('k=')}.txt")
        out = target.getFileSystem(conf).create(target, True)
        try:
            out.write(bytearray(b"id\thit\n"))
            for part in sorted(x.getPath().toString() for x in fs.listStatus(found.getPath())):
                if part.rsplit("/", 1)[1].startswith("part-"):
                    source = fs.open(hadoop.fs.Path(part))
                    try:
                        hadoop.io.IOUtils.copyBytes(source, out, 1 << 20, False)
                    finally:
                        source.close()
        finally:
            out.close()


def read_hit_file(spark: SparkSession, path: str) -> DataFrame:
    """A ``hit@{k}.txt``: ``(line, id, hit)``, lines counted from 0."""
    rows = spark.read.schema("id long, hit long").options(sep="\t", header="true").csv(path)
    return row_ids_text(rows, "line").select("line", "id", "hit")


def write_vectors(vectors: DataFrame, path: str) -> None:
    """K5: the dense index as Parquet ``(id, embedding)``."""
    vectors.write.mode("overwrite").parquet(path)


def write_bm25_index(index, path: str, buckets: int | None = None) -> None:
    """K6: the four BM25 tables; postings bucketed and sorted by ``doc_id``.

    A small ``_index`` record keeps the bucket count and the postings schema so
    that ``read_bm25_index`` can declare the same bucketing in another session.
    """
    spark = index.postings.sparkSession
    base = path.rstrip("/")
    n = buckets or index.buckets or bucket_count(spark)
    tb = getattr(index, "term_buckets", None)
    writer = index.postings.write.mode("overwrite")
    if tb:  # term-hash folders (see lexical.build_index(term_buckets=...))
        writer = writer.partitionBy("tb")
    writer.bucketBy(n, "doc_id").sortBy("doc_id").format("parquet") \
        .option("path", f"{base}/postings").saveAsTable(f"lumenrank_postings_w_{uuid.uuid4().hex[:12]}")
    index.doc_stats.write.mode("overwrite").parquet(f"{base}/doc_stats")
    index.term_stats.write.mode("overwrite").parquet(f"{base}/term_stats")
    index.doc_vectors.write.mode("overwrite").parquet(f"{base}/doc_vectors")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in index.postings.schema.fields)
    spark.createDataFrame([(n, ddl, tb)], "buckets int, postings_ddl string, term_buckets int").coalesce(1) \
        .write.mode("overwrite").option("ignoreNullFields", "false").json(f"{base}/_index")
