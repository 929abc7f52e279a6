"""Stand-in inputs derived from the test tables (see FIXTURES.md).

The original works on a corpus, a query set with answer strings, a nested
training source and model completions. Each is derived here from the given
Parquet tables with DataFrame expressions only, over every row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# qid of a training row: conv_id * 2^31 + turn of the user turn.
TRAIN_QID_SHIFT = 2**31
ANSWER_PATTERN = r"([\p{L}\p{N}]+ [\p{L}\p{N}]+)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passage pool ``(doc_id, text)``: ``doc_id`` is the file row number."""
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def query_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(qid, query, answers)``: the whole benchmark text is the query; the
    answers are its 5th and 6th two-word matches (original case)."""
    b = table(spark, sf_dir, "benchmark")
    return b.select(
        F.col("item_id").alias("qid"),
        F.col("text").alias("query"),
        F.slice(F.regexp_extract_all("text", F.lit(ANSWER_PATTERN), 1), 5, 2).alias("answers"),
    )


def _variant(qid: str = "qid", n: int = 4):
    return F.pmod(F.conv(F.substring(F.md5(F.col(qid).cast("string")), 1, 2), 16, 10).cast("int"), F.lit(n))


def hyde_completions(queries: DataFrame) -> DataFrame:
    """``(qid, completion)``: some useful, some blank, some absent."""
    v = _variant()
    comp = (
        F.when(v == 0, F.concat(F.lit(" "), F.array_join("answers", " "), F.lit(" \n")))
        .when(v == 1, F.lit("  \t "))
        .when(v == 3, F.array_join(F.reverse(F.split("query", " ")), " "))
    )
    return queries.where(v != 2).select("qid", comp.alias("completion"))


def listwise_completions(queries: DataFrame) -> DataFrame:
    """``(qid, completion)``: bracketed indices, out-of-range and repeated ones,
    none at all, blank, or absent."""
    v = _variant()
    q = F.col("qid")
    a = (F.pmod(q, F.lit(10)) + 1).cast("string")
    b = (F.pmod(q * 7 + 3, F.lit(10)) + 1).cast("string")
    c = (F.pmod(q * 3 + 1, F.lit(10)) + 1).cast("string")
    comp = (
        F.when(v == 0, F.concat(F.lit("["), a, F.lit("] ["), b, F.lit("], ("), c, F.lit(").")))
        .when(v == 1, F.concat(F.lit("The most relevant are 12, 0, 01 and "), b, F.lit(".")))
        .when(v == 2, F.lit(" "))
    )
    return queries.where(v != 3).select("qid", comp.alias("completion"))


def training_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested training source from conversations.

    Each user turn followed by an assistant turn is one sample: question = the
    user text, one positive = the next assistant text, hard negatives = the
    assistant texts just before the user turn and two turns after the positive.
    Built with one shuffle on ``(conv_id, turn)``: every assistant row is sent to
    the user turns that refer to it, so a long conversation spreads over tasks.
    """
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    user = c.where(F.col("role") == "user").select("conv_id", "turn", F.lit(0).alias("slot"), "text")
    asst = c.where(F.col("role") == "assistant")
    # slot 1: positive (assistant at turn+1); 2: negative before (turn-1); 3: negative after (turn+3)
    addressed = asst.select(
        "conv_id",
        F.explode(F.array(
            F.struct((F.col("turn") - 1).alias("turn"), F.lit(1).alias("slot")),
            F.struct((F.col("turn") + 1).alias("turn"), F.lit(2).alias("slot")),
            F.struct((F.col("turn") - 3).alias("turn"), F.lit(3).alias("slot")),
        )).alias("a"),
        "text",
    ).select("conv_id", "a.turn", "a.slot", "text")
    g = user.unionByName(addressed).groupBy("conv_id", "turn").agg(
        *[F.max(F.when(F.col("slot") == s, F.col("text"))).alias(f"s{s}") for s in range(4)],
        *[F.max(F.when(F.col("slot") == s, F.lit(1))).alias(f"has{s}") for s in range(4)],
    )
    g = g.where((F.col("has0") == 1) & (F.col("has1") == 1))
    negs = F.filter(
        F.array(
            F.when(F.col("has2") == 1, F.struct(F.col("s2").alias("text"))),
            F.when(F.col("has3") == 1, F.struct(F.col("s3").alias("text"))),
        ),
        lambda x: x.isNotNull(),
    )
    return g.select(
        (F.col("conv_id") * TRAIN_QID_SHIFT + F.col("turn")).alias("qid"),
        F.col("s0").alias("question"),
        F.array(F.struct(F.col("s1").alias("text"))).alias("positive_ctxs"),
        negs.alias("hard_negative_ctxs"),
    )
