"""V1-V4: hit flags, per-query hit@k, mean hit@k, run / query-set alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenrank import config as C
from lumenrank.functions.text import contains_any
from lumenrank.operators.plan import bounded_broadcast
from lumenrank.operators.rank import attach_text


class AlignmentError(ValueError):
    pass


def hit_flags(run: DataFrame, queries: DataFrame, docs: DataFrame) -> DataFrame:
    """``(qid, rank, doc_id, score, hit)``; hit = any answer in the passage."""
    with_text = attach_text(run, docs)
    ans = bounded_broadcast(queries.select("qid", "answers"))
    return with_text.join(ans, "qid", "left").select(
        "qid", "rank", "doc_id", "score", contains_any("text", F.coalesce("answers", F.array())).alias("hit")
    )


def hit_at_k(flags: DataFrame, queries: DataFrame, ks=C.HIT_KS) -> DataFrame:
    """``(k, qid, hit)`` for every query and every k in one pass.

    Per query only the first hitting rank is kept; a query with no results or
    no hit gets 0 for every k.
    """
    first = flags.where(F.col("hit") == 1).groupBy("qid").agg(F.min("rank").alias("first_hit"))
    per_q = queries.select("qid").join(first, "qid", "left")
    k_arr = F.array(*[F.lit(int(k)).cast("bigint") for k in ks])
    return per_q.select(F.explode(k_arr).alias("k"), "qid", "first_hit").select(
        "k", "qid", F.when(F.col("first_hit") <= F.col("k"), 1).otherwise(0).cast("bigint").alias("hit")
    )


def hit_mean(per_query: DataFrame, ks=C.HIT_KS) -> DataFrame:
    """V3: ``(k, hit_rate)`` averaged over all queries; 0.0 for every k when there are none."""
    means = per_query.groupBy("k").agg(F.avg("hit").alias("hit_rate"))
    k_tab = per_query.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(int(k)).cast("bigint") for k in ks])).alias("k"))
    return k_tab.join(means, "k", "left").select("k", F.coalesce("hit_rate", F.lit(0.0)).alias("hit_rate"))


def alignment(run: DataFrame, queries: DataFrame) -> DataFrame:
    """V4: ``(run_qids_unknown, queries_without_rows)`` counts in one row."""
    rq = run.select("qid").distinct()
    qq = queries.select("qid")
    unknown = rq.join(qq, "qid", "left_anti").agg(F.count(F.lit(1)).alias("run_qids_unknown"))
    empty = qq.join(rq, "qid", "left_anti").agg(F.count(F.lit(1)).alias("queries_without_rows"))
    return _one_row(unknown, empty)


def _one_row(a: DataFrame, b: DataFrame) -> DataFrame:
    key = F.lit(1).alias("_one")
    return a.select("*", key).join(b.select("*", key), "_one").drop("_one")


def check_alignment(run: DataFrame, queries: DataFrame, allow_empty: bool = False) -> None:
    """Raise when the run names queries that are not in the query set, or lacks some that
    are. ``allow_empty`` accepts the latter: a query that matched nothing has no rows."""
    row = alignment(run, queries).first()
    if row["run_qids_unknown"]:
        raise AlignmentError(f"run has {row['run_qids_unknown']} query ids not in the query set")
    if row["queries_without_rows"] and not allow_empty:
        raise AlignmentError(f"run has no rows for {row['queries_without_rows']} queries")
