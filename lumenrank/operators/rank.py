"""Ranked-list operators on runs ``(qid, rank, doc_id, score)``.

R5 reciprocal-rank fusion, R6 pass-through, R7 pointwise rerank, C9 / C10 / R8
listwise reorder, J1 passage lookup. Every ranking window is partitioned by
``qid`` and holds at most the run depth (or the fused 2x depth) rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lumenrank import config as C
from lumenrank.functions.text import extract_indices, tokens
from lumenrank.operators.lexical import Bm25Index
from lumenrank.operators.plan import bounded_broadcast, lookup

RUN_COLS = ["qid", "rank", "doc_id", "score"]


def attach_text(run: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Left-join passage text onto a run by id (not by position).

    The corpus is only scanned (``doc_id, text``) and cut down to the run's passages, and a
    passage that very many lists hold is spread over many tasks (``plan.lookup``). Run rows
    whose id is not in the pool keep a null text.
    """
    return lookup(run, docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "doc_id")


def unmatched_ids(run: DataFrame, docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Run rows whose doc_id has no passage (the positional lookup would be wrong)."""
    return run.join(docs.select(F.col(id_col).alias("doc_id")), "doc_id", "left_anti")


def rrf_fuse(dense: DataFrame, bm25: DataFrame | None, rrf_k: int = C.RRF_K) -> DataFrame:
    """Fused run, score = sum of 1 / (rrf_k + rank); not truncated.

    Without a BM25 run the dense run comes back unchanged. Order: score desc,
    then dense rank asc (absent last), then BM25 rank asc, as a stable sort over
    the dense-then-BM25 insertion order gives. Ranked on the unrounded score.
    """
    if bm25 is None:
        return dense.select(*RUN_COLS)
    both = dense.select("qid", "doc_id", F.col("rank").alias("d_rank"), F.lit(None).cast("int").alias("b_rank")) \
        .unionByName(bm25.select("qid", "doc_id", F.lit(None).cast("int").alias("d_rank"), F.col("rank").alias("b_rank")))
    contrib = F.lit(1.0) / (F.lit(rrf_k) + F.coalesce("d_rank", "b_rank"))
    fused = both.groupBy("qid", "doc_id").agg(
        F.sum(contrib).alias("score"), F.min("d_rank").alias("d_rank"), F.min("b_rank").alias("b_rank")
    )
    w = Window.partitionBy("qid").orderBy(
        F.col("score").desc(), F.col("d_rank").asc_nulls_last(), F.col("b_rank").asc_nulls_last()
    )
    return fused.withColumn("rank", F.row_number().over(w)).select(*RUN_COLS)


class CoverageScorer:
    """D3 default scorer: share of distinct query terms found in the passage (JVM only).

    On a whole run it works by term sets: each passage of the run has one array of its
    distinct terms, which meets the run's rows by ``doc_id`` (hot passages are spread, see
    ``plan.lookup``) and is intersected with the query's. Given a BM25 ``index``, the sets come
    from its postings, of the queries' terms only: as these are bucketed by ``doc_id``, nothing
    is tokenised or shuffled for them. Else the run's passages are tokenised once each.
    ``__call__`` scores a pairs table with ``query`` and ``text`` columns directly (same result).
    """

    def __init__(self, index: Bm25Index | None = None):
        self.index = index

    def score_run(self, run: DataFrame, queries: DataFrame, docs: DataFrame) -> DataFrame:
        q = bounded_broadcast(queries.select("qid", F.array_distinct(tokens("query")).alias("_q")))
        if self.index is None:
            sets = docs.select("doc_id", F.array_distinct(tokens("text")).alias("_d"))
        else:
            vocabulary = bounded_broadcast(q.select(F.explode("_q").alias("term")).distinct())
            sets = self.index.postings.select("doc_id", "term").join(vocabulary, "term", "left_semi")
            sets = sets.groupBy("doc_id").agg(F.collect_list("term").alias("_d"))
        pairs = lookup(run, sets, "doc_id").join(q, "qid", "left")
        found = F.coalesce(F.size(F.array_intersect("_q", F.coalesce("_d", F.array().cast("array<string>")))), F.lit(0))
        score = F.when(F.size("_q") > 0, found / F.size("_q")).otherwise(F.lit(0.0))
        return pairs.withColumn("pair_score", score.cast("double")).drop("_q", "_d")

    def __call__(self, pairs: DataFrame) -> DataFrame:
        q = F.array_distinct(tokens("query"))
        d = tokens("text")
        score = F.when(F.size(q) > 0, F.size(F.array_intersect(q, d)) / F.size(q)).otherwise(F.lit(0.0))
        return pairs.withColumn("pair_score", score.cast("double"))


coverage_scores = CoverageScorer()


def batch_pair_scorer(fn: Callable[[list[str], list[str]], list[float]], batch_size: int | None = None):
    """D3 with a model: ``fn(queries, passages) -> scores`` run on Arrow batches.

    Returns a ``pairs -> pairs + pair_score`` function using ``mapInPandas``; the
    callable sees one flat batch of pairs at a time (of at most ``batch_size``), as the original did.
    """

    def apply(pairs: DataFrame, query_col: str = "query", text_col: str = "text") -> DataFrame:
        schema = StructType(list(pairs.schema.fields) + [StructField("pair_score", DoubleType(), True)])

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                q, t = pdf[query_col].fillna("").tolist(), pdf[text_col].fillna("").tolist()
                step = batch_size or max(1, len(q))
                scores = [s for i in range(0, len(q), step) for s in fn(q[i:i + step], t[i:i + step])]
                yield pdf.assign(pair_score=pd.Series(scores, dtype="float64", index=pdf.index))

        return pairs.mapInPandas(run, schema)

    return apply


def pointwise_rerank(
    run: DataFrame,
    queries: DataFrame,
    docs: DataFrame,
    scorer: Callable[[DataFrame], DataFrame] = coverage_scores,
) -> DataFrame:
    """Score every (raw query, passage) pair; sort by score desc, old rank asc.

    The new scores replace the retrieval scores. ``queries`` holds ``(qid, query)``.
    """
    scored = score_pairs(run, queries, docs, scorer)
    w = Window.partitionBy("qid").orderBy(F.col("pair_score").desc(), F.col("rank").asc())
    return scored.select(
        "qid", "doc_id", F.col("pair_score").alias("score"), F.row_number().over(w).alias("rank")
    ).select(*RUN_COLS)


def score_pairs(run: DataFrame, queries: DataFrame, docs: DataFrame, scorer=coverage_scores) -> DataFrame:
    """``run`` rows with ``pair_score`` from (raw query, passage).

    A scorer with ``score_run`` works on the whole run (relational); any other
    callable gets a pairs table with ``query`` and ``text`` columns.
    """
    if hasattr(scorer, "score_run"):
        return scorer.score_run(run, queries.select("qid", "query"), docs)
    pairs = attach_text(run, docs).join(bounded_broadcast(queries.select("qid", "query")), "qid", "left")
    return scorer(pairs)  # a row without its query stays, with a null query


def listwise_prompts(run: DataFrame, queries: DataFrame, docs: DataFrame, top_n: int = C.LISTWISE_TOP_N) -> DataFrame:
    """``(qid, prompt)`` with the first ``top_n`` passages as ``[i] text``, newline-joined."""
    top = attach_text(run.where(F.col("rank") <= top_n), docs)
    block = top.groupBy("qid").agg(
        F.array_sort(F.collect_list(F.struct("rank", F.coalesce("text", F.lit("")).alias("text")))).alias("items")
    )
    lines = F.array_join(
        F.transform("items", lambda x: F.concat(F.lit("["), x["rank"].cast("string"), F.lit("] "), x["text"])), "\n"
    )
    return block.join(bounded_broadcast(queries.select("qid", "query")), "qid", "left").select(
        "qid",
        F.concat(F.lit(C.LISTWISE_PROMPT_PREFIX), F.coalesce("query", F.lit("")), F.lit(C.LISTWISE_PROMPT_MIDDLE), lines,
                 F.lit(C.LISTWISE_PROMPT_SUFFIX)).alias("prompt"),
    )


def listwise_rerank(run: DataFrame, completions: DataFrame | None, top_n: int = C.LISTWISE_TOP_N) -> DataFrame:
    """Indices named by the completion come first, in that order; every
    other doc follows in its old order; each doc keeps its old score.

    No completions table, a missing or blank completion, or no valid index
    leaves a query's list unchanged. Indices beyond the list length match no doc.
    """
    if completions is None:
        return run.select(*RUN_COLS)
    picks = completions.select("qid", F.posexplode(extract_indices("completion", top_n)).alias("pick", "rank"))
    w = Window.partitionBy("qid").orderBy(F.col("pick").asc_nulls_last(), F.col("rank").asc())
    return (
        run.join(bounded_broadcast(picks), ["qid", "rank"], "left")
        .withColumn("new_rank", F.row_number().over(w))
        .select("qid", F.col("new_rank").alias("rank"), "doc_id", "score")
    )
